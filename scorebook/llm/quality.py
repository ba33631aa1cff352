"""Quality classifier by importance resampling: two hashed n-gram models and Gumbel top-k.

Every document becomes the set of its hashed n-grams: its words (runs of letters), the first 4, 5 and 6 bytes of longer words, the pairs of neighbouring
bytes outside words (a byte alone there counts by itself), and triples of word shapes (case, and whether the word repeats the one before); the
last two once for each power of two that their count reaches. So every byte of a text is in some n-gram. Two generative models count in how many
documents each of ``buckets`` n-grams occurs: the raw model over all documents, the target model over the documents labelled good (quality 1, not
toxic). The log importance weight of a document is the sum of log(target / raw) over its n-grams.

Each ratio is shrunk by how well it is proved: by the factor 1 - ``doubt`` / D, or 0 if that is less. D is the deviance of the numbers of good and bad
labelled documents with the n-gram from the usual share of good ones, plus what the deviance of its target count from its raw count has above
``copies``: unlabelled documents speak too, but copies of one document are no independent witnesses. So no ratio is cut off, but one that chance explains counts little
or nothing, and one that the labels contradict counts nothing. Ratios are centred so that the n-grams of good documents weigh 0 on average, however many there are.

Weight / ``temperature`` plus Gumbel noise (a hash of id and text) is the key; the k greatest keys are a sample without
replacement in proportion to the weights. k is the number of documents whose weight reaches the cut that separates the labelled
good and bad documents best, a good one lost costing ``clean_cost`` times a bad one kept. The k-th key is found exactly by three counts of 16 bits each;
keys equal to it are all kept.

At most ``label_rows`` labelled rows are used, those with the smallest hashed ids; everything else counts all documents. A label
with a null field is not used; a document with several labels is good only if all say so. Without good labels there is no target and every
document is kept; without bad ones nothing speaks against any, and all are kept too. Null and empty texts have no n-grams and weight 0. Repeated rows share noise and decision. An empty table
gives no rows. All columns pass through; operator columns are named ``log_weight`` and ``gumbel_key`` and replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm.common import stored, with_small_batches
from scorebook.llm.wordarrays import _BYTE, Chunk, chunks, mix, ragged, span_hashes
from scorebook.session import ship_package

BITS = 18
BUCKETS = 1 << BITS
#: Fixed point of the keys: 2**-20.
FINE = 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[0x41:0x5B] = True
_IS_LOWER = np.zeros(256, bool)
_IS_LOWER[0x61:0x7B] = True


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(0x9E3779B97F4A7C15 * (kind + 1) % 2**64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(doc: np.ndarray, h: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and buckets of n-grams, one for each power of two that their count reaches."""
    if not len(h):
        return doc, h.astype(np.int64)
    both = mix(h) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, at, n = np.unique(both, return_index=True, return_counts=True)
    reached = np.frexp(n)[1]
    power = ragged(np.ones(len(at), np.int64), reached).astype(np.uint64)
    at = np.repeat(at, reached)
    return doc[at], _bucket(h[at] + power * np.uint64(0xA24BAED4963EE407), kind)


def between(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Documents and values of what stands outside words: each pair of neighbouring bytes there, and each byte that stands alone."""
    data, other = chunk.data, ~_LETTER[chunk.data]
    at = np.flatnonzero(other)
    doc = np.searchsorted(chunk.offsets, at, "right") - 1
    follows = np.zeros(len(at), bool)  # whether the next byte is outside words too, in the same document
    follows[:-1] = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
    alone = ~follows
    alone[1:] &= ~follows[:-1]
    value = data[at].astype(np.uint64)
    pair = value * np.uint64(256) + data[np.minimum(at + 1, max(len(data) - 1, 0))] + np.uint64(256)
    keep = follows | alone
    return doc[keep], np.where(follows, pair, value)[keep]


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs of a chunk, by document."""
    data = chunk.data
    folded = _LOWER[data]
    upper, lower = _IS_UPPER[data], _IS_LOWER[data]
    if len(data) > 1:
        latin = np.zeros(len(data), bool)
        latin[1:] = data[:-1] == 0xC3
        big = latin & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        folded[big] += 0x20
        upper |= big
        lower |= latin & (data >= 0x9F)
    words = chunk.words(~_LETTER)
    n, owner = len(words.starts), words.owner()
    values = _BYTE[0][folded]
    h = span_hashes(values, words.starts, words.ends)
    docs, buckets = [owner], [_bucket(h, 0)]
    size = words.ends - words.starts
    for k in (4, 5, 6):
        at = np.flatnonzero(size > k)
        docs.append(owner[at])
        buckets.append(_bucket(span_hashes(values, words.starts[at], words.starts[at] + k), k))
    d, b = _counted(*between(chunk), 7)
    docs.append(d)
    buckets.append(b)
    if n:
        last = np.ones(n, bool)
        last[:-1] = owner[1:] != owner[:-1]
        ups, lows = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(lower)])
        shape = np.where(upper[words.starts] | upper[np.minimum(words.starts + 1, len(data) - 1)] & (data[words.starts] == 0xC3), 1, 0)
        shape[(lows[words.ends] == lows[words.starts]) & (ups[words.ends] - ups[words.starts] >= 2)] = 2
        again = np.zeros(n, bool)
        again[1:] = (h[1:] == h[:-1]) & ~last[:-1]
        shape += 3 * again
        if n > 2:
            within = owner[2:] == owner[:-2]
            d, b = _counted(owner[2:][within], (shape[:-2] * 36 + shape[1:-1] * 6 + shape[2:])[within].astype(np.uint64), 8)
            docs.append(d)
            buckets.append(b)
    pairs = (np.concatenate(docs) << BITS) | np.concatenate(buckets)
    if chunk.n < 1 << (32 - BITS):
        pairs = pairs.astype(np.uint32)
    pairs.sort()
    if len(pairs):
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    return (pairs >> BITS).astype(np.int64), (pairs & (BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """log(target / raw) of each bucket; no more than ``BUCKETS`` numbers."""

    ratios: np.ndarray
    good: np.ndarray
    bad: np.ndarray


def label_ids(labels: DataFrame, label_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of the good and of the bad documents among at most ``label_rows`` labelled ones."""
    each = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
            .groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows))
    rows = each.toArrow()
    ids, good = rows["doc_id"].to_numpy().astype(np.int64), rows["good"].to_numpy()
    return np.sort(ids[good == 1]), np.sort(ids[good == 0])


def member(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(ids), bool)
    return of[np.minimum(np.searchsorted(of, ids), len(of) - 1)] == ids


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = 200_000, doubt: float = 6.0, copies: float = 16.0) -> Model:
    spark = docs.sparkSession
    ship_package(spark)
    with_small_batches(spark)
    good, bad = label_ids(labels, label_rows)
    held = spark.sparkContext.broadcast((good, bad))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, against, raw = (np.zeros(BUCKETS, np.int64) for _ in range(3))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marked = [(target, member(ids, held.value[0])), (against, member(ids, held.value[1]))]
            for chunk in chunks(batch.column(1)):
                doc, bucket = features(chunk)
                raw += np.bincount(bucket, minlength=BUCKETS)
                for counts, chosen in marked:
                    counts += np.bincount(bucket[chosen[chunk.first: chunk.first + chunk.n][doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(against[at]), pa.array(raw[at])], ["bucket", "target", "against", "raw"])

    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = (ids.mapInArrow(count, "bucket long, target long, against long, raw long")
               .groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("against").alias("against"), F.sum("raw").alias("raw")).toArrow())
    counts = np.zeros((3, BUCKETS))
    counts[:, counted["bucket"].to_numpy()] = [counted[name].to_numpy() for name in ("target", "against", "raw")]
    return Model(shrunk_ratios(*counts, doubt, copies).astype(np.float32), good, bad)


def usual_share(part: np.ndarray, of: np.ndarray) -> float:
    """The median of part / of, each n-gram counting as often as it occurs."""
    share = part / np.maximum(of, 1)
    order = np.argsort(share)
    weight = np.cumsum(of[order])
    return float(share[order[np.searchsorted(weight, weight[-1] / 2)]])


def shrunk_ratios(target: np.ndarray, against: np.ndarray, raw: np.ndarray, doubt: float, copies: float) -> np.ndarray:
    """log(target / raw) of each n-gram, shrunk by the labels' doubt and centred on the target model's mean."""
    labelled = target + against
    if not target.sum() or not against.sum():
        return np.zeros(len(raw))
    share, usual = usual_share(target, labelled), usual_share(target, raw) or target.sum() / raw.sum()
    share = min(max(share, 0.01), 0.99)  # 0 or 1 is the median where nearly all labels agree; the deviance needs room on both sides
    log = np.log((target + 0.5) / (raw * usual + 0.5))

    def part(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(expected, 1e-9)), 0)

    deviance = 2 * (part(target, labelled * share) + part(against, labelled * (1 - share)))
    deviance += np.maximum(0, 2 * (part(target, raw * usual) - target + raw * usual) - copies)
    agree = np.where(labelled > 0, (target > labelled * share) == (log > 0), True)
    shrunk = np.where(agree, log, 0) * np.maximum(0, 1 - doubt / np.maximum(deviance, 1e-9))
    return shrunk - (shrunk * target).sum() / target.sum()


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``log_weight``."""
    spark = docs.sparkSession
    ship_package(spark)
    with_small_batches(spark)
    held = spark.sparkContext.broadcast(model.ratios)
    docs = docs.drop("log_weight")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column(at).cast(pa.large_string())):
                doc, bucket = features(chunk)
                weight[chunk.first: chunk.first + chunk.n] = np.bincount(doc, held.value[bucket], chunk.n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], [*names, "log_weight"])
            del batch
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType())]))


def best_cut(weights: DataFrame, model: Model, clean_cost: float = 2.0) -> float:
    """The weight from which on documents count as good: least cost of both error rates on the labelled ones."""
    spark = weights.sparkSession
    held = spark.sparkContext.broadcast((model.good, model.bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            step = np.clip(np.floor(batch.column(1).to_numpy() * 4), -400, 400).astype(np.int64)
            for label, of in enumerate(held.value[::-1]):
                kinds, n = np.unique(step[member(ids, of)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), label)), pa.array(kinds), pa.array(n)], ["label", "step", "n"])

    rows = (weights.select(F.col("doc_id").cast("long"), "log_weight").mapInArrow(run, "label long, step long, n long")
            .groupBy("label", "step").agg(F.sum("n").alias("n")).collect())
    table = np.zeros((2, 802))
    for r in rows:
        table[r["label"], r["step"] + 400] += r["n"]
    if not table[0].sum() or not table[1].sum():
        return float("-inf")
    share = np.concatenate([np.zeros((2, 1)), np.cumsum(table / table.sum(1, keepdims=True), axis=1)], axis=1)
    error = clean_cost * share[1] + 1 - share[0]  # good ones below the cut, bad ones from it on
    if error.min() >= error[0]:
        return float("-inf")
    first = int(np.argmin(error))
    best = np.flatnonzero(error <= error.min() + 1e-12)
    run = best[: int(np.searchsorted(best - first - np.arange(len(best)), 0, "right"))]
    return float((run[len(run) // 2] - 400) / 4)


def kth_greatest(keys: DataFrame, k: int) -> int:
    """The k-th greatest of the longs in ``key`` (48 bits): counts of the upper, middle and lower 16 bits."""
    prefix = 0
    for shift in (32, 16, 0):
        rest = keys.where(F.shiftright("key", shift + 16) == prefix) if shift < 32 else keys
        rows = rest.groupBy(F.shiftright("key", shift).alias("part")).agg(F.count("*").alias("n")).collect()
        for part, n in sorted(((r["part"], r["n"]) for r in rows), reverse=True):
            if k <= n:
                prefix = part
                break
            k -= n
    return prefix


def classify(docs: DataFrame, labels: DataFrame, temperature: float = 0.5, seed: int = 1, label_rows: int = 200_000,
             model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """The kept documents and the rejected ones, both with ``log_weight`` and ``gumbel_key``."""
    model = model or fit(docs, labels, label_rows)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 12) + F.lit(0.5)) / F.lit(2.0**52)
    scored = (weigh(docs, model).drop("gumbel_key")
              .withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(u))))
    # Only ids, weights and keys are stored; the texts are read again rather than copied.
    key = F.round(F.greatest(F.least(F.col("gumbel_key"), F.lit(2.0**26)), F.lit(-(2.0**26))) * F.lit(2.0**FINE)).cast("long")
    small = stored(scored.select("doc_id", "log_weight", "gumbel_key", key.alias("key")), "quality-keys")
    cut = best_cut(small, model)
    k = small.where(F.col("log_weight") >= cut).count()
    last = kth_greatest(small, k) if k else 2**62
    return scored.where(key >= last), scored.where(key < last)


def kept_ids(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, log_weight, gumbel_key`` of the sample."""
    return classify(docs, labels, **options)[0].select("doc_id", "log_weight", "gumbel_key")
