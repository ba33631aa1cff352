"""N-gram Jaccard join by MinHash banding, and the near-duplicate classes that its links make.

Documents are the sets of their ``n`` consecutive words (white space cut; a text of 1 to n - 1 words is one n-gram). Documents with
the same set are one class from the start, and its smallest id stands for it. Sets of MinHash values are cut into bands of ``rows`` values;
the number of bands follows from the target recall at the threshold. Representatives that share a band hash are candidates, and
candidates are verified on their full sets.

Nothing lists pairs. Candidates form components; the sets of a component meet in one task, which verifies all its pairs at once
and returns one row per document: its links, and the root of its links. A component over ``unit_docs`` documents or
``unit_grams`` n-grams meets by band hash instead, and a band hash over these bounds in pairs of sub-blocks; there a pair counts only in
the first band that it shares, so every link counts once however it is found.

Null and empty texts have no n-grams; they are one class of equal texts without links. Rows that repeat are copies. Ids may be null or repeat
(a null counts as the smallest). An empty table gives no rows. Other columns are not read by the join and pass through ``drop_near``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import NO_ID, doc_key, free_name, map_batches, public_id, stored
from scorebook.llm.wordarrays import chunks, mix, window_hashes
from scorebook.session import ship_package


def bands_for(recall: float, threshold: float, rows: int) -> int:
    """Bands that find a pair at the threshold with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each document."""
    for chunk in chunks(column):
        words = chunk.words()
        size = np.diff(words.doc)
        length = np.where(size < n, size, n)
        h = words.hashes()
        full = np.maximum(len(h) - n + 1, 0)
        grams = window_hashes(h, np.arange(full), n)
        for a, k, w in zip(words.doc[:-1].tolist(), size.tolist(), length.tolist()):
            if k >= n:
                yield np.unique(grams[a: a + k - n + 1])
            elif k:
                yield window_hashes(h, np.array([a]), w)
            else:
                yield np.zeros(0, np.uint64)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


SIGNED = "did long, th long, fa long, fb long, n_grams int, bands binary"


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Each row's set: two fingerprints, its size, and its band hashes (none for an empty set)."""
    mul, add = permutations(bands * rows)

    def make():
        def step(batch: pa.RecordBatch):
            fa, fb, sizes, hashes = [], [], [], []
            group: list[np.ndarray] = []

            def flush() -> None:
                if not group:
                    return
                size = np.array([len(g) for g in group])
                low = (np.concatenate(group) >> np.uint64(32)).astype(np.uint32)
                full = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[full]
                values = np.zeros((len(full), bands * rows), np.uint32)
                for i in range(bands * rows if len(full) else 0):
                    values[:, i] = np.minimum.reduceat(low * mul[i] + add[i], starts)
                h = np.zeros((len(full), bands), np.uint64)
                for i in range(rows):
                    h = mix(h + values[:, i::rows] + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                out = [b""] * len(group)
                for j, row in zip(full.tolist(), h.astype("<u8")):
                    out[j] = row.tobytes()
                hashes.extend(out)
                group.clear()

            held = 0
            for s in gram_sets(batch.column("body"), n):
                m = mix(s)
                fa.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                fb.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                sizes.append(len(s))
                group.append(s)
                held += len(s)
                if held > 1 << 18:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(hashes, pa.binary())], ["did", "th", "fa", "fb", "n_grams", "bands"])

        return step

    return map_batches(doc_key(docs).withColumn("th", F.xxhash64("body")), make, SIGNED)


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the smallest id that the links ``u, v`` connect to each id. Labels spread to neighbours and jump to their labels."""
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "join-edges")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("root")), "join-labels")
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["id"] == near["u"]).select("id", "root", F.least("root", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("root").alias("beyond"))
        moved = stored(lower.join(jump, "to").select("id", F.least("to", "beyond").alias("new"), "root"), "join-labels")
        labels = moved.select("id", F.col("new").alias("root"))
        if moved.where(F.col("new") != F.col("root")).isEmpty():
            return labels


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wide: int = 4096) -> np.ndarray:
    """How many n-grams the sets ``left`` have in common with the sets ``right``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, gram, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = n[gram] > 1
    gram, owner = np.unique(gram[several], return_inverse=True)[1], owner[several]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(gram[-1]) + 1 if len(gram) else 0, wide):
        lo, hi = np.searchsorted(gram, [a, a + wide])
        has = np.zeros((len(sets), min(wide, int(gram[-1]) + 1 - a)), np.float32)
        has[owner[lo:hi], gram[lo:hi] - a] = 1
        common += has[left] @ has[right].T
    return common


def verified(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray, band: int | None, threshold: Fraction) -> np.ndarray:
    """Which pairs (left, right) are links; with ``band`` only those whose first shared band that is."""
    size = np.array([len(s) for s in sets])
    common = shared_counts(sets, left, right).astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - common
    link = common * threshold.denominator >= union * threshold.numerator
    if band is not None:
        for b in range(band):
            link &= bands[left, b][:, None] != bands[right, b][None, :]
        link &= bands[left, band][:, None] == bands[right, band][None, :]
    return link


def roots(link: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n documents is connected to by the links."""
    root = np.arange(n)
    a, b = np.nonzero(link)
    a, b = left[a], right[b]
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root[a] == root[b]).all():
            break
    return root


UNIT_SCHEMA = "rep long, n_links long, root long, whole boolean"


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999995, rows: int = 4,
                 unit_docs: int = 1024, unit_grams: int = 4_000_000) -> DataFrame:
    """``did, th, class, class_key, n_links, n_copies`` per row: the smallest id of its class (documents connected by links of at least
    ``threshold``), a key that no other class has even if ids repeat or are null, the number of other sets that its set links to, and of other rows
    with the same set."""
    spark = docs.sparkSession
    ship_package(spark)
    exact = Fraction(threshold).limit_denominator(10_000)
    bands = bands_for(recall, threshold, rows)
    rows_ = stored(signed(docs, n, bands, rows), "join-signed")
    same = ["fa", "fb", "n_grams"]
    sets = stored(rows_.groupBy(*same).agg(F.min("did").alias("rep"), F.min_by("th", F.struct("did", "th")).alias("rep_th"),
                                           F.min_by("bands", F.struct("did", "th")).alias("bands"), F.count("*").alias("n_rows")), "join-sets")
    # Sets are told apart by a number of their own: ids may repeat.
    sets = stored(sets.withColumn("set", F.monotonically_increasing_id()), "join-numbered")

    def unpack(batch: pa.RecordBatch):
        raw = batch.column("bands").to_pylist()
        some = [i for i, r in enumerate(raw) if r]
        h = np.frombuffer(b"".join(raw), "<i8")
        yield pa.RecordBatch.from_arrays(
            [batch.column("set").take(pa.array(np.repeat(np.array(some, np.int64), bands))), pa.array(h),
             pa.array(np.tile(np.arange(bands, dtype=np.int32), len(some)))], ["set", "h", "band"])

    hashes = map_batches(sets.select("set", "bands"), lambda: unpack, "set long, h long, band int")
    hashes = stored(hashes, "join-bands")
    buckets = hashes.groupBy("h").agg(F.min("set").alias("first"), F.count("*").alias("n"), F.min("band").alias("band")).where("n > 1")
    buckets = stored(buckets, "join-buckets")
    members = stored(hashes.select("set", "h").join(buckets, "h"), "join-members")
    linked = components(members.where("set <> first").select(F.col("set").alias("u"), F.col("first").alias("v")))
    # Where each candidate's set has to go.
    sized = linked.join(sets.select(F.col("set").alias("id"), "n_grams"), "id")
    comps = sized.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n_grams").alias("grams"))
    small = (F.col("docs") <= unit_docs) & (F.col("grams") <= unit_grams)
    placed = stored(sized.join(comps, "root").select("id", "root", "n_grams", small.alias("small")), "join-placed")
    whole = placed.where("small").select("id", F.col("root").alias("unit"), F.lit(-1).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    large = members.join(placed.where("not small"), members["set"] == placed["id"]).select("id", "h", "band", "n_grams")
    parts = large.groupBy("h").agg(F.greatest(F.ceil(F.count("*") / unit_docs), F.ceil(F.sum("n_grams") / unit_grams)).cast("int").alias("parts"))
    cut = large.join(parts, "h").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = other.select("id", F.col("h").alias("unit"), "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                         (F.col("mine") > F.col("other")).cast("int").alias("side"))
    units = whole.unionByName(split)
    # The texts of the candidates only, turned into sets again where they are met.
    texts = (doc_key(docs).withColumn("th", F.xxhash64("body"))
             .join(sets.join(placed.select(F.col("id").alias("set")), "set").select("set", F.col("rep").alias("did"), F.col("rep_th").alias("th"), "bands"), ["did", "th"])
             .dropDuplicates(["set"]).select("set", "body", "bands"))

    def to_sets(batch: pa.RecordBatch):
        grams = [s.astype("<u8").tobytes() for s in gram_sets(batch.column("body"), n)]
        yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(grams, pa.binary()), batch.column("bands")], ["set", "grams", "bands"])

    full = stored(map_batches(texts, lambda: to_sets, "set long, grams binary, bands binary"), "join-grams")
    shipped = full.join(units, full["set"] == units["id"]).select("unit", "band", "i", "j", "side", "set", "grams", "bands")

    def meet(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("set").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, side = table.column("set").to_numpy(), table.column("side").to_numpy()
        grams = [np.frombuffer(b, "<u8") for b in table.column("grams").to_pylist()]
        signs = np.array([np.frombuffer(b, "<u8") for b in table.column("bands").to_pylist()])
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        left = right = np.arange(len(ids))
        if i != j:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"rep": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "whole": pa.array([], pa.bool_())})
        link = verified(grams, signs, left, right, None if band < 0 else band, exact)
        if i == j:
            np.fill_diagonal(link, False)
            links = link.sum(1)
        else:
            links = np.zeros(len(ids), np.int64)
            links[left], links[right] = link.sum(1), link.sum(0)
        root = roots(link, left, right, len(ids))
        some = np.flatnonzero(links)
        return pa.table({"rep": pa.array(ids[some]), "n_links": pa.array(links[some].astype(np.int64)), "root": pa.array(ids[root[some]]),
                         "whole": pa.array(np.full(len(some), band < 0))})

    met = stored(shipped.groupBy("unit", "band", "i", "j").applyInArrow(meet, UNIT_SCHEMA), "join-links")
    links = met.groupBy(F.col("rep").alias("set")).agg(F.sum("n_links").alias("n_links"))
    edges = met.where("not whole and rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))
    parts_of = met.where("whole").select(F.col("rep").alias("set"), "root")
    if not edges.isEmpty():
        parts_of = parts_of.union(components(edges).select(F.col("id").alias("set"), "root"))
    grouped = (sets.drop("bands", "rep_th").join(links, "set", "left").join(parts_of, "set", "left")
               .withColumn("root", F.coalesce("root", "set")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))))
    # Different sets differ in these numbers, so the least of a class is its own, and the same in every run.
    least = F.min(F.struct(*same))
    lowest = grouped.groupBy("root").agg(F.min("rep").alias("class"), least.alias("least"))
    key = F.concat_ws("-", F.lower(F.hex("least.fa")), F.lower(F.hex("least.fb")), F.col("least.n_grams"))
    known = stored(grouped.join(lowest, "root").select(*same, "class", key.alias("class_key"), "n_links", "n_rows"), "join-classes")
    return rows_.select("did", "th", *same).join(known, same).select("did", "th", "class", "class_key", "n_links", (F.col("n_rows") - 1).alias("n_copies"))


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies, class_key`` of every row; classes of repeated or null ids may share ``class_id``, not ``class_key``."""
    return near_classes(docs, **options).select(public_id().alias("doc_id"), public_id("class").alias("class_id"), "n_links", "n_copies", "class_key")


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: the one with the smallest id, of equal ones that with the smallest text hash, then any."""
    classes = near_classes(docs, **options)
    did, th = free_name(docs, "_did"), free_name(docs, "_th")
    first = classes.groupBy("class_key").agg(F.min(F.struct("did", "th")).alias("first"))
    first = first.select(F.col("first.did").alias("first_did"), F.col("first.th").alias("first_th")).alias("f")
    keyed = (docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
             .withColumn(th, F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = keyed.join(first, (keyed[did] == F.col("f.first_did")) & (keyed[th] == F.col("f.first_th")), "left_semi")
    return kept.dropDuplicates([did, th]).select(*(F.col(f"`{c}`") for c in docs.columns))
