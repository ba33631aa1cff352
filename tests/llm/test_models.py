"""Quality classifier, packing, the pipeline, and what is registered."""

import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from scorebook.llm import packing, quality, queries
from scorebook.llm.wordarrays import chunks
from scorebook.plans.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark, prose):
    """Good prose, and two kinds of bad one: rude words, and one word over and over."""
    r = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(900):
        words, bad = prose(i, int(r.integers(20, 80))).split(), i % 5
        if bad == 0:
            words[int(r.integers(0, len(words)))] = ["dreck", "mist", "blöd"][i % 3]
        if bad == 1 and i % 10 == 1:
            words = [w for w in words[:6] for _ in range(10)]
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(not (bad == 1 and i % 10 == 1)), int(bad == 0)))
    return docs, labels


def is_good(i):
    return i % 5 != 0 and i % 10 != 1


def test_quality_on_held_out_documents(spark, frame, labelled):
    docs, labels = labelled
    kept, gone = quality.classify(frame(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ids, lost = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in gone.select("doc_id").collect()}
    assert len(ids) + len(lost) == len(docs) and not ids & lost
    held_out = [i for i in range(900) if i % 3 == 0]
    good = [i in ids for i in held_out if is_good(i)]
    bad = [i in ids for i in held_out if not is_good(i)]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_quality_edges(spark, frame, labelled):
    docs, labels = labelled
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = [(1, None), (2, ""), (None, "x"), (3, "…"), (3, "…"), (4, "long words " * 50_000)]
    kept, gone = quality.classify(frame(odd), none)
    assert kept.count() == 6 and gone.count() == 0
    some = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 1), (6, 0, None), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    kept, gone = quality.classify(frame(docs[:300] + odd), some)
    assert kept.count() + gone.count() == 306
    kept, gone = quality.classify(frame([]), some)
    assert kept.count() == gone.count() == 0


def plain_ngrams(text):
    """The n-grams of a text, by the definition, for ASCII letters and any other bytes."""
    out, counts = set(), Counter()
    words = list(re.finditer("[A-Za-z]+", text))
    for w in words:
        out |= {("word", w[0].lower())} | {(k, w[0].lower()[:k]) for k in (4, 5, 6) if len(w[0]) > k}
    for run in re.findall("[^A-Za-z]+", text):
        counts.update([("pair", run[i: i + 2]) for i in range(len(run) - 1)] or [("one", run)])

    def shape(i):
        w = words[i][0]
        again = i > 0 and words[i - 1][0].lower() == w.lower()
        return (2 if w.isupper() and len(w) > 1 else 1 if w[0].isupper() else 0) + 3 * again
    counts.update(("shape", shape(i), shape(i + 1), shape(i + 2)) for i in range(len(words) - 2))
    return out | {(g, p) for g, n in counts.items() for p in range(n.bit_length())}


def test_every_byte_is_in_some_ngram():
    import pyarrow as pa

    from scorebook.llm.wordarrays import chunks
    texts = ["Plain words, and MORE words words.", "12 34 5678 90" * 40, "#!§$%"[:2] + "()" * 30, "", "x", "  lead and trail  ", "a1b2c3", ";"]
    sets = [plain_ngrams(t) for t in texts]
    got = {}
    for chunk in chunks(pa.array(texts, pa.large_string())):
        doc, bucket = quality.features(chunk)
        for i in range(chunk.n):
            got[chunk.first + i] = set(bucket[doc == i].tolist())
    names = {}
    assert [len(got.get(i, ())) for i in range(len(texts))] == [len(s) for s in sets]
    # Equal n-grams meet in equal buckets, different ones in different: the overlaps agree too.
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(got.get(i, set()) & got.get(j, set())) == len(a & b), (i, j, names)


def test_counts_and_weights_against_a_plain_version(spark, labelled):
    import math

    docs, labels = labelled
    docs = [(i, t.encode("ascii", "ignore").decode()) for i, t in docs[:300]]
    good = {i for i, q, t in labels if q == 1 and t == 0 and i < 300}
    bad = {i for i, q, t in labels if not (q == 1 and t == 0) and i < 300}
    target, against, raw = Counter(), Counter(), Counter()
    for i, t in docs:
        for g in plain_ngrams(t):
            raw[g] += 1
            target[g] += i in good
            against[g] += i in bad

    def median(part, of):
        some = sorted((part[g] / of[g], of[g]) for g in raw if of[g])
        half, seen = sum(n for _, n in some) / 2, 0
        for share, n in some:
            seen += n
            if seen >= half:
                return share
    labelled_ = Counter({g: target[g] + against[g] for g in raw})
    share, usual = min(max(median(target, labelled_), 0.01), 0.99), median(target, raw)
    ratio = {}
    for g in raw:
        log = math.log((target[g] + 0.5) / (raw[g] * usual + 0.5))
        n = labelled_[g]
        dev = 2 * sum(x * math.log(x / (n * p)) for x, p in ((target[g], share), (against[g], 1 - share)) if x)
        e = raw[g] * usual
        dev += max(0, 2 * ((target[g] * math.log(target[g] / e) if target[g] else 0) - target[g] + e) - 16)
        same = not n or (target[g] > n * share) == (log > 0)
        ratio[g] = log * max(0, 1 - 6 / dev) if same and dev > 0 else 0.0
    mean = sum(ratio[g] * target[g] for g in raw) / sum(target.values())
    want = {i: sum(ratio[g] - mean for g in plain_ngrams(t)) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.log_weight for r in quality.weigh(df, model).collect()}
    off = [abs(got[i] - want[i]) for i in got]
    assert np.median(off) < 0.02 and np.quantile(off, 0.95) < 0.5  # a few n-grams share buckets
    assert min(want.values()) < -3


def test_kth_greatest(spark):
    r = np.random.default_rng(3)
    keys = [int(x) for x in r.integers(-2**46, 2**46, 500)] + [5] * 40 + [-(2**20) + 1, 2**33, 2**33 + 1]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 250, 280, len(keys)):
        assert quality.kth_greatest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_gumbel_keys_sample_by_weight(spark):
    """Of equal pairs of weight 3 and 1, the greater key belongs to weight 3 in about three quarters."""
    u = (F.shiftrightunsigned(F.xxhash64("id", "t", F.lit(1)), 12) + F.lit(0.5)) / F.lit(2.0**52)
    key = F.log(F.col("w")) - F.log(-F.log(u))
    df = spark.range(20_000).select((F.col("id") % 2 * 2 + 1).alias("w"), F.floor(F.col("id") / 2).alias("pair"), "id", F.lit("t").alias("t"))
    won = df.select("pair", "w", key.alias("key")).groupBy("pair").agg(F.max_by("w", "key").alias("w")).where("w = 3").count()
    assert 0.73 < won / 10_000 < 0.77


def test_word_tokenizer_gives_the_ids_of_whole_texts(spark, prose):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    texts = [prose(1, 300), "It's WE'LL don't 12,345.67 e-mail@x.org!!! naïve Straße ÀÉ ²½ ŉ", "İstanbul ΣΊΣΥΦΟΣ ΟΔΟΣ 日本語テキスト emoji 👍🏽 á é​", "<|endoftext|> a<|startoftext|>b",
             "tab\tnew\nline\x0b\x0c\r x y z \x1c\x85end", "", "   ", None, "x" * 30_000, "ﬁ ½ Ⅷ ꜰ ª º ß ẞ K", "ȺȾ ƁƆ Ʉ Ÿ ſt ŉ ǅ " + "".join(map(chr, range(0xA1, 0x250)))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = defaultdict(list)
    for r in packing.tokenized(docs, queries.tokenizer_path(), 100).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[i]) == [(p, 100 * p, len(ids[100 * p: 100 * p + 100]), zlib.crc32(ids[100 * p: 100 * p + 100].tobytes())) for p in range(-(-len(ids) // 100))]


@pytest.fixture(scope="module")
def word_tokenizer():
    return packing.WordTokenizer(queries.tokenizer_path())


def encoded(tok, texts):
    chunk, = chunks(pa.array(texts, pa.string()), 1 << 24)
    ids, doc = tok.encode(chunk)
    return [ids[a:b].tolist() for a, b in zip(doc, doc[1:])]


def test_ids_of_random_texts(word_tokenizer):
    """Contractions, digits, two-byte letters and odd characters, in every order, against the library."""
    r = np.random.default_rng(7)
    plain = [*"aSt'<>.,-01²¾µßÄÉŸŉſÿ×«\u00ad ", "'s", "'T", "'re", "'VE", "'m", "'ll", "'d", "''s", "'l", "word", "  "]
    other = [*"|\u0301\u0085\u00a0\u0130\u0663日K\x00\x1c\n", "<|endoftext|>"]
    some = ["".join(r.choice(kinds, int(r.integers(0, 12)))) for kinds in (plain, plain + other) for _ in range(3000)]
    texts = [*some, "it's", "s", "'", "re", "'r", "e", "", "<", "|", "é", None]
    want = [[*word_tokenizer.whole.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts]
    assert encoded(word_tokenizer, texts) == want
    assert encoded(word_tokenizer, texts) == want  # all of them known now


def test_new_words_take_no_call_each(word_tokenizer):
    texts = [" ".join(f"{a}{b}{c}-{a}{d}'s" for b in "bcdfglmn" for c in "aeiou" for d in "xyz") for a in ["sch", "tr", "Pf", "é", "ü"] * 2]
    encoded(word_tokenizer, ["imports and tables of the first call"])
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = encoded(word_tokenizer, texts)
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 600  # there are 600 distinct words
    assert got == [[*word_tokenizer.whole.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]


def test_forgotten_parts_are_learnt_again(word_tokenizer, monkeypatch):
    texts = [f"alpha beta{i} gamma's {'δ' * (i % 3)}" for i in range(50)]
    want = encoded(word_tokenizer, texts)
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "MERGED", 2)
    assert [encoded(word_tokenizer, texts[i: i + 5]) for i in range(0, 50, 5)] == [want[i: i + 5] for i in range(0, 50, 5)]
    assert len(word_tokenizer.known) < 20


@pytest.mark.parametrize("capacity,bins", [(4096, 64), (256, 64), (64, 16)])
def test_packing(spark, frame, corpus, capacity, bins):
    rows = packing.best_fit_packing(frame(corpus + [(i, "same text") for i in range(500)]), queries.tokenizer_path(), capacity, bins).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = []  # first fit, longest first
    for length in sorted((r.length for r in rows), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= length), None)
        if at is None:
            rooms.append(capacity - length)
        else:
            rooms[at] -= length
    assert -(-sum(r.length for r in rows) // capacity) <= len(by) <= len(rooms)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter([i for i, _ in corpus] + list(range(500)))
    assert packing.best_fit_packing(frame([]), queries.tokenizer_path()).count() == 0


def test_plan_uses_the_histogram_exactly():
    r = np.random.default_rng(4)
    for _ in range(5):
        histogram = Counter(np.minimum(4096, r.lognormal(6.5, 1.2, 3000).astype(int) + 1).tolist()) + Counter({17: 2000})
        kinds = packing.plan(dict(histogram))
        used = Counter()
        for kind, n in kinds:
            assert sum(kind) <= 4096 and n > 0
            for length in kind:
                used[length] += n
        assert used == histogram
        total = sum(k * v for k, v in histogram.items())
        assert sum(n for _, n in kinds) <= 1.005 * total / 4096 + 1


def test_nnls():
    r = np.random.default_rng(5)
    a, x = r.random((30, 12)), np.maximum(0, r.normal(0, 1, 12))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert (packing.nnls(a, -np.ones(30)) == 0).all()


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    line = compare(spark, connect(SF), name, queries.QUERIES[name], queries.SQL.get(name), SF)
    assert line.startswith("ok") and "TYPES" not in line, line


def test_pipeline(spark):
    """Each stage against what it says of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    good = stages["quality classifier"](spark, docs, SF).cache()
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.kept_ids(docs, labels).collect()}
    one = stages["n-gram Jaccard join"](spark, good, SF).cache()
    sets = defaultdict(list)
    for r in good.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        sets[frozenset(tuple(w[j: j + 5]) for j in range(max(1, len(w) - 4)))].append(r.doc_id)
    left = {r.doc_id for r in one.collect()}
    for s, ids in sets.items():
        linked = [i for t, other in sets.items() if 5 * len(s & t) >= 4 * len(s | t) for i in other]
        assert len(left & set(ids)) <= 1 and (left & set(linked) or len(linked) > 2)
    clear = stages["benchmark decontamination"](spark, one, SF).cache()
    from scorebook.llm import decontaminate
    flagged = {r.doc_id for r in decontaminate.report(one, benchmark).where("contaminated").collect()}
    assert {r.doc_id for r in clear.collect()} == left - flagged
    masked = stages["secret scans"](spark, clear, SF).cache()
    assert masked.columns == docs.columns and masked.count() == clear.count()
    from scorebook.llm import secret_scan
    assert not any(secret_scan.base_spans(r.text or "") for r in masked.collect())
    pieces = stages["best-fit packing"](spark, masked, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in masked.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
