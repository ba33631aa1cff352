"""Jaccard join, decontamination and top-k search against all pairs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorebook.llm import decontaminate, jaccard_join, topk_search

CUT = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = CUT.findall(text or "")
    return frozenset(tuple(w[j: j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    low = lambda i: float("-inf") if i is None else i
    sets = defaultdict(list)
    for i, t in rows:
        sets[grams(t)].append(low(i))
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for x, a in enumerate(keys):
        for b in keys[:x]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    smallest = defaultdict(list)
    for k in keys:
        smallest[find(k)] += sets[k]
    back = lambda v: None if v == float("-inf") else v
    return (Counter((i, back(min(smallest[find(grams(t))])), links[grams(t)], len(sets[grams(t)]) - 1) for i, t in rows),
            Counter(back(min(ids)) for ids in smallest.values() if ids))


@pytest.fixture(scope="module")
def near(prose, corpus):
    """A group of near copies, each with another word changed, and a chain."""
    words, out = prose(50, 150).split(), []
    for k in range(40):
        w = list(words)
        w[3 * k] = f"changed{k}"
        out.append((1000 + k, " ".join(w)))
    chain = prose(51, 100).split()
    for k in range(8):
        chain = chain[4:] + prose(60 + k, 4).split()
        out.append((1100 + k, " ".join(chain)))
    return corpus + out


@pytest.mark.parametrize("options", [{}, {"unit_docs": 7}, {"unit_grams": 900}])
def test_jaccard_join(frame, near, options):
    got = jaccard_join.report(frame(near), **options).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_classes(near)[0]
    keys = defaultdict(set)
    for r in got:
        keys[r.class_key].add(r.class_id)
    assert all(len(ids) == 1 for ids in keys.values()) and len(keys) == sum(brute_classes(near)[1].values())


def test_bands_reach_the_target():
    bands = jaccard_join.bands_for(0.999995, 0.8, 4)
    assert 1 - (1 - 0.8**4) ** bands >= 0.999995 > 1 - (1 - 0.8**4) ** (bands - 1)


def test_one_of_each_class_stays(frame, near):
    docs = frame(near)
    kept = jaccard_join.drop_near(docs)
    assert kept.columns == docs.columns
    # One document of each class, under the smallest id of the class.
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == brute_classes(near)[1]


@pytest.mark.parametrize("doc_id", [None, 5])
def test_unlike_rows_with_one_id_stay(frame, prose, doc_id):
    docs = [(doc_id, prose(300 + i, 30)) for i in range(1000)]
    kept = jaccard_join.drop_near(frame(docs + docs[:10] + [(doc_id, docs[0][1] + " end")]))
    assert Counter(r.text for r in kept.collect()).keys() <= {t for _, t in docs} | {docs[0][1] + " end"} and kept.count() == 1000


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)], "u long, v long")
    assert {r.id: r.root for r in jaccard_join.components(edges).collect()} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def brute_hits(docs, items, length=13):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: cut.findall((t or "").translate(lower))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(length, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j: j + n])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = Counter()
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j: j + n]) in windows:
                    hit.update(range(j, j + n))
                    names |= windows[tuple(w[j: j + n])]
        out[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, frame, corpus, prose, short):
    items = [(1, prose(2, 60)), (2, prose(3, 200)[200:320].upper()), (2, prose(3, 40)), (None, prose(5, 30)), (4, None), (5, ""), (6, prose(90, 50)), (7, prose(2, 13))]
    if short:
        items += [(8, "one, two"), (9, "baba baba baba"), (10, prose(8, 12))]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, w int")
    got = decontaminate.report(frame(corpus), benchmark)
    expected = brute_hits(corpus, items)
    assert Counter(tuple(r) for r in got.collect()) == expected
    clean = decontaminate.drop_contaminated(frame(corpus), benchmark)
    assert Counter(r.doc_id for r in clean.collect()) == Counter({i: n for i, n in sum((Counter({k[0]: v}) for k, v in expected.items() if not k[-1]), Counter()).items()})


def test_decontamination_runs_no_python(spark, frame, corpus, prose):
    benchmark = spark.createDataFrame([(1, prose(2, 60))], "item_id long, text string")
    plan = decontaminate.report(frame(corpus, extra=False), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_decontamination_of_empty_tables(spark, frame, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.report(frame(corpus), none).collect()} == {0}
    assert decontaminate.report(frame([]), none).count() == 0


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    rows = [(i, r.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)] + [(20, [1.0] * 8), (7, rows[7][1]), (2000, [0.5] * 3), (2020, [0.25, 1.0, 2.0])]
    rows += [(3000, None), (3020, [None] * 8), (3040, [float("nan")] * 8), (3060, [float("inf")] * 8), (None, [1.0] * 8), (3080, []), (4000, [3e30] * 8)]
    return rows


def brute_top(rows, k):
    good = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = Counter()
    for i, v in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        found = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in good if j != i and len(w) == len(v))[:k]
        out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(found))
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 50, "query_rows": 9}, {"n_pivots": 4, "sample": 30}])
def test_top_k(spark, vectors, options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, rank int, vid int")
    got = topk_search.top_k(df, F.col("vid") % 20 == 0, k=20, **options)
    assert Counter(tuple(r) for r in got.collect()) == brute_top(vectors, 20)


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vid") % 20 == 0).count() == 0
