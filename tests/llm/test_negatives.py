"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorebook.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, vec int, no int, need int, part int"


def brute(rows, is_anchor, scale=256, n=5, low=80):
    live = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in live if is_anchor(i)}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in live if j != i and len(w) == len(v))
        for p, j, m in [x for x in s if x[2] == lab][:n]:
            some = [(q, k) for q, k, m in s if m != lab and low * -p <= 100 * -q <= 100 * -p][:n]
            out += [(i, j, r, k, -p, -q) for r, (q, k) in enumerate(some, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(8)
    heart = r.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = heart[i % 6] * (1 if i % 3 else 0.3) + r.normal(size=8) * [0.02, 0.3, 2.0][i % 3]
        rows.append((i, int(i % 6 if r.random() < 0.7 else r.integers(0, 6)), [float(x) for x in v]))
    same = [float(x) for x in heart[0]]
    rows += [(2000 + i, i % 2, same) for i in range(60)] + [(2000, 0, same), (2010, 1, [-x for x in same])]
    rows += [(None, 1, same), (3000, None, same), (3010, 1, None), (3020, 1, []), (3030, 1, [None] * 8), (3040, 1, [float("nan")] + same[1:]),
             (3050, 1, [float("inf")] + same[1:]), (-10, 1, same), (4000, 1, [1.0, 2.0]), (4001, 1, [1.0, 2.5]), (4002, 2, [1.0, 2.2]),
             (5000, 3, [0.0] * 8), (5001, 3, [0.0] * 8), (5002, 4, [0.0] * 8), (6000, 77, same)]
    return rows


@pytest.mark.parametrize("anchor_rows,block_rows,clusters", [(512, 16384, 32), (7, 40, 4)])
def test_against_all_pairs(spark, vectors, anchor_rows, block_rows, clusters):
    df = spark.createDataFrame([(*v, 1, 2, 3, 4) for v in vectors], SCHEMA)
    got = hard_negatives.Mined(df, F.col("vid") % 10 == 0, clusters=clusters, anchor_rows=anchor_rows, block_rows=block_rows, sample=200).negatives()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(vectors, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and len(want) > 500


def test_few_rows_and_none(spark):
    schema = "vec_id long, label int, embedding array<double>"
    for rows in ([], [(10, 1, [1.0])], [(10, 1, [1.0]), (11, 1, [1.0])], [(10, 1, [1.0]), (11, 1, [1.0]), (12, 2, [0.9]), (13, 2, [0.1])],
                 [(10, 1, [1e200, 1.0]), (11, 1, [1e200, 0.0]), (12, 2, [1e200, 3.0])]):
        got = hard_negatives.Mined(spark.createDataFrame(rows, schema), F.col("vid") % 10 == 0, scale=1).negatives().drop("pos_rank").collect()
        if rows and max(map(max, (r[2] for r in rows))) < 1e100:
            assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 10 == 0, scale=1)


def test_walk_ends_where_no_row_can_be_needed():
    """A tight cluster leaves most of its list unread, and what it needs is found all the same."""
    r = np.random.default_rng(9)
    a = np.floor(256 * (np.eye(16)[:1] + r.normal(size=(20, 16)) * 0.01))
    x = np.floor(256 * np.concatenate([np.eye(16)[:1] + r.normal(size=(50, 16)) * 0.01, r.normal(size=(20_000, 16)) * 0.3]))
    x = x[r.permutation(len(x))]
    s, seen, found = hard_negatives.products(a, x), set(), set()
    needs = np.sort(s, axis=1)[:, -20].astype(float)

    def allowed(members, rows, scores):
        seen.update(rows.tolist())
        return np.ones(scores.shape, bool)

    def take(m, rows, scores):
        found.update((m, int(i)) for i in rows)
        return needs[m]

    hard_negatives.walk(a, x, np.eye(16)[0], needs, allowed, take, at_once=256)
    assert found == {(m, int(i)) for m, i in zip(*np.nonzero(s >= needs[:, None]))} and len(seen) < len(x) / 4
