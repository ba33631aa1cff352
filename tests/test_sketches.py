import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorebook.operators import records
from scorebook.operators import sketches as sk

LG_K, TRACKED = 10, 64


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(3)
    # A third of all rows lies in one load; a few values are frequent, the others rare.
    return [(rnd.choice([1, rnd.randrange(1, 9)]), f"s{rnd.randrange(60)}" if rnd.random() > 0.01 else None, f"s{rnd.randrange(60)}",
             f"2026-04-{rnd.randrange(1, 31):02d}" if rnd.random() > 0.01 else None,
             rnd.choice(["6:00pm", "7:00pm", f"t{rnd.randrange(3000)}", None])) for _ in range(20_000)]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "load int, a string, b string, day string, clock string").repartition(6)


def sketches(df, by):
    return sk.load_sketches(df, by, {"pairs": sk.matchup_key("a", "b", "day")}, {"clock": F.col("clock")}, LG_K, TRACKED)


def test_merged_loads_say_what_one_load_says_within_the_bounds(table, data):
    loads = sketches(table, ["load"])
    merged = sk.distinct_counts(sk.merge_sketches(loads, [], ["pairs"], ["clock"], TRACKED), ["pairs"])
    exact = records.distinct_matchups(table, "a", "b", "day").first()[0]
    at_once = sk.distinct_counts(sketches(table.withColumn("load", F.lit(0)), ["load"]), ["pairs"]).first()
    row = merged.first()
    assert row.n_rows == at_once.n_rows == len(data)
    for pairs in (row.pairs, at_once.pairs):
        assert abs(pairs - exact) <= 4 * sk.distinct_error(LG_K) * exact
    true = Counter(r[4] for r in data if r[4] is not None)
    slack = sum(true.values()) * sk.frequent_error(TRACKED)
    got = {r.value: r.occurrences for r in sk.frequent_values(
        sk.merge_sketches(loads, [], ["pairs"], ["clock"], TRACKED), [], "clock", 10).collect()}
    assert {"6:00pm", "7:00pm"} <= got.keys()
    assert all(true[v] <= n <= true[v] + slack for v, n in got.items())


def test_loads_kept_apart_merge_as_their_union(table, rows):
    parts = [sketches(table.filter(f"load % 3 = {i}"), ["load"]) for i in range(3)]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    estimate = lambda df: rows(sk.distinct_counts(sk.merge_sketches(df, [], ["pairs"]), ["pairs"]))
    assert estimate(united) == estimate(sketches(table, ["load"]))


def test_few_values_are_counted_exactly_and_nulls_are_none(spark, rows):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (2, "x"), (3, None)], "load int, v string")
    loads = sk.load_sketches(df, ["load"], {"d": F.col("v")}, {"f": F.col("v")})
    merged = sk.merge_sketches(loads, [], ["d"], ["f"])
    assert rows(sk.frequent_values(merged, [], "f", 5)) == [("x", 3), ("y", 1)]
    assert rows(sk.distinct_counts(merged, ["d"]), "n_rows", "d") == [(6, 2)]
    assert rows(sk.distinct_counts(loads, ["d"]), "load", "d") == [(1, 1), (2, 2), (3, 0)]
    assert sk.load_sketches(df.limit(0), ["load"], {"d": F.col("v")}).count() == 0


def test_names_used_twice_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "load int, v string")
    for distinct, frequent in (({"load": F.col("v")}, {}), ({"n_rows": F.col("v")}, {}), ({"d": F.col("v")}, {"d": F.col("v")})):
        with pytest.raises(ValueError, match="used twice"):
            sk.load_sketches(df, ["load"], distinct, frequent)
