"""Work that is shared out by the rows there are, and texts read without a look at every character."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scorebook.functions import clean, html
from scorebook.plans import adapters as ad
from scorebook.session import shuffle_slots
from scorebook.sources import layout
from scorebook.sources.readers import spread
from scorebook.streaming import live

SLOTS = "spark.sql.shuffle.partitions"


def filled(df):
    return df.groupBy(F.spark_partition_id()).count().collect()


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    path, size = str(tmp_path / "t.parquet"), "spark.sql.files.maxPartitionBytes"
    spark.range(4000).coalesce(1).write.parquet(path)
    before = spark.conf.get(size)
    spark.conf.set(size, "1000b")
    try:
        stored = spark.read.parquet(path)
        assert stored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and len(filled(stored)) == 1
        assert len(filled(spread(stored, "id"))) == spark.sparkContext.defaultParallelism
        assert len(filled(spread(stored, "id", rows_per_task=200))) == 20
    finally:
        spark.conf.set(size, before)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\x0b", "\f", "\r", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"])
def test_trimming_looks_at_the_ends_only(spark, blank):
    assert "regexp" not in str(clean.strip_space("x"))
    text = spark.createDataFrame([(f"{blank} a{blank}{blank} b {blank}",), (blank * 3,), (f"a{blank}\u200b",)], "x string")
    got = text.select(clean.strip_space("x").alias("s"), clean.collapse_whitespace("x").alias("c")).collect()
    assert [tuple(r) for r in got] == [(f"a{blank}{blank} b", "a b"), ("", ""), (f"a{blank}\u200b", "a \u200b")]


@pytest.mark.parametrize("page,regular", [
    ("<table><tr><td>a</td></tr></table>", True), ("<TABLE><TR><td>a</TD></tr></table>", True), ("<table><tr><td>a</tr></table>", False),
    ("<table><tablet><table><tr><td>a</td></tr></table>", False), ("<table></table><table><tr><td>&eacute;</td></tr></table>", False),
    ("&eacute;<table><tr><td>a</td></tr></table>", True), ("<tr><td class=x>a</td></tr>", False), ("<tr><td>a</td></tr><script>", False)])
def test_regular_pages(spark, page, regular):
    assert spark.createDataFrame([(page,)], "x string").select(html.is_flat(F.col("x"))).first()[0] is regular


def test_elements_end_at_their_first_end_tag(spark):
    text = "<td>a</td ><TD class='x'>b<br></tdx>\n</td></td><td>open"
    assert spark.createDataFrame([(text,)], "x string").select(html.cells(F.col("x"))).first()[0] == ["<td>a</td >", "<TD class='x'>b<br></tdx>\n</td>"]


@pytest.mark.parametrize("rows_per_chunk", [3, 40, 10_000])
def test_rate_limit_of_many_keys(spark, rows_per_chunk):
    # Keys of 1 to 79 reports, one of them null, over several Arrow batches.
    start, size = datetime(2024, 1, 1), "spark.sql.execution.arrow.maxRecordsPerBatch"
    data = [(k or None, start + timedelta(seconds=i * 7 % 100), 1000 * k + i) for k in range(0, 80) for i in range(k or 50)]
    expected = set()
    for k in range(0, 80):
        last = None
        for _, ts, ident in sorted((r for r in data if r[0] == (k or None)), key=lambda r: r[1:]):
            if last is None or ts >= last + timedelta(seconds=30):
                expected.add(ident)
                last = ts
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        df = live.rate_limit(spark.createDataFrame(data, "reporter_id long, ts timestamp_ntz, event_id long"), 30, ("reporter_id",), rows_per_chunk)
        assert {r.event_id for r in df.collect()} == expected
        # No Python call per key where no key is large.
        assert ("FlatMap" in df._jdf.queryExecution().executedPlan().toString()) == (rows_per_chunk < 100)
    finally:
        spark.conf.set(size, before)


def test_shuffle_slots_hold_inside_only(spark):
    before = spark.conf.get(SLOTS)
    with pytest.raises(ZeroDivisionError), shuffle_slots(spark, 77):
        assert spark.conf.get(SLOTS) == "77"
        1 / 0
    assert spark.conf.get(SLOTS) == before
    with shuffle_slots(spark, 1):
        assert spark.conf.get(SLOTS) == before


def test_slots_grow_with_the_games(spark, tmp_path):
    spark.range(1001).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert ad.game_slots(spark, str(tmp_path), 100) == 11 and ad.game_slots(spark, str(tmp_path)) == 1


def test_large_buckets_are_written_as_several_files(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 10).alias("team_id"), "id")
    stored = layout.save_bucketed(df, "t_large_buckets", str(tmp_path / "t"), 2, ["team_id"], rows_per_file=100)
    try:
        assert len(list((tmp_path / "t").glob("*.parquet"))) >= 8
        assert stored.filter("team_id = 3").count() == 100 and stored.count() == 1000
    finally:
        layout.drop_bucketed(spark, "t_large_buckets")
