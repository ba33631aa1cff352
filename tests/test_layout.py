import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorebook.operators import records
from scorebook.sources import layout

LIMIT = "spark.sql.autoBroadcastJoinThreshold"
PUSHDOWN = "spark.sql.parquet.filterPushdown"


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "-1")
    yield
    spark.conf.set(LIMIT, before)


@pytest.fixture()
def save(spark, tmp_path):
    made = []

    def write(df, keys, buckets=4, **options):
        made.append(f"t_{uuid.uuid4().hex}")
        return layout.save_bucketed(df, made[-1], str(tmp_path / made[-1]), buckets, keys, **options)

    yield write
    for name in made:
        layout.drop_bucketed(spark, name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark):
    seasons = spark.range(400).select(
        (F.col("id") % 100).alias("team_id"), (F.col("id") % 4 + 2020).cast("int").alias("season"), F.lit("c").alias("conference"),
        F.lit(0).cast("long").alias("wins"), F.lit(0).cast("long").alias("losses"), F.lit(None).cast("timestamp_ntz").alias("wl_computed_at"))
    record = spark.range(200).select((F.col("id") % 100).alias("team_id"), F.lit(2021).alias("season"),
                                     F.col("id").alias("wins"), (F.col("id") * 2).alias("losses")).dropDuplicates(["team_id"])
    return seasons.dropDuplicates(["team_id", "season"]), record


def test_joins_and_groups_need_no_exchange(spark, rows, save, no_broadcast):
    seasons, record = sides(spark)
    key, now = ["team_id", "season"], F.lit("2026-05-01").cast("timestamp_ntz")
    plain = records.refresh_record(seasons, record, now)
    stored = records.refresh_record(save(seasons, key), save(record, key), now)
    assert "Exchange" in plan(plain) and "Exchange" not in plan(stored)
    assert rows(plain) == rows(stored)
    grouped = save(seasons, key).groupBy(*key).agg(F.count("*").alias("n"))
    assert "Exchange" not in plan(grouped) and grouped.count() == 100


def test_a_filter_on_the_key_reads_one_bucket(spark, rows, save):
    seasons, _ = sides(spark)
    stored = save(seasons, ["team_id"], buckets=8)
    one = stored.filter("team_id = 7")
    # Without the filters inside Parquet, the scan gives all rows of the files it opens.
    spark.conf.set(PUSHDOWN, "false")
    try:
        execution = one._jdf.queryExecution()
        execution.executedPlan().executeCollectPublic()
    finally:
        spark.conf.unset(PUSHDOWN)
    scanned = execution.executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert 1 <= scanned == stored.filter(F.pmod(F.hash("team_id"), F.lit(8)) == F.pmod(F.hash(F.lit(7).cast("long")), F.lit(8))).count() < 100
    assert rows(one) == rows(seasons.filter("team_id = 7"))


def test_files_and_null_keys(spark, rows, save, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)] + [("hot", i) for i in range(200)], "k string, v int")
    stored = save(df, ["k"], buckets=4, files_per_bucket=3)
    assert rows(stored) == rows(df)
    assert rows(stored.groupBy("k").count()) == rows(df.groupBy("k").count())
    # A hot key's bucket is written by several tasks, and no bucket has more files than said.
    per_bucket = {}
    for file in next(tmp_path.iterdir()).glob("*.parquet"):
        bucket = file.name.split("_")[-1].split(".")[0]
        per_bucket[bucket] = per_bucket.get(bucket, 0) + 1
    assert max(per_bucket.values()) == 3


def test_a_bucket_too_large_is_refused_before_anything_is_written(spark, save, tmp_path):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1)], "k string, v int")
    assert layout.widest_bucket(df, 1, ["k"]) == 51 and layout.widest_bucket(df.limit(0), 4, ["k"]) == 0
    with pytest.raises(ValueError, match="over 20"):
        save(df, ["k"], rows_per_bucket=20)
    assert not list(Path(tmp_path).iterdir())
    assert save(df.limit(0), ["k"]).count() == 0
