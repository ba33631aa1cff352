"""Tables stored in buckets by key, so that joins and groups on the key need no exchange and a filter on it reads one bucket.

Worth its cost for tables that are written once and joined or looked up by the same key many times. A bucket is read by one task where
its layout is used, so the layout is refused where a key (or an unlucky bucket) holds more rows than a task should: choose more key
columns then, or leave the table plain and let adaptive execution split its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def widest_bucket(df: DataFrame, buckets: int, keys: list[str]) -> int:
    """Rows of the largest bucket; reads the key columns only. 0 without rows."""
    per_bucket = df.select(_bucket(buckets, keys).alias("_b")).groupBy("_b").agg(F.count("*").alias("n"))
    return per_bucket.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]  # one number


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: list[str], files_per_bucket: int = 1,
                  rows_per_bucket: int = 50_000_000, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write ``df`` to ``path`` as table ``name``, bucketed and sorted by ``keys``, and return the table.

    Every bucket is ``files_per_bucket`` files, or more where a file would exceed about ``rows_per_file``; with more than one, several
    tasks write a bucket, and a read that relies on its order sorts it again. A ``ValueError`` says where a bucket would exceed ``rows_per_bucket``; nothing is written then. Null keys are one key.
    Both sides of a join must have equal ``buckets`` and be joined on all ``keys``. The table is external: dropping it leaves the files.
    """
    widest = widest_bucket(df, buckets, keys)
    if widest > rows_per_bucket:
        raise ValueError(f"a bucket of {name} would hold {widest} rows, over {rows_per_bucket}")
    files_per_bucket = max(files_per_bucket, -(-widest // rows_per_file))
    rest = [c for c in df.columns if c not in keys] or keys
    # One task for each file: Spark puts rows into buckets by the same hash.
    file = _bucket(buckets, keys) * files_per_bucket + F.pmod(F.xxhash64(*rest), F.lit(files_per_bucket)).cast("int")
    dealt = df.repartitionById(buckets * files_per_bucket, file)
    (dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def deal_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: list[str],
                  then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """``save_bucketed`` without counting and sorting first: ``df`` is computed once and a task writes each bucket. For keys of which none
    holds a large part of the rows. ``then`` may group the dealt rows by ``keys`` and more, which moves nothing more."""
    dealt = then(df.repartition(buckets, *keys))
    dealt.write.mode("overwrite").format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _bucket(buckets: int, keys: list[str]):
    return F.pmod(F.hash(*keys), F.lit(buckets))
