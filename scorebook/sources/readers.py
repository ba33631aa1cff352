"""Readers: JSON rankings, raw pages, stored tables, and report streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions.clean import collapse_whitespace, format_record, store_decimal
from scorebook.schemas import DEFAULT_SEASON, RANKING_PAYLOAD, RAW_PAGES


def ranking_rows(payload: DataFrame, season: int | Column, as_of: Column) -> DataFrame:
    """Parsed ranking objects to rows of the rankings table."""
    season = season if isinstance(season, Column) else F.lit(season)
    return payload.select(
        season.cast("int").alias("season"),
        F.col("ranking").alias("rank_position"),
        collapse_whitespace("name").alias("team_name"),
        format_record("wins", "losses").alias("record"),
        "wins", "losses",
        *[store_decimal(c, 3).alias(c) for c in ("rating", "agd", "sched")],
        as_of.alias("scraped_at"),
    )


def read_json_rankings(spark: SparkSession, path: str, season: int = DEFAULT_SEASON,
                       as_of: Column | None = None, multi_line: bool = True) -> DataFrame:
    """JSON array files of ranking objects: one array per file, or per line.

    What cannot be read is in ``rejected_json_rankings``.
    """
    stamp = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    return ranking_rows(_raw_rankings(spark, path, multi_line).filter(F.col("_corrupt_record").isNull()), season, stamp)


def rejected_json_rankings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The records of the same files that are no ranking objects: ``file, record``."""
    raw = _raw_rankings(spark, path, multi_line)
    # Spark reads this column only together with a data column; that one adds nothing here.
    nothing = F.repeat(F.coalesce(F.col("name"), F.lit("")), F.lit(0))
    return raw.filter(F.col("_corrupt_record").isNotNull()).select(
        F.col("_metadata.file_name").alias("file"), F.concat("_corrupt_record", nothing).alias("record"))


def _raw_rankings(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([*RANKING_PAYLOAD.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def rankings_from_text(df: DataFrame, text_col: str, season: int | Column, as_of: Column) -> DataFrame:
    """Same rows from a text column that holds one JSON array per row; ``rejected_texts`` has the others."""
    objects = F.from_json(F.col(text_col), T.ArrayType(RANKING_PAYLOAD))
    return ranking_rows(df.select(*df.columns, F.explode(objects).alias("_o")).select(*df.columns, "_o.*"),
                        season, as_of)


def rejected_texts(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text is no JSON array of ranking objects."""
    return df.filter(F.from_json(F.col(text_col), T.ArrayType(RANKING_PAYLOAD)).isNull())


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Table of raw pages, one row per page; a folder of .html files works too."""
    if path.endswith((".html", "/*")):
        files = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
        return files.select(F.xxhash64("url").alias("page_id"), "url", "html")
    return spark.read.schema(RAW_PAGES).parquet(path)


def read_table(spark: SparkSession, directory: str, name: str, columns: list[str] | None = None,
               where: Column | None = None) -> DataFrame:
    """Stored table with projection and filter, both of which reach the scan."""
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Query pushed to a database through a JDBC driver on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def read_table_stream(spark: SparkSession, directory: str, schema: T.StructType,
                      files: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def spread(df: DataFrame, *keys: str, rows_per_task: int = 50_000) -> DataFrame:
    """Share rows out over the cores, at most about ``rows_per_task`` to a task.

    For row-by-row work that costs far more than moving the row (parsing pages). The splits of a
    scan say little here: a file with one row group has many, and one of them holds all its rows.
    The rows of a stored table are counted from its footers.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task)), *keys)
