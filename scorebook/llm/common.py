"""What the operators share: row keys, stored intermediate results, Arrow batches as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.session import scratch_path, ship_package

#: Stands for a null ``doc_id`` inside an operator, which so counts as the smallest id.
NO_ID = -(2**63)


def doc_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``did`` (the id, null as ``NO_ID``) and ``body`` (the text, null as empty) of every row, nothing else."""
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("did"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))


def public_id(did: str = "did") -> Column:
    return F.when(F.col(did) != NO_ID, F.col(did))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a read of these files, not the work before them, and a
    step whose row order matters gives every later reader the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to Python at once, where the session keeps Spark's default of 10,000: whole texts are long rows.
BATCH_ROWS = "1000"


def with_small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]],
                schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with one worker object per task: ``make()`` returns the function for each batch."""
    ship_package(df.sparkSession)
    with_small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
            del batch
            pa.default_memory_pool().release_unused()  # an idle worker should hold no texts

    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
