"""Ordered computations that stay parallel when one key holds most rows.

A window over ``partitionBy(key)`` puts a hot key into one task. The functions
here cut each key into chunks of its order (a time bucket, a block of
positions): windows run inside a chunk, one summary row per chunk carries the
value across, and only those summaries are ordered per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorebook.session import durable

BROADCAST_ROWS = 100_000  # of a few dozen bytes each


def _with_chunk_carry(df: DataFrame, value: Column, keys: list[str], order: list[str],
                      chunk: Column, frame_end: int, skip_nulls: bool, out: str) -> DataFrame:
    base = df.withColumn("_chunk", chunk).withColumn("_val", F.struct(value.alias("v")))
    seen = F.col("_val.v").isNotNull() if skip_nulls else F.lit(True)
    base = base.withColumn("_val", F.when(seen, F.col("_val")))
    part = [*keys, "_chunk"]
    local = F.last("_val", ignorenulls=True).over(
        W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, frame_end))
    # One row per chunk: its closing value, then the nearest earlier chunk's.
    closing = F.max_by("_val", F.when(F.col("_val").isNotNull(), F.struct(*order)))
    carried = base.groupBy(*part).agg(closing.alias("_last")).select(
        *part, F.last("_last", ignorenulls=True).over(
            W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    return (
        base.withColumn("_local", local)
        .join(carried, part, "left")
        .withColumn(out, F.coalesce("_local", "_carry")["v"])
        .drop("_chunk", "_val", "_local", "_carry")
    )


def previous_value(df: DataFrame, value: Column, keys: list[str], order: list[str],
                   chunk: Column, out: str) -> DataFrame:
    """``lag(value)`` per key in ``order``; ``chunk`` must rise with the order.

    ``order`` and ``keys`` must not be null.
    """
    return _with_chunk_carry(df, value, keys, order, chunk, -1, False, out)


def last_value_so_far(df: DataFrame, value: Column, keys: list[str], order: list[str],
                      chunk: Column, out: str) -> DataFrame:
    """Last non-null value up to and including the row, per key in ``order``."""
    return _with_chunk_carry(df, value, keys, order, chunk, 0, True, out)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys appear once."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(other, match, how).drop(*[f"_k_{k}" for k in keys])


def number_rows(df: DataFrame, order: list[Column], part: list[str] | None = None,
                out: str = "position") -> DataFrame:
    """1, 2, 3, ... in ``order`` (within ``part``) without a one-task window.

    A range-partitioned sort numbers rows inside each sorted partition; the sizes
    of the partitions give the offsets. The sorted rows are written once so that
    sizes and rows come from the same sort.
    ``order`` must be total.
    """
    part = part or []
    keyed = df.orderBy(*[F.col(p).asc_nulls_first() for p in part], *order)
    keyed = durable(keyed.withColumn("_mid", F.monotonically_increasing_id()))
    keyed = keyed.withColumn("_slot", F.shiftright("_mid", 33))
    # One row per sorted partition and part: where the part starts in it, and how
    # many of the part's rows lie in earlier partitions.
    runs = keyed.groupBy("_slot", *part).agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    w = (W.partitionBy(*part) if part else W.partitionBy()).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(F.col("_slot").alias("_s"), "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                       *[F.col(p).alias(f"_p_{p}") for p in part])
    if runs.count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    match = [F.col("_slot") == F.col("_s"), *[F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in part]]
    return keyed.join(runs, match).withColumn(out, F.col("_mid") - F.col("_first") + F.col("_before") + 1).select(
        *df.columns, out)
