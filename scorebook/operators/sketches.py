"""Counts kept per load as sketches that merge without the rows.

A load leaves one row per group: its number of rows, a HyperLogLog sketch for each distinct count and a frequent-items sketch for each
histogram. Rows of many loads are merged to any coarser grouping, so a report over all loads reads kilobytes per load and none of the
loaded rows. Sketches are built with partial aggregation before the shuffle, so a group with most of the rows costs one sketch per map
task. The exact forms are in ``records``.

Distinct counts have a relative standard error of ``distinct_error(lg_k)``. A frequent value's count is at least its true one and exceeds
it by at most ``rows * frequent_error(tracked)``; while a group has no more than ``tracked`` values, counts are exact. Null is no value
for either; an empty load leaves no row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.clean import ordered_pair


def distinct_error(lg_k: int) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / (1 << lg_k) ** 0.5


def frequent_error(tracked: int) -> float:
    """Share of a group's rows by which a frequent value's count may be too high."""
    # The sketch's map holds the next power of two over tracked / 0.75 entries, and loses at most 3.5 rows of that many.
    return 3.5 / (1 << (int(tracked / 0.75) - 1).bit_length())


def matchup_key(a: Column | str, b: Column | str, date: str) -> Column:
    """A matchup as one number for sketches; null where a name or the date is missing, as in ``records.distinct_matchups``."""
    low, high = ordered_pair(a, b)
    return F.when(low.isNotNull() & high.isNotNull() & F.col(date).isNotNull(), F.xxhash64(low, high, F.col(date)))


def load_sketches(rows: DataFrame, by: list[str], distinct: Mapping[str, Column] | None = None,
                  frequent: Mapping[str, Column] | None = None, lg_k: int = 12, tracked: int = 1000) -> DataFrame:
    """``by``, ``n_rows`` and one sketch column per name in ``distinct`` and ``frequent``."""
    distinct, frequent = dict(distinct or {}), dict(frequent or {})
    taken = {*by, "n_rows"}
    clash = sorted(name for name in [*distinct, *frequent] if name in taken) + sorted(distinct.keys() & frequent.keys())
    if clash:
        raise ValueError(f"names used twice: {', '.join(clash)}")
    # Values get names of their own first: the frequent-items function is reached by SQL text.
    values = {f"_v{i}": column for i, column in enumerate([*distinct.values(), *frequent.values()])}
    lean = rows.select(*by, *[column.alias(name) for name, column in values.items()])
    names = list(values)
    sketches = [F.hll_sketch_agg(v, lg_k).alias(name) for v, name in zip(names, distinct)]
    sketches += [F.expr(f"approx_top_k_accumulate({v}, {tracked}) FILTER (WHERE {v} IS NOT NULL)").alias(name)
                 for v, name in zip(names[len(distinct):], frequent)]
    return lean.groupBy(*by).agg(F.count("*").alias("n_rows"), *sketches)


def merge_sketches(sketches: DataFrame, by: list[str], distinct: list[str] = (), frequent: list[str] = (), tracked: int = 1000) -> DataFrame:
    """The sketches of coarser groups; those of several loads may be united first. ``by`` may be empty."""
    return sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), *[F.hll_union_agg(c).alias(c) for c in distinct],
        *[F.expr(f"approx_top_k_combine(`{c}`, {tracked})").alias(c) for c in frequent])


def distinct_counts(sketches: DataFrame, names: list[str]) -> DataFrame:
    """Sketch columns replaced by their estimates."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in names})


def frequent_values(sketches: DataFrame, by: list[str], name: str, top: int) -> DataFrame:
    """``by, value, occurrences``: the ``top`` most frequent values of each group."""
    best = F.expr(f"approx_top_k_estimate(`{name}`, {top})")
    return sketches.select(*by, F.explode(best).alias("_e")).select(*by, F.col("_e.item").alias("value"), F.col("_e.count").alias("occurrences"))
