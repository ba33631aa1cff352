"""Data-quality audits.

A *violation* audit returns the offending rows; a *metric* audit returns
``(check, expected, actual, passed)`` rows that ``gate`` can combine.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions.clean import date_prefix, is_iso_midnight, normalize_name
from scorebook.functions.ordered import previous_value
from scorebook.operators.records import pair_appearances
from scorebook.operators.resolve import resolve
from scorebook.operators.reshape import duplicates, stack_counts


def metric(df: DataFrame, check: str, actual: Column, expected: Column | int = 0) -> DataFrame:
    """One-row metric from a (filtered) table: actual against expected."""
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    row = df.agg(actual.cast("long").alias("actual"), expected.cast("long").alias("expected"))
    return row.select(F.lit(check).alias("check"), "expected", "actual",
                      F.col("actual").eqNullSafe(F.col("expected")).alias("passed"))


def count_metric(df: DataFrame, check: str, expected: int = 0) -> DataFrame:
    return metric(df, check, F.count("*"), expected)


def row_count_reconcile(tables: dict[str, DataFrame], baseline: DataFrame) -> DataFrame:
    """Counts per table against a recorded ``(tbl, baseline)``."""
    counts = stack_counts(tables)
    return counts.join(baseline, "tbl", "full_outer").select(
        F.col("tbl").alias("check"), F.col("baseline").alias("expected"), F.col("n").alias("actual"),
        F.col("n").eqNullSafe(F.col("baseline")).alias("passed"))


def normalization_audit(df: DataFrame, col: str) -> DataFrame:
    value = F.col(col)
    norm = normalize_name(col)
    return df.select(
        value.alias("raw_value"), norm.alias("normalized"), F.length(value).alias("raw_len"),
        F.length(norm).alias("norm_len"), F.when(value != norm, "NEEDS_NORM").otherwise("ok").alias("status"))


def null_and_zero_dates(df: DataFrame, col: str) -> DataFrame:
    """Null dates, dates in year 0 and ISO-midnight texts in one pass."""
    day = F.try_to_date(date_prefix(col), "yyyy-MM-dd")
    return df.agg(
        F.count_if(F.col(col).isNull()).alias("null_dates"),
        F.count_if(F.col(col).isNull() | (F.year(day) == 0)).alias("zero_or_invalid_dates"),
        F.count_if(is_iso_midnight(col)).alias("utc_midnight_strings"))


# --- Fixed value: stored clock times look like this and are at most this long.
CLOCK_TIME = r"^(1[0-2]|[1-9]):[0-5][0-9](am|pm)$"
CLOCK_TIME_LENGTH = 8


def time_format_audit(df: DataFrame, col: str) -> DataFrame:
    """Distinct stored times that are not ``H:MMam/pm`` or too long, with counts."""
    odd = ~F.col(col).rlike(CLOCK_TIME) | (F.length(col) > CLOCK_TIME_LENGTH)
    return df.filter(odd).groupBy(F.col(col).alias("stored_value")).agg(F.count("*").alias("occurrences")).select(
        "stored_value", F.length("stored_value").alias("len"), "occurrences")


def decimal_drift(df: DataFrame, columns: list[str], scale: int = 2, tolerance: float = 0.005) -> DataFrame:
    """Per column, how many values lose more than ``tolerance`` in ``decimal(8, scale)``, or do not fit it at all."""
    value = F.col("v.value").cast("double")
    kept = value.try_cast(f"decimal(8,{scale})").cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]))
    return (df.select(each.alias("v")).groupBy(F.col("v.column_name").alias("column_name"))
            .agg(F.count_if(value.isNotNull() & (kept.isNull() | (F.abs(value - kept) > tolerance))).alias("drifted_rows"),
                 F.count(value).alias("checked_rows")))


def orphans(children: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent; references over several columns are named with commas."""
    columns, known = column.split(","), parents.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(parent_key.split(","))])
    match = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]
    return children.dropna(subset=columns).join(known, match, "left_anti")


def missing_children(parents: DataFrame, parent_key: str, children: DataFrame, column: str) -> DataFrame:
    """Parents without the expected child."""
    return parents.join(children.select(F.col(column).alias("_c")), F.col(parent_key) == F.col("_c"), "left_anti")


def unique_key_check(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Number of key values that occur more than once, per table."""
    checks = [count_metric(duplicates(df, keys[name]), f"unique_{name}") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, checks)


def foreign_key_check(tables: dict[str, DataFrame], references: list[tuple]) -> DataFrame:
    """Orphan rows per declared reference between the given tables."""
    checks = [
        count_metric(orphans(tables[child], col, tables[parent], key), f"{child}.{col}->{parent}.{key}")
        for child, col, parent, key, *_ in references if child in tables and parent in tables]
    return reduce(DataFrame.unionByName, checks)


def schema_check(spark: SparkSession, actual: dict[str, DataFrame], expected: dict[str, T.StructType]) -> DataFrame:
    """Declared against actual columns and types of every table, from the schemas alone."""
    listed = [(t, f.name, f.dataType.simpleString()) for t, s in expected.items() for f in s.fields]
    want = spark.createDataFrame(listed, "tbl string, column_name string, expected_type string")

    found = [(t, c, kind) for t, df in actual.items() for c, kind in df.dtypes]
    have = spark.createDataFrame(found, "tbl string, column_name string, actual_type string")
    return want.join(have, ["tbl", "column_name"], "full_outer").withColumn(
        "passed", F.col("expected_type").eqNullSafe(F.col("actual_type")))


def filled_counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """How many rows fill each of the named columns; nothing else is scanned."""
    def one(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
        return counts.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("tbl"), F.lit(c).alias("column_name"), F.col(c).alias("filled_rows")) for c in columns])).alias("p")).select("p.*")

    return reduce(DataFrame.unionByName, [one(t, df, columns) for t, (df, columns) in tables.items()])


def game_count_parity(games: DataFrame, schedule: DataFrame, a: str, b: str, date: str) -> DataFrame:
    """Neutral games against distinct matchups, and the surplus rows that explain a gap."""
    # One grouping: a pair on a date holds few spellings, however many rows it has.
    left, right = normalize_name(a), normalize_name(b)
    matchups = schedule.groupBy(F.least(left, right).alias("_x"), F.greatest(left, right).alias("_y"), F.col(date).alias("_d")).agg(
        (F.count("*") - F.size(F.collect_set(F.struct(F.coalesce(F.col(a), F.lit("")), F.col(a).isNull(), F.coalesce(F.col(b), F.lit("")), F.col(b).isNull()))))
        .alias("surplus"))
    totals = matchups.agg(F.count("*").alias("source_matchups"), F.coalesce(F.sum("surplus"), F.lit(0)).alias("duplicate_rows"), F.lit(0).cast("long").alias("new_games"))
    counted = games.agg(F.lit(0).cast("long").alias("source_matchups"), F.lit(0).cast("long").alias("duplicate_rows"), F.count("*").alias("new_games"))
    return totals.unionByName(counted).agg(*[F.sum(c).alias(c) for c in ("new_games", "source_matchups", "duplicate_rows")]).withColumn(
        "gap", F.col("new_games") - F.col("source_matchups"))


def appearance_arithmetic(schedule: DataFrame, a: str, b: str, date: str) -> DataFrame:
    """Single matchups plus twice the double ones equal the rows."""
    seen = pair_appearances(schedule, normalize_name(a), normalize_name(b), date)
    return seen.agg(
        F.count_if(F.col("appearances") == 1).alias("singles"),
        F.count_if(F.col("appearances") == 2).alias("doubles"),
        F.count_if(F.col("appearances") > 2).alias("more"),
        F.sum("appearances").alias("row_count")).withColumn(
        "passed", F.col("singles") + 2 * F.col("doubles") == F.col("row_count"))


def repeated_matchups(schedule: DataFrame, a: str, b: str, date: str, above: int = 2) -> DataFrame:
    """The matchups seen more than ``above`` times, which the arithmetic cannot explain."""
    return pair_appearances(schedule, normalize_name(a), normalize_name(b), date).filter(F.col("appearances") > above)


def not_computed(team_seasons: DataFrame, teams: DataFrame, state: str = "OR") -> DataFrame:
    local = teams.filter(F.col("state") == state).select("team_id")
    return count_metric(
        team_seasons.filter(F.col("wl_computed_at").isNull()).join(local, "team_id", "left_semi"), "not_yet_computed")


def spot_check(expected: DataFrame, aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """Expected ``(raw, slug)`` lookups against what resolves."""
    hit = resolve(expected, "raw", aliases, "team_id", "left").join(
        teams.select("team_id", F.col("slug").alias("actual_slug")), "team_id", "left")
    return hit.select("raw", F.col("slug").alias("expected_slug"), "actual_slug",
                      F.col("slug").eqNullSafe(F.col("actual_slug")).alias("passed"))


def freshness(tables: dict[str, tuple[DataFrame, str]], as_of: Column, hours: int = 24) -> DataFrame:
    """Per table: last write, rows of the last ``hours``, frozen when there are none."""
    def one(name: str, df: DataFrame, col: str) -> DataFrame:
        edge = as_of - F.make_dt_interval(hours=F.lit(hours))
        return df.agg(F.max(col).alias("last_write"), F.count_if(F.col(col) >= edge).alias("recent_rows")).select(
            F.lit(name).alias("tbl"), "last_write", "recent_rows",
            F.coalesce(F.col("last_write") < edge, F.lit(True)).alias("frozen"))

    return reduce(DataFrame.unionByName, [one(n, df, c) for n, (df, c) in tables.items()])


def missing_canonical_source(games: DataFrame, records: DataFrame, backfill: str = "backfill") -> DataFrame:
    """Records of live sources whose game names no source."""
    live = records.filter(F.col("source") != backfill).select("game_id")
    open_games = games.filter(F.col("canonical_source").isNull()).select("game_id")
    return count_metric(live.join(open_games, "game_id"), "missing_canonical_source")


def schema_growth_sync(new: DataFrame, legacy: DataFrame, ts: str, unit: str = "day") -> DataFrame:
    """Rows per load time of two tables, their growth since the load before, in sync or not.

    Works on one row per load time, ordered within each year.
    """
    count = lambda df, name: df.groupBy(F.date_trunc(unit, F.col(ts)).alias("load_time")).agg(F.count("*").alias(name))
    both = count(new, "new_rows").join(count(legacy, "legacy_rows"), "load_time", "full_outer").select(
        "load_time", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("new_rows", "legacy_rows")])
    both = previous_value(both, F.struct("new_rows", "legacy_rows"), [], ["load_time"], F.date_trunc("year", F.col("load_time")), "_before")
    return both.select(
        "load_time", "new_rows", "legacy_rows", (F.col("new_rows") - F.col("_before.new_rows")).alias("new_delta"),
        (F.col("legacy_rows") - F.col("_before.legacy_rows")).alias("legacy_delta"),
        (F.col("new_rows") == F.col("legacy_rows")).alias("in_sync"))


def soak_gate(loads: DataFrame, ts: str, clean: Column, runs: int = 3, hours: int = 48) -> DataFrame:
    """At least ``runs`` clean loads in a row, up to the latest load, that span at least ``hours``."""
    broken = loads.agg(F.max(F.when(~F.coalesce(clean, F.lit(False)), F.col(ts)))).scalar()
    good = loads.filter(clean & (broken.isNull() | (F.col(ts) > broken))).agg(
        F.count("*").alias("clean_runs"), F.min(ts).alias("first_clean"), F.max(ts).alias("last_clean"))
    span = F.timestamp_diff("SECOND", F.col("first_clean"), F.col("last_clean"))
    return good.withColumn("span_seconds", F.coalesce(span, F.lit(0))).withColumn(
        "passed", (F.col("clean_runs") >= runs) & (F.col("span_seconds") >= hours * 3600))


def traffic_ratio_streak(requests: DataFrame, ts: str, legacy: Column, max_ratio: float = 0.01,
                         days: int = 7) -> DataFrame:
    """Runs of consecutive days with legacy requests under ``max_ratio`` of the new ones.

    ``reached_on`` is the day a run completes ``days``. Only daily totals are ordered.
    """
    daily = requests.groupBy(F.to_date(ts).alias("day")).agg(
        F.count_if(legacy).alias("old"), F.count_if(~legacy).alias("new"))
    quiet = daily.filter(F.col("old") < max_ratio * F.col("new"))
    island = F.date_sub("day", F.row_number().over(W.orderBy("day")))
    return (
        quiet.withColumn("_island", island).groupBy("_island")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("streak_days"))
        .select("first_day", "last_day", "streak_days",
                F.when(F.col("streak_days") >= days, F.date_add("first_day", days - 1)).alias("reached_on")))


def domain_check(df: DataFrame, enums: dict[str, list[str]], ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows outside the legal values of enum columns and ranges, all in one pass."""
    bad = {c: ~F.col(c).isin(values) for c, values in enums.items()}
    bad |= {c: ~F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()}
    one = df.agg(*[F.count_if(expr).alias(c) for c, expr in bad.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(f"domain_{c}").alias("check"), F.lit(0).cast("long").alias("expected"),
                 F.col(c).alias("actual"), (F.col(c) == 0).alias("passed")) for c in bad])).alias("m")).select("m.*")


def recent_records(records: DataFrame, games: DataFrame, teams: DataFrame, as_of: Column, hours: int = 2,
                   n: int = 20) -> DataFrame:
    """Newest live-source records with both team keys."""
    name = lambda side: teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("slug").alias(side))
    fresh = records.filter((F.col("scraped_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
                           & (F.col("source") != "backfill")).select("game_id", "source", "scraped_at")
    return (fresh.join(games.select("game_id", "home_team_id", "away_team_id"), "game_id")
            .join(name("home"), "home_team_id").join(name("away"), "away_team_id")
            .select("game_id", "source", "scraped_at", "home", "away")
            .orderBy(F.desc("scraped_at"), "game_id", "source").limit(n))


def growth_since_last(df: DataFrame, keys: list[str], ts: str, count_col: str, out: str = "growth") -> DataFrame:
    """Difference of a count to the load before, per key."""
    before = previous_value(df, F.col(count_col), keys, [ts], F.date_trunc("month", F.col(ts)), "_before")
    return before.withColumn(out, F.col(count_col) - F.col("_before")).drop("_before")


def table_checks(tables: Mapping[str, DataFrame], rows: Mapping[str, Mapping[str, Column]],
                 keys: Mapping[str, list[list[str]]]) -> DataFrame:
    """Metrics of many checks with one scan of each table.

    ``rows`` names conditions per table that no row should meet; null counts as not met. ``keys`` lists column sets per table of which no
    combination should occur twice (null equals null), whatever they share: all of them and the conditions are grouping sets of one aggregation, so
    a row is read once and pre-aggregated before its only shuffle. Checks are named ``<table>.<condition>`` and ``<table>.unique(<columns>)``.
    Tables without a check are not read; on an empty table every check passes.
    """
    return reduce(DataFrame.unionByName, [
        _checks_of(name, df, dict(rows.get(name, {})), [list(k) for k in keys.get(name, [])])
        for name, df in tables.items() if rows.get(name) or keys.get(name)])


def _checks_of(table: str, df: DataFrame, conditions: dict[str, Column], keys: list[list[str]]) -> DataFrame:
    columns = list(dict.fromkeys(c for key in keys for c in key))
    place = {c: f"_k{i}" for i, c in enumerate(columns)}
    flags = [f"_f{i}" for i in range(len(conditions))]
    # Names of our own, so that no column of the table is in the way; nothing else is read.
    lean = df.select(*[F.col(c).alias(k) for c, k in place.items()], *[c.alias(f) for f, c in zip(flags, conditions.values())])
    counts = [F.count_if(f).alias(f) for f in flags]
    if not keys:
        total = lean.agg(*counts)
    else:
        # A set's id has a bit for each column that is not in it, the first column's highest.
        absent = lambda key: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key)
        sets = {absent(key): [place[c] for c in columns if c in key] for key in keys}
        if flags:
            sets[absent([])] = []
        grouped = lean.groupingSets(list(sets.values()), *place.values()).agg(
            F.grouping_id().alias("_set"), F.count("*").alias("_n"), *counts)
        total = grouped.agg(
            *[F.coalesce(F.sum(F.when(F.col("_set") == absent([]), F.col(f))), F.lit(0)).alias(f) for f in flags],
            *[F.count_if((F.col("_set") == absent(key)) & (F.col("_n") > 1)).alias(f"_u{i}") for i, key in enumerate(keys)])
    named = [*zip([f"{table}.{c}" for c in conditions], flags),
             *[(f"{table}.unique({','.join(key)})", f"_u{i}") for i, key in enumerate(keys)]]
    return total.select(F.explode(F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(0).cast("long").alias("expected"), F.col(c).cast("long").alias("actual"),
                 (F.col(c) == 0).alias("passed")) for check, c in named])).alias("m")).select("m.*")


def gate(audits: list[DataFrame]) -> DataFrame:
    """All metric audits in one table: one verdict per check."""
    rows = reduce(DataFrame.unionByName, [a.select("check", "passed") for a in audits])
    return rows.groupBy("check").agg(F.bool_and("passed").alias("passed"))
