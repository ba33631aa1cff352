"""Entity resolution through aliases, and joins that follow reference tables.

Alias and team tables are joined without broadcast hints: Spark broadcasts a
side only when its measured size is under the session's threshold, and
otherwise shuffles, with AQE splitting the partitions of names that most rows
share. Where each row is resolved more than once, ``at_hand`` measures the
aliases first, so that rows are not shuffled for every name. Alias keys are
unique, so no join here multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.clean import normalize_name
from scorebook.schemas import KEYS
from scorebook.sources.sinks import insert_ignore, one_per_key, upsert


def alias_candidates(teams: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """All spellings of every team, in insertion order: slug, name, variants.

    ``variants`` is ``(team_id, alias, pos)`` with ``pos`` from 2 on.
    """
    own = teams.select(
        "team_id", F.posexplode(F.array("slug", "name")).alias("pos", "alias")).select("team_id", "alias", "pos")
    spelled = own if variants is None else own.unionByName(variants.select("team_id", "alias", "pos"))
    return spelled.filter(F.col("alias").isNotNull()).withColumn("alias_normalized", normalize_name("alias"))


def build_aliases(teams: DataFrame, variants: DataFrame | None = None, source: str = "seed") -> DataFrame:
    """Alias table; the first insertion of a normalized alias wins."""
    first = one_per_key(alias_candidates(teams, variants), ["alias_normalized"], [F.col("team_id"), F.col("pos")])
    return first.select("team_id", "alias", "alias_normalized", F.lit(source).alias("source"))


def alias_collisions(teams: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Normalized aliases claimed by more than one team (the losers never resolve)."""
    claims = alias_candidates(teams, variants).select("alias_normalized", "team_id").distinct()
    return (claims.groupBy("alias_normalized").agg(F.count("*").alias("teams"), F.min("team_id").alias("kept_by"))
            .filter("teams > 1"))


#: A broadcast row without its key, which is there twice; and what a broadcast table may take.
ROW_BYTES, BROADCAST_BYTES = 80, 128 << 20


def at_hand(df: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if, as counted now, it takes at most ``limit`` bytes looked up by ``key``; otherwise as it is."""
    n, width = df.agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    return F.broadcast(df) if n * ROW_BYTES + 2 * (width or 0) <= limit else df


def _keyed(aliases: DataFrame, out: str) -> DataFrame:
    return aliases.select(F.col("alias_normalized").alias("_alias"), F.col("team_id").alias(out))


def resolve(df: DataFrame, col: str, aliases: DataFrame, out: str = "resolved_id", how: str = "inner") -> DataFrame:
    """Attach the team behind a raw name; unmatched rows go unless ``how='left'``."""
    return df.join(_keyed(aliases, out), normalize_name(col) == F.col("_alias"), how).drop("_alias")


def resolve_two_stage(df: DataFrame, col: str, teams: DataFrame) -> DataFrame:
    """Count each raw string with the way it resolves: slug first, then name.

    The strings are counted before the joins, so a frequent name is one row.
    Two teams with one display name give one line each, as the join does.
    """
    counted = df.groupBy(normalize_name(col).alias("normalized"), F.col(col).alias("raw")).agg(
        F.count("*").alias("occurrences"))
    by_slug = teams.select(normalize_name("slug").alias("_s"), F.col("slug").alias("slug_hit"))
    by_name = teams.select(normalize_name("name").alias("_n"), F.col("slug").alias("name_hit"))
    return (
        counted.join(by_slug, F.col("normalized") == F.col("_s"), "left")
        .join(by_name, F.col("normalized") == F.col("_n"), "left")
        .select("normalized", "raw", "occurrences",
                F.when(F.col("slug_hit").isNotNull(), "resolved_by_slug")
                .when(F.col("name_hit").isNotNull(), "resolved_by_name")
                .otherwise("UNRESOLVED").alias("resolution_status"),
                F.coalesce("slug_hit", "name_hit").alias("resolved_to")))


def unresolved(df: DataFrame, col: str, aliases: DataFrame, date_col: str) -> DataFrame:
    """Raw names without alias: occurrences, first and last date, frequent first."""
    counted = df.groupBy(F.col(col).alias("raw_name")).agg(
        F.count("*").alias("occurrences"), F.min(date_col).alias("earliest"), F.max(date_col).alias("latest"))
    return (counted.join(_keyed(aliases, "_id"), normalize_name("raw_name") == F.col("_alias"), "left_anti")
            .orderBy(F.desc("occurrences"), "raw_name"))


def unresolved_count(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    names = df.select(normalize_name(col).alias("_name")).distinct()
    return names.join(_keyed(aliases, "_id"), F.col("_name") == F.col("_alias"), "left_anti").agg(
        F.count("_name").alias("unresolved_count"))


def unresolved_ledger(ledger: DataFrame, batch: DataFrame, as_of: Column, aliases: DataFrame | None = None) -> DataFrame:
    """Fold a batch of unresolved ``(raw_name, source, seen_at)`` into the ledger.

    Counts add up, the seen range widens, a resolution found through
    ``aliases`` is filled in and never cleared.
    """
    grouped = batch.groupBy("raw_name", "source").agg(
        F.min(F.coalesce("seen_at", as_of)).alias("first_seen_at"),
        F.max(F.coalesce("seen_at", as_of)).alias("last_seen_at"),
        F.count("*").alias("occurrence_count"))
    grouped = grouped.withColumn("resolved_team_id", F.lit(None).cast("long"))
    merged = upsert(ledger, grouped, KEYS["unresolved_aliases"], [], ["last_seen_at"], merge={
        "first_seen_at": F.least, "last_seen_at": F.greatest,
        "occurrence_count": lambda old, new: old + new,
        "resolved_team_id": lambda old, new: F.coalesce(old, new)})
    if aliases is None:
        return merged
    return (resolve(merged, "raw_name", aliases, "_found", "left")
            .withColumn("resolved_team_id", F.coalesce("resolved_team_id", "_found")).drop("_found"))


def map_update(df: DataFrame, mapping: DataFrame, key: str, label: str, ref: DataFrame, ref_label: str,
               ref_id: str, out: str) -> DataFrame:
    """Set ``out`` through key -> label -> reference row; unmapped keys get null.

    ``key`` must be unique in ``mapping`` and ``ref_label`` in ``ref``.
    """
    target = mapping.select(key, label).join(
        ref.select(F.col(ref_label).alias(label), F.col(ref_id).alias("_found")), label).drop(label)
    return df.drop(out).join(target, key, "left").withColumnRenamed("_found", out)


def link(pairs: DataFrame, left: DataFrame, left_name: str, left_id: str, right: DataFrame, right_name: str,
         right_id: str, existing: DataFrame) -> DataFrame:
    """Many-to-many rows from two name lookups, ignoring links already there.

    ``pairs`` holds ``left_name``, ``right_name`` and the link attributes of
    ``existing`` (season, role, source, ...).
    """
    found = (pairs.join(left.select(left_name, left_id), left_name)
             .join(right.select(right_name, right_id), right_name))
    return insert_ignore(existing, found, KEYS["team_coaches"], [left_id, right_id])


def assign_groups(df: DataFrame, members: DataFrame, key: str, season: int) -> DataFrame:
    """Group label per entity from rows ``(conference, key)``."""
    return df.join(members.select("conference", key), key).select("team_id", F.lit(season).alias("season"), "conference")


def prefer_or_unmatched(df: DataFrame, flag: str, keys: list[str], mirror: list[str]) -> DataFrame:
    """Flagged rows, and unflagged rows without a flagged mirror image.

    ``keys`` of the unflagged row are compared with ``mirror`` of flagged rows.
    """
    preferred = df.filter(F.col(flag))
    images = preferred.select(*[F.col(m).alias(f"_m{i}") for i, m in enumerate(mirror)]).distinct()
    lonely = df.filter(~F.col(flag)).join(
        images, [F.col(k) == F.col(f"_m{i}") for i, k in enumerate(keys)], "left_anti")
    return preferred.unionByName(lonely)


def active_only(reports: DataFrame, reporters: DataFrame) -> DataFrame:
    """Reports of known, active reporters."""
    return reports.join(reporters.filter("is_active"), "reporter_id", "left_semi")
