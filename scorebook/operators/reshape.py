"""Per-team rows and per-game rows: conversion both ways, duplicates, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.clean import completed_status, ordered_pair
from scorebook.operators.resolve import at_hand, resolve
from scorebook.schemas import KEYS
from scorebook.sources.sinks import insert_ignore, one_per_key


def to_perspective(games: DataFrame) -> DataFrame:
    """Each game as two team rows; one scan of the games, not two."""
    side = lambda me, opp, home: F.struct(
        F.col(f"{me}_team_id").alias("team_id"), F.col(f"{opp}_team_id").alias("opponent_id"),
        F.lit(home).alias("is_home"), F.col(f"{me}_score").alias("my_score"), F.col(f"{opp}_score").alias("opp_score"))
    kept = [c for c in games.columns if c not in ("home_team_id", "away_team_id", "home_score", "away_score")]
    return games.select(*kept, F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("_s")
                        ).select(*kept, "_s.*")


def counted_games(games: DataFrame) -> DataFrame:
    """Games that enter records and ratings."""
    return games.filter(
        (F.col("status") == "completed") & ~F.col("is_scrimmage")
        & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())


def to_neutral(schedule: DataFrame, aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """Per-team schedule rows to one row per game.

    Both sides resolve through aliases (rows with an unknown side drop out, see
    ``unresolved``); ids, scores and venue flip for away rows; mirrored copies
    collapse on the resolved ids, the home team's row first. Aliases and venues
    that fit are broadcast, so a row is shuffled once, by its game.
    """
    aliases = at_hand(aliases, "alias_normalized")
    both = resolve(resolve(schedule, "team_id", aliases, "_our"), "opponent", aliases, "_opp")
    home = F.col("is_home")
    flip = lambda a, b: F.when(home, F.col(a)).otherwise(F.col(b))
    scrimmage = F.col("is_scrimmage") if "is_scrimmage" in schedule.columns else F.lit(False)
    flipped = both.select(
        "season", flip("_our", "_opp").alias("home_team_id"), flip("_opp", "_our").alias("away_team_id"),
        F.to_date("game_date").alias("game_date"), "is_conference", F.col("is_ot").alias("is_overtime"),
        scrimmage.alias("is_scrimmage"),
        flip("team_score", "opp_score").alias("home_score"), flip("opp_score", "team_score").alias("away_score"),
        "is_home", "game_time", "team_id", "opponent")
    # Home copy first; repeated loads of one copy settle on a fixed order.
    one = one_per_key(flipped, KEYS["games"], [
        F.col("is_home").desc(), F.col("game_time").asc_nulls_last(), F.col("team_id"), F.col("opponent")])
    venues = teams.select(F.col("team_id").alias("home_team_id"), F.col("home_venue_id").alias("venue_id"))
    return (
        one.join(at_hand(venues, "home_team_id"), "home_team_id", "left")
        .select("season", "home_team_id", "away_team_id", "game_date",
                F.lit(None).cast("timestamp_ntz").alias("game_datetime"), "venue_id", "is_conference",
                "is_overtime", "is_scrimmage", "home_score", "away_score",
                completed_status("home_score", "away_score").alias("status"),
                F.lit(None).cast("string").alias("canonical_source"), F.lit(False).alias("has_conflict")))


def reinsert_dropped(games: DataFrame, schedule: DataFrame, aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """After aliases were added: insert only the games that were missing. ``games`` may be costly to compute: they are read once."""
    return insert_ignore(games, to_neutral(schedule, aliases, teams), KEYS["games"], KEYS["games"], target_once=True)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return one_per_key(df, keys, [F.col(c).asc_nulls_first() for c in order])


def dedup_pair(df: DataFrame, a: str, b: str, date: str) -> DataFrame:
    """Distinct unordered pairs per date: ``(team_a, team_b, date)``."""
    low, high = ordered_pair(a, b)
    return df.select(low.alias("team_a"), high.alias("team_b"), date).distinct()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def distinct_events(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def stack_counts(tables: dict[str, DataFrame], where: dict[str, Column] | None = None) -> DataFrame:
    """Row counts of several tables as ``(tbl, n)``."""
    where = where or {}
    counts = [df.filter(where.get(name, F.lit(True))).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
