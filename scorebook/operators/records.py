"""Season records, standings and descriptive counts.

All are hash aggregates with partial aggregation before the shuffle, so a team
with a third of all games costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.clean import cap_abs_diff, ordered_pair
from scorebook.operators.reshape import counted_games, to_perspective


def season_record(games: DataFrame) -> DataFrame:
    """Wins and losses per team and season; a tie is neither."""
    return to_perspective(counted_games(games)).groupBy("team_id", "season").agg(
        F.count_if(F.col("my_score") > F.col("opp_score")).alias("wins"),
        F.count_if(F.col("my_score") < F.col("opp_score")).alias("losses"))


def conference_record(games: DataFrame) -> DataFrame:
    return season_record(games.filter("is_conference")).withColumnsRenamed(
        {"wins": "conf_wins", "losses": "conf_losses"})


def refresh_record(team_seasons: DataFrame, record: DataFrame, as_of: Column) -> DataFrame:
    """Every team season gets its record, 0-0 without games, and the time of computing."""
    fresh = record.select("team_id", "season", F.col("wins").alias("_w"), F.col("losses").alias("_l"))
    return (
        team_seasons.join(fresh, ["team_id", "season"], "left")
        .withColumns({"wins": F.coalesce("_w", F.lit(0)), "losses": F.coalesce("_l", F.lit(0)),
                      "wl_computed_at": as_of})
        .select(*team_seasons.columns))


def record_parity(team_seasons: DataFrame) -> DataFrame:
    """Total wins, losses and their difference (negative is possible)."""
    return team_seasons.agg(
        F.sum("wins").alias("total_wins"), F.sum("losses").alias("total_losses"),
        (F.sum("wins") - F.sum("losses")).alias("oos_delta"))


def zero_record(team_seasons: DataFrame, teams: DataFrame, state: str = "OR") -> DataFrame:
    none = team_seasons.filter((F.col("wins") == 0) & (F.col("losses") == 0))
    return none.join(teams.filter(F.col("state") == state).select("team_id", "slug"), "team_id").select(
        "slug", "season", "wins", "losses")


def group_counts(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def groups_below(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return group_counts(df, keys).filter(F.col("n") < n)


def value_histogram(df: DataFrame, col: str | Column) -> DataFrame:
    """Distinct values with length and frequency; null is a value."""
    value = F.col(col) if isinstance(col, str) else col
    return df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("occurrences")).select(
        "value", F.length("value").alias("len"), "occurrences")


def min_max(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("earliest"), F.max(col).alias("latest"),
                  F.max(F.length(F.col(col).cast("string"))).alias("max_len"))


def pair_appearances(df: DataFrame, a: Column | str, b: Column | str, date: str) -> DataFrame:
    """Rows per unordered pair and date."""
    low, high = ordered_pair(a, b)
    return df.groupBy(low.alias("team_a"), high.alias("team_b"), F.col(date)).agg(F.count("*").alias("appearances"))


def appearance_histogram(df: DataFrame, a: Column | str, b: Column | str, date: str) -> DataFrame:
    """How many matchups appear once, twice, more often."""
    return pair_appearances(df, a, b, date).groupBy("appearances").agg(F.count("*").alias("matchups"))


def distinct_matchups(df: DataFrame, a: Column | str, b: Column | str, date: str) -> DataFrame:
    low, high = ordered_pair(a, b)
    return df.agg(F.count_distinct(low, high, F.col(date)).alias("distinct_matchups"))


def pair_totals(games: DataFrame, cap: int = 10, signed: bool = False) -> DataFrame:
    """Games collapsed to ``(season, team, opponent)`` with everything ratings need.

    Here a tie is a home loss and an away win, unlike ``season_record``.
    """
    sides = to_perspective(counted_games(games))
    home_won = F.when(F.col("is_home"), F.col("my_score") > F.col("opp_score")).otherwise(
        F.col("opp_score") > F.col("my_score"))
    won = home_won == F.col("is_home")
    return sides.groupBy("season", "team_id", "opponent_id").agg(
        F.count("*").alias("n"), F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"),
        F.sum(cap_abs_diff("my_score", "opp_score", cap, signed).cast("long")).alias("diff_sum"))


def team_stats(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("season", "team_id").agg(
        F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("n").alias("games_played"),
        (F.sum("diff_sum") / F.sum("n")).alias("agd"), F.count("*").alias("opponents"))


def team_game_stats(games: DataFrame, cap: int = 10, signed: bool = False) -> DataFrame:
    """Per team and season: wins, losses, games played and mean capped difference."""
    return team_stats(pair_totals(games, cap, signed)).drop("opponents")
