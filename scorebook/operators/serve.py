"""Parameterised queries over the stored tables.

Filters are plain comparisons on stored columns, so they reach the scan and,
on tables partitioned by season, prune partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorebook.functions.clean import completed_status
from scorebook.schemas import DEFAULT_SEASON, PLACEHOLDER_OPPONENT, PLAYOFF_START
from scorebook.sources.sinks import one_per_key


def latest_success(log: DataFrame) -> DataFrame:
    """Newest successful run, null when there is none."""
    return log.filter(F.col("status") == "success").agg(F.max("scraped_at").alias("last_success"))


_RENAMED = {"rank": "rank_position", "teamName": "team_name", "record": "record", "wins": "wins", "losses": "losses"}


def _ranking_rows(df: DataFrame, season: int, values: list[str]) -> DataFrame:
    return df.filter(F.col("season") == season).select(
        *[F.col(old).alias(new) for new, old in _RENAMED.items()],
        *[F.col(v).cast("double").alias(v) for v in values], F.col("scraped_at").alias("scrapedAt"))


def rankings(df: DataFrame, season: int = DEFAULT_SEASON) -> DataFrame:
    """One source's ranking of a season, best first."""
    return _ranking_rows(df, season, ["rating", "agd", "sched"]).orderBy("rank")


def rankings_consensus(df: DataFrame, season: int = DEFAULT_SEASON) -> DataFrame:
    return _ranking_rows(df, season, ["consensus"]).orderBy("rank")


def rankings_updated(df: DataFrame, season: int = DEFAULT_SEASON) -> DataFrame:
    """Load time of the first-ranked row."""
    return df.filter(F.col("season") == season).agg(F.min_by("scraped_at", "rank_position").alias("updated"))


def rankings_both(a: DataFrame, b: DataFrame, season: int = DEFAULT_SEASON) -> DataFrame:
    """Two sources of one season in one table, told apart by ``source``."""
    first = _ranking_rows(a, season, ["rating", "agd", "sched"]).withColumn("source", F.lit("laxnumbers"))
    second = _ranking_rows(b, season, ["consensus"]).withColumn("source", F.lit("laxpower"))
    return first.unionByName(second, allowMissingColumns=True).orderBy("source", "rank")


_SCHEDULE = {
    "teamId": "team_id", "date": "game_date", "time": "game_time", "opponent": "opponent", "isHome": "is_home",
    "isConference": "is_conference", "result": "result", "teamScore": "team_score", "oppScore": "opp_score",
    "isOT": "is_ot",
}


def schedule_all(df: DataFrame, season: int = DEFAULT_SEASON) -> DataFrame:
    """All schedule rows of a season by date, then by time as text."""
    rows = df.filter(F.col("season") == season).select(*[F.col(o).alias(n) for n, o in _SCHEDULE.items()])
    return rows.orderBy("date", "time")


def schedule_by_team(df: DataFrame, team_id: str, season: int = DEFAULT_SEASON) -> DataFrame:
    return schedule_all(df.filter(F.col("team_id") == team_id), season).drop("teamId")


def playoff_games(df: DataFrame, season: int = DEFAULT_SEASON, start_date: str = PLAYOFF_START,
                  placeholder: str = PLACEHOLDER_OPPONENT) -> DataFrame:
    """Home rows from a start date on, without placeholder opponents (any case)."""
    return (
        df.filter((F.col("season") == season) & (F.col("game_date") >= F.lit(start_date).cast("date"))
                  & F.col("is_home") & (F.lower("opponent") != placeholder.lower()))
        .select(F.col("team_id").alias("home_team_id"), F.col("opponent").alias("away_team"), "game_date", "game_time",
                F.col("team_score").cast("int").alias("home_score"), F.col("opp_score").cast("int").alias("away_score"),
                "scraped_at")
        .orderBy("game_date", "game_time"))


def with_status(df: DataFrame, a: str = "home_score", b: str = "away_score") -> DataFrame:
    return df.withColumn("status", completed_status(a, b))


def schedule_with_live(games: DataFrame, live: DataFrame, season: int, slug: str | None = None,
                       teams: DataFrame | None = None) -> DataFrame:
    """Games of a season with a ``live`` struct, null when nobody reports.

    ``slug`` limits to one team's games, both home and away.
    """
    rows = games.filter(F.col("season") == season)
    if slug is not None:
        team = teams.filter(F.col("slug") == slug).select("team_id").scalar()
        rows = rows.filter((F.col("home_team_id") == team) | (F.col("away_team_id") == team))
    state = live.select("game_id", F.struct(
        "home_score", "away_score", "game_state", "reporter_id", "last_updated_at").alias("live"))
    return rows.join(state, "game_id", "left")


def top_n(df: DataFrame, order: list[Column], n: int, part: list[str] | None = None) -> DataFrame:
    """First ``n`` rows of an ordering, overall or per group."""
    if not part:
        return df.orderBy(*order).limit(n)
    if n == 1:
        return one_per_key(df, part, order)
    w = W.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
