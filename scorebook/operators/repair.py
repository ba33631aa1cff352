"""Repair of names that no alias resolves, in rounds until nothing more is found."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.functions.clean import normalize_name
from scorebook.operators.reshape import reinsert_dropped
from scorebook.operators.resolve import at_hand, resolve
from scorebook.session import durable, joins_by_layout, scratch_path
from scorebook.sources.layout import deal_bucketed

# What a row and its mirror, the other team's row of the same game, have in common.
GAME = ["season", "_day", "_home_score", "_away_score"]


@dataclass
class Repaired:
    """``games`` with the rows that were missing, all ``aliases``, those ``added`` (round, alias_normalized, team_id, evidence),
    and the names that stay ``open`` (alias_normalized, occurrences, candidates)."""

    games: DataFrame
    aliases: DataFrame
    added: DataFrame
    open: DataFrame


#: Groups that games are dealt to buckets by, far more than buckets, so that buckets are even.
GROUPS = 1 << 16


def _ends(rows: DataFrame, *more: str) -> DataFrame:
    """Both ends of a row: its name, its team if known, and the team at the other end."""
    end = lambda name, own, other, reports: F.struct(
        F.col(name).alias("_name"), F.col(own).alias("_own"), F.col(other).alias("_other"), F.lit(reports).alias("_reports"))
    both = F.array(end("_me", "_me_id", "_opp_id", True), end("_opp", "_opp_id", "_me_id", False))
    return rows.select(*GAME, "is_home", *more, F.explode(both).alias("_e")).select(*GAME, "is_home", *more, "_e.*")


def _evidence(rows: DataFrame) -> DataFrame:
    """Each open name with the teams that mirrored rows put in its place. Rows meet inside the buckets they are stored in."""
    whole = rows.filter("is_home IS NOT NULL")
    asked = _ends(whole.filter("_me_id IS NULL OR _opp_id IS NULL"), "_group").filter(
        "_own IS NULL AND _other IS NOT NULL AND _name <> ''").drop("_own")
    # A mirror says the same from the other side: its reporter is this row's opponent.
    told = _ends(whole.filter("_me_id <> _opp_id"), "_group").select(
        *GAME, "_group", (~F.col("is_home")).alias("is_home"), (~F.col("_reports")).alias("_reports"), "_other", F.col("_own").alias("_found"))
    return asked.join(told, ["_group", *GAME, "is_home", "_reports", "_other"]).groupBy("_name").agg(
        F.min("_found").alias("team_id"), F.count_distinct("_found").alias("candidates"),
        F.count_distinct("season", "_day", "_other").alias("evidence"))


def repair_rounds(games: DataFrame, schedule: DataFrame, aliases: DataFrame, teams: DataFrame, buckets: int | None = None) -> Repaired:
    """Resolve, propose, insert, until a round proposes nothing.

    A game that both teams report stands in the schedule twice, with sides and scores exchanged. If one of the two rows resolves and
    the other lacks one name, the first says which team the name means. All such evidence for a name is gathered in every round; the
    name becomes an alias only if all of it names one team. Rows that an alias completes are evidence in the next round. Rows
    without a season, date, side or score are no evidence; empty names and names with an alias get none. Every round but the last adds
    an alias, so the rounds end. ``games`` gains only rows that could not be inserted before.

    The schedule is resolved once: what the rounds need of its rows, each distinct row once with its count, is stored in ``buckets`` (by default
    the session's shuffle partitions) by date and scores, so that rows and their mirrors meet without a shuffle. A round reads it, adds
    the aliases found so far and stores only what it finds for each name. ``games`` of the result reads the schedule again when it is used.
    """
    spark = schedule.sparkSession
    known = at_hand(aliases, "alias_normalized")

    def named(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_me": normalize_name("team_id"), "_opp": normalize_name("opponent")})
        return resolve(resolve(rows, "_me", known, "_me_id", "left"), "_opp", known, "_opp_id", "left")

    gap = F.col("_me_id").isNull() | F.col("_opp_id").isNull()
    own, other, home = F.col("team_score"), F.col("opp_score"), F.col("is_home")
    rows = named(schedule).select(
        "season", F.to_date("game_date").alias("_day"), F.when(home, own).when(~home, other).alias("_home_score"),
        F.when(home, other).when(~home, own).alias("_away_score"), "is_home", "_me", "_opp", "_me_id", "_opp_id")
    # Known ends need no name. Of a row that is no evidence only the open names count: it has no game here, and any team for a known end.
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*GAME, "is_home")])
    ident = lambda c: F.when(whole | F.col(c).isNull(), F.col(c)).otherwise(F.lit(0)).cast(rows.schema[c].dataType).alias(c)
    lean = rows.filter(whole | gap).select(
        *[F.when(whole, F.col(c)).alias(c) for c in (*GAME, "is_home")], ident("_me_id"), ident("_opp_id"),
        *[F.when(F.col(f"{c}_id").isNull(), F.col(c)).alias(c) for c in ("_me", "_opp")])
    lean = lean.withColumn("_group", F.pmod(F.when(F.col("is_home").isNull(), F.xxhash64("_me", "_opp")).otherwise(F.xxhash64(*GAME)), F.lit(GROUPS)).cast("int"))
    name = f"repair_{uuid.uuid4().hex}"
    stored = deal_bucketed(lean, name, scratch_path(spark, name), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), ["_group"],
                           then=lambda dealt: dealt.groupBy(*lean.columns).agg(F.count("*").alias("_n")))
    added = None
    number = 0
    rows = stored
    while True:
        number += 1
        with joins_by_layout(spark):
            found = durable(_evidence(rows))
        fresh = found.filter("candidates = 1").select(
            F.lit(number).alias("round"), F.col("_name").alias("alias_normalized"), "team_id", "evidence")
        added = fresh if added is None else added.unionByName(fresh)
        if fresh.isEmpty():
            break
        rows, new = stored, at_hand(added, "alias_normalized")
        for name in ("_me", "_opp"):
            rows = resolve(rows, name, new, "_new", "left").withColumn(f"{name}_id", F.coalesce(f"{name}_id", "_new")).drop("_new")
    kept = aliases.unionByName(
        added.select("team_id", F.col("alias_normalized").alias("alias"), "alias_normalized", F.lit("mirror").alias("source")).select(*aliases.columns))
    left = (_ends(stored.filter(gap), "_n").filter("_own IS NULL").groupBy(F.col("_name").alias("alias_normalized")).agg(F.sum("_n").alias("occurrences"))
            .join(added.select("alias_normalized"), "alias_normalized", "left_anti")
            .join(found.select(F.col("_name").alias("alias_normalized"), "candidates"), "alias_normalized", "left")
            .withColumn("candidates", F.coalesce("candidates", F.lit(0))))
    again = named(schedule).filter(gap).drop("_me", "_opp", "_me_id", "_opp_id")
    return Repaired(reinsert_dropped(games, again, kept, teams), kept, added, left)
