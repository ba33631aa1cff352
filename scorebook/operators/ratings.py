"""Iterative power ratings, ranks, ranking snapshots and source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.clean import normalize_name, round4, store_decimal
from scorebook.functions.ordered import null_safe_join, number_rows, previous_value
from scorebook.operators.records import pair_totals, team_stats
from scorebook.sources.sinks import insert_ignore, upsert
from scorebook.schemas import KEYS
from scorebook.session import durable, durable_by

RATING_BYTES = 64  # one broadcast row: season, team, rating and hash-table overhead
PAIRS_PER_SUM = 16_000_000  # pairs whose partial sums one task makes; it reads them as arrays
TEAMS_PER_BUILD = 1_000_000  # ratings in the hash table of one task


def average_goal_diff(stats: DataFrame) -> DataFrame:
    return stats.select("season", "team_id", "agd")


def power_ratings(games: DataFrame, passes: int = 15, cap: int = 10, signed: bool = False,
                  passes_per_cut: int = 5, edges_per_task: int = 1_000_000,
                  broadcast_limit: int = 32 << 20) -> DataFrame:
    """Per season: ``rating = agd + mean(rating of opponents)``, ``passes`` times.

    The number of passes is part of the result (ratings grow with it). Games
    are collapsed once into weighted pairs, and the pairs of an opponent into
    one row with two arrays, the teams and the weights. A pass joins these rows
    with the previous ratings, once per opponent and not per pair, and sums per
    team, with partial sums before the shuffle.

    Ratings are one number per team and season; the teams are counted, and only
    ratings of at most ``broadcast_limit`` bytes are broadcast. Above it the
    rows are stored hash-partitioned by the join key. A team with more than
    ``edges_per_task`` opponents has its pairs spread over several rows and its
    rating copied to each of them.
    """
    spark = games.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    team, opponent = ["season", "team_id"], ["season", "opponent_id"]
    pairs = durable(pair_totals(games, cap, signed))
    stats = durable(team_stats(pairs))
    # Pairs are symmetric, so a team's opponents are also the pairs that name it.
    teams, edge_count, widest = stats.agg(F.count("*"), F.coalesce(F.sum("opponents"), F.lit(0)), F.max("opponents")).first()  # three numbers
    edges = pairs.select(*team, "opponent_id", "n").dropna(subset=[*team, "opponent_id"])
    keys, spread = opponent, None
    small = teams * RATING_BYTES <= broadcast_limit
    if teams and widest > edges_per_task:
        # At most one row per ``edges_per_task`` pairs.
        spread = durable(stats.filter(F.col("opponents") > edges_per_task).select(
            "season", F.col("team_id").alias("opponent_id"),
            F.ceil(F.col("opponents") / edges_per_task).cast("int").alias("salts")))
        edges = edges.join(F.broadcast(spread), opponent, "left").withColumn(
            "salt", F.pmod(F.xxhash64("team_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        keys = [*opponent, "salt"]
    # Stored in join order: a pass then moves ratings and partial sums, never the pairs. A task sums many pairs,
    # as every task has a partial sum for most teams.
    tasks = max(spark.sparkContext.defaultParallelism, -(-edge_count // PAIRS_PER_SUM), -(-teams // TEAMS_PER_BUILD))
    listed = lambda df: df.groupBy(*keys).agg(F.collect_list(F.struct("team_id", "n")).alias("_to")).select(
        *keys, F.col("_to.team_id").alias("_teams"), F.col("_to.n").alias("_ns"))
    parts = min(slots, tasks)
    edges = durable_by(edges, parts, *keys, then=listed)
    if not small:
        stats = durable_by(stats, slots, *team)
    once = F.broadcast if small else lambda df: df.hint("shuffle_hash")
    own = stats.select(*team, "agd", "games_played")
    own = F.broadcast(own) if small else own

    rating = stats.select(*team, F.col("agd").alias("rating"))
    for step in range(1, passes + 1):
        theirs = rating.withColumnRenamed("team_id", "opponent_id")
        if spread is not None:
            copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
            theirs = theirs.join(F.broadcast(spread), opponent, "left").select(*opponent, "rating", copies.alias("salt"))
        if not small and parts < slots:
            # Otherwise Spark would deal the pairs anew, to as many partitions as it shuffles by.
            theirs = theirs.repartition(parts, *keys)
        reached = edges.join(once(theirs), keys).select("season", "rating", "_ns", F.posexplode("_teams").alias("_i", "team_id"))
        sums = reached.groupBy(*team).agg(F.sum(F.get("_ns", F.col("_i")) * F.col("rating")).alias("_sum"))
        rating = sums.join(own, team).select(*team, (F.col("agd") + F.col("_sum") / F.col("games_played")).alias("rating"))
        if step % passes_per_cut == 0 and step < passes:
            rating = durable(rating)

    final = stats.join(rating, team)
    return final.select(
        "season", "team_id", round4("rating").alias("rating"), round4("agd").alias("agd"),
        round4(F.col("rating") - F.col("agd")).alias("sched"), "wins", "losses", "games_played")


def rank(df: DataFrame, by: str, ident: str, part: list[str] | None = None, tie: str = "row_number",
         out: str = "rank") -> DataFrame:
    """Descending rank per ``part``: 1..n with ties broken by ``ident``.

    ``tie='rank'`` or ``'dense_rank'`` gives equal values one rank. The numbering
    is a distributed sort (``number_rows``), so a partition may be any size.
    Rows without a value come last, as one more value of their own.
    """
    part = part or []
    if tie == "dense_rank":
        levels = number_rows(df.select(*part, by).distinct(), [F.col(by).desc_nulls_last()], part, out)
        return null_safe_join(df, levels, [*part, by])
    numbered = number_rows(df, [F.col(by).desc_nulls_last(), F.col(ident)], part, out)
    if tie == "rank":
        best = numbered.groupBy(*part, by).agg(F.min(out).alias("_best"))
        return null_safe_join(numbered.drop(out), best, [*part, by]).withColumnRenamed("_best", out)
    return numbered


def weekly_ratings(target: DataFrame, ratings: DataFrame, week_ending: Column) -> DataFrame:
    """Ratings of a week written over any earlier run for the same week."""
    batch = ratings.withColumn("week_ending", week_ending)
    values = [c for c in target.columns if c not in ("team_id", "season", "week_ending")]
    return upsert(target, batch.select(*target.columns), ["team_id", "season", "week_ending"], values, ["team_id"])


_HASHED = ["team_name", "rank_position", "rating", "agd", "sched", "record_wins", "record_losses"]


def entry_digest_sums(columns: list[str] = _HASHED) -> list[Column]:
    """Order-free digest of a group: SHA-256 per row, its four 64-bit words summed.

    A sum needs one fixed-size buffer per group, so a snapshot of any size is
    hashed with partial aggregation instead of collecting and sorting it.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.sha2(text, 256)
    word = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    return [F.sum(word(i)).alias(f"_w{i}") for i in range(4)]


def snapshots(rankings: DataFrame, hash_content: bool = True) -> DataFrame:
    """One row per source, season and capture time with a content hash.

    ``hash_content=False`` gives the MD5 of source, season and date instead,
    which identifies the day but not the content.
    """
    key = ["source", "season", "captured_at"]
    if not hash_content:
        return rankings.select(*key).distinct().withColumn("content_hash", F.md5(F.concat_ws(
            "|", "source", F.col("season").cast("string"), F.to_date("captured_at").cast("string"))))
    summed = rankings.groupBy(*key).agg(F.count("*").alias("_n"), *entry_digest_sums())
    words = [F.col(c).cast("string") for c in ("_n", "_w0", "_w1", "_w2", "_w3")]
    return summed.select(*key, F.sha2(F.concat_ws(":", *words), 256).alias("content_hash"))


def entries(rankings: DataFrame, snaps: DataFrame, aliases: DataFrame) -> DataFrame:
    """Snapshot rows with resolved teams, joined on the exact capture time."""
    key = ["source", "season", "captured_at"]
    alias = aliases.select("alias_normalized", "team_id")
    return (
        rankings.join(snaps.select(*key), key, "left_semi")
        .join(alias, normalize_name("team_name") == F.col("alias_normalized"))
        .select(*key, "team_id", "rank_position", *[store_decimal(c, 2).alias(c) for c in ("rating", "agd", "sched")],
                "record_wins", "record_losses"))


def skip_unchanged(snaps: DataFrame) -> DataFrame:
    """Snapshots whose content differs from the one before of the same source and season."""
    before = previous_value(snaps, F.col("content_hash"), ["source", "season"], ["captured_at"],
                            F.date_trunc("month", F.col("captured_at")), "_before")
    return before.filter(~F.col("content_hash").eqNullSafe(F.col("_before"))).drop("_before")


def source_records(games: DataFrame, teams: DataFrame, source: str, as_of: Column,
                   existing: DataFrame | None = None) -> DataFrame:
    """One record per game and source with the raw team keys and scores."""
    name = lambda side: teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("slug").alias(f"{side}_team_raw"))
    rows = (
        games.join(name("home"), "home_team_id").join(name("away"), "away_team_id")
        .select("game_id", F.lit(source).alias("source"), "home_team_raw", "away_team_raw", "home_score",
                "away_score", as_of.alias("scraped_at")))
    return rows if existing is None else insert_ignore(
        existing, rows, KEYS["game_source_records"], ["game_id", "home_team_raw", "away_team_raw"])


def pick_canonical(records: DataFrame, priority: DataFrame) -> DataFrame:
    """Per game the scores of the best source; ``has_conflict`` when sources disagree.

    Sources that the priorities do not list come behind all listed ones.
    """
    ranked = records.join(priority, "source", "left")
    score = F.struct("home_score", "away_score")
    known = F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), score)
    best = F.max_by(F.struct("home_score", "away_score", "source"), F.struct("priority", "source"))
    return (
        ranked.groupBy("game_id").agg(best.alias("_b"), F.min(known).alias("_lo"), F.max(known).alias("_hi"),
                                      F.count("*").alias("sources"))
        .select("game_id", F.col("_b.home_score").alias("home_score"), F.col("_b.away_score").alias("away_score"),
                F.col("_b.source").alias("canonical_source"), "sources",
                F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("has_conflict")))
