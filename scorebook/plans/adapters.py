"""Views of the given tables in the shapes the operators work on.

The tables hold no games, so every shape is a fixed projection of them: line
items become games, suppliers teams, events live reports, and so on. Each shape
is written twice, as a DataFrame here and as a SQL common table expression in
``CTES`` for comparison runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.operators.resolve import build_aliases
from scorebook.sources.readers import read_table


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, d, name, list(columns) or None)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def team_count(spark: SparkSession, d: str) -> Column:
    return table(spark, d, "supplier", "s_suppkey").agg(F.count("*")).scalar()


def game_slots(spark: SparkSession, d: str, rows_per_slot: int = 500_000) -> int:
    """Shuffle partitions that hold about ``rows_per_slot`` line items each; the footers tell their number."""
    return -(-table(spark, d, "lineitem").count() // rows_per_slot)


def text(*parts: object) -> Column:
    """Concatenate columns and literals as text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def games(spark: SparkSession, d: str) -> DataFrame:
    """Neutral games from line items."""
    n = team_count(spark, d)
    base = table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("home_team_id"),
        (F.col("l_partkey") % n).alias("away_team_id"), F.to_date("l_shipdate").alias("game_date"),
        (F.col("l_quantity").cast("int") % 21).alias("hs"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 3) % 21).cast("int").alias("vs"),
        (F.col("l_linestatus") == "F").alias("done"), (F.col("l_returnflag") == "R").alias("scrim"),
        (F.col("l_linenumber") % 2 == 0).alias("conf"), (F.col("l_linenumber") == 3).alias("ot"), "l_linenumber",
    ).filter("home_team_id <> away_team_id")
    key = ["season", "home_team_id", "away_team_id", "game_date"]
    done = F.col("done")
    return (
        base.groupBy(*key).agg(
            F.bool_or("conf").alias("is_conference"), F.bool_or("ot").alias("is_overtime"),
            F.bool_or("scrim").alias("is_scrimmage"), F.bool_or("done").alias("done"),
            F.min("hs").alias("hs"), F.min("vs").alias("vs"), F.min("l_linenumber").alias("slot"))
        .select(*key, F.col("home_team_id").alias("venue_id"), "is_conference", "is_overtime", "is_scrimmage",
                F.when(done, F.col("hs")).alias("home_score"), F.when(done, F.col("vs")).alias("away_score"),
                F.when(done, "completed").otherwise("scheduled").alias("status"), "slot"))


def game_id(prefix: str = "") -> Column:
    return text(F.col("season"), "-", F.col("home_team_id"), "-", F.col("away_team_id"), "-", F.col("game_date"))


def team_name(ident: Column) -> Column:
    return F.concat(F.lit("Supplier#"), F.lpad(ident.cast("string"), 9, "0"))


def schedule(spark: SparkSession, d: str) -> DataFrame:
    """Per-team rows; the last fifth of the teams is out of state and has none."""
    n = team_count(spark, d)
    g = games(spark, d)
    side = lambda me, opp, home: F.struct(
        F.col(f"{me}_team_id").alias("me"), F.col(f"{opp}_team_id").alias("opp"), F.lit(home).alias("is_home"),
        F.col(f"{me}_score").alias("team_score"), F.col(f"{opp}_score").alias("opp_score"))
    rows = g.select("*", F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s"))
    opp, spelling = F.col("s.opp"), (F.col("home_team_id") + F.col("away_team_id") + F.day("game_date")) % 4
    name = team_name(opp)
    hour = F.col("slot") + 10
    clock = F.when(F.col("slot") < 7, text(F.when(hour > 12, hour - 12).otherwise(hour), ":00",
                                           F.when(hour >= 12, "pm").otherwise("am")))
    return rows.filter(F.col("s.me") * 10 < n * 8).select(
        text("s", F.col("s.me")).alias("team_id"), "game_date", clock.alias("game_time"),
        F.when(spelling == 0, name).when(spelling == 1, F.upper(name)).when(spelling == 2, text("  ", name, " "))
        .otherwise(text("s", opp)).alias("opponent"),
        "s.is_home", "is_conference",
        F.when(F.col("s.team_score") > F.col("s.opp_score"), "W")
        .when(F.col("s.team_score") < F.col("s.opp_score"), "L").alias("result"),
        "s.team_score", "s.opp_score", F.col("is_overtime").alias("is_ot"), "season", "is_scrimmage",
        (F.col("game_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(20))).alias("scraped_at"))


def teams(spark: SparkSession, d: str) -> DataFrame:
    n = team_count(spark, d)
    return table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        F.col("s_suppkey").alias("team_id"), text("s", F.col("s_suppkey")).alias("slug"), F.col("s_name").alias("name"),
        text("city", F.col("s_nationkey")).alias("city"),
        F.when(F.col("s_suppkey") * 10 < n * 8, "OR").otherwise("XX").alias("state"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey")).alias("home_venue_id"),
        text("conf", F.col("s_nationkey") % 8).alias("conference"))


def alias_teams(spark: SparkSession, d: str) -> DataFrame:
    """Teams that get aliases; every tenth stays unknown."""
    return teams(spark, d).filter("team_id % 10 <> 9")


def alias_variants(spark: SparkSession, d: str) -> DataFrame:
    name, shared = F.col("name"), text("pool ", F.floor(F.col("team_id") / 10))
    return alias_teams(spark, d).select("team_id", F.posexplode(F.array(
        F.replace(name, F.lit("#"), F.lit(" ")), F.upper(name), shared)).alias("pos", "alias")).select(
        "team_id", "alias", (F.col("pos") + 2).alias("pos"))


def aliases(spark: SparkSession, d: str) -> DataFrame:
    return build_aliases(alias_teams(spark, d), alias_variants(spark, d))


def team_seasons(spark: SparkSession, d: str) -> DataFrame:
    return teams(spark, d).filter("state = 'OR'").select(
        "team_id", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("season"), "conference",
        F.lit(0).cast("long").alias("wins"), F.lit(0).cast("long").alias("losses"),
        F.lit(None).cast("timestamp_ntz").alias("wl_computed_at"))


def rankings(spark: SparkSession, d: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        (nation % 7 + 1995).alias("season"), (key + 1).cast("int").alias("rank_position"),
        F.col("s_name").alias("team_name"), text(key % 15, "-", nation % 12).alias("record"),
        (key % 15).cast("int").alias("wins"), (nation % 12).alias("losses"),
        (F.col("s_acctbal") / 10).cast("decimal(8,3)").alias("rating"),
        ((key % 1000) / 8.0).cast("decimal(8,3)").alias("agd"), ((key % 500) / 4.0).cast("decimal(8,3)").alias("sched"),
        (ntz("2026-03-01 00:00:00") + F.make_dt_interval(mins=(key % 1000).cast("int"))).alias("scraped_at"))


def rankings_consensus(spark: SparkSession, d: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        (nation % 7 + 1995).alias("season"), (key + 1).cast("int").alias("rank_position"),
        F.col("c_name").alias("team_name"), text(key % 15, "-", nation % 12).alias("record"),
        (key % 15).cast("int").alias("wins"), (nation % 12).alias("losses"),
        (F.col("c_acctbal") / 10).cast("decimal(8,3)").alias("consensus"),
        (ntz("2026-03-01 00:00:00") + F.make_dt_interval(mins=(key % 1000).cast("int"))).alias("scraped_at"))


def rank_history(spark: SparkSession, d: str) -> DataFrame:
    """Ranking rows of two sources captured monthly."""
    n = team_count(spark, d)
    base = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "laxnumbers").otherwise("laxpower").alias("source"),
        F.year("o_orderdate").alias("season"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("captured_at"),
        (F.col("o_custkey") % n).alias("team"), "o_totalprice")
    key = ["source", "season", "captured_at", "team"]
    return base.groupBy(*key).agg(F.min("o_totalprice").alias("low"), F.count("*").cast("int").alias("cnt")).select(
        "source", "season", "captured_at", team_name(F.col("team")).alias("team_name"),
        (F.col("team") + 1).cast("int").alias("rank_position"),
        (F.floor(F.col("low") / 100) / 10.0).alias("rating"), (F.col("cnt") * 1.0).cast("double").alias("agd"),
        (F.col("cnt") * 0.5).cast("double").alias("sched"), F.col("cnt").alias("record_wins"),
        (F.col("team") % 10).cast("int").alias("record_losses"))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return table(spark, d, "events", "user_id", "value", "event_type", "ts").select(
        text("src", F.col("user_id") % 5).alias("source"), F.floor("value").alias("teams_scraped"),
        F.when(bad, "error").otherwise("success").alias("status"),
        F.when(bad, "load failed").alias("error_message"), F.col("ts").alias("scraped_at"))


def report_rows(events: DataFrame) -> DataFrame:
    """Live reports from events, batch or stream."""
    kind = F.col("event_type")
    state = (F.when(kind == "click", "q1").when(kind == "view", "q2").when(kind == "error", "q3")
             .when(kind == "signup", "q4").when(kind == "purchase", "final").otherwise("pregame"))
    place = lambda k: (F.col("event_id") * k % 5000) / 10000.0
    return events.select(
        "event_id", "ts", F.col("user_id").alias("reporter_id"), (F.col("user_id") % 20).alias("game_id"),
        (F.floor("value") % 20).cast("int").alias("home_score"), (F.col("event_id") % 15).cast("int").alias("away_score"),
        state.alias("game_state"),
        (F.lit(45) + place(104729)).cast("double").alias("lat"), (F.lit(-122) - place(7919)).cast("double").alias("lon"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    return report_rows(table(spark, d, "events"))


def venues(spark: SparkSession, d: str) -> DataFrame:
    place = lambda k: (F.col("s_suppkey") * k % 5000) / 10000.0
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("venue_id"), F.col("s_name").alias("name"),
        text("city", F.col("s_nationkey")).alias("city"),
        (F.lit(45) + place(1301)).cast("double").alias("lat"), (F.lit(-122) - place(2741)).cast("double").alias("lon"))


def live_games(spark: SparkSession, d: str) -> DataFrame:
    n = team_count(spark, d)
    key = F.col("o_orderkey")
    start = ntz("2024-01-01 00:00:00") + F.make_dt_interval(mins=(key * 37 % 43200).cast("int"))
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select(
        key.alias("game_id"), F.lit(2024).alias("season"), (F.col("o_custkey") % n).alias("home_team_id"),
        ((F.col("o_custkey") + 1 + key % (n - 1)) % n).alias("away_team_id"), (key % n).alias("venue_id"),
        start.alias("start_ts"), F.lit(None).cast("int").alias("home_score"),
        F.lit(None).cast("int").alias("away_score"), F.lit("scheduled").alias("status"))


def followers(spark: SparkSession, d: str) -> DataFrame:
    n = team_count(spark, d)
    return table(spark, d, "customer", "c_custkey").select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.array_distinct(F.array(F.col("c_custkey") % n, (F.col("c_custkey") * 3 + 1) % n))).alias("team_id"))


def reporters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "user_id").distinct().select(
        F.col("user_id").alias("reporter_id"), (F.col("user_id") % 3 != 0).alias("is_active"))


def source_scores(spark: SparkSession, d: str) -> DataFrame:
    """Several sources' scores per game (an order), one row per game and source."""
    which = F.col("l_linenumber") % 3
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey").groupBy(
        F.col("l_orderkey").alias("game_id"),
        F.when(which == 0, "ohsla").when(which == 1, "laxnumbers").otherwise("laxpower").alias("source")).agg(
        F.min(F.col("l_quantity").cast("int") % 3).alias("home_score"),
        F.min((F.col("l_partkey") % 3).cast("int")).alias("away_score"))


# The same shapes as SQL, with the shapes they are built on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "nt": ((), "SELECT count(*) AS n FROM supplier"),
    "games": (("nt",), """
        SELECT season, home_team_id, away_team_id, game_date, home_team_id AS venue_id,
               bool_or(conf) AS is_conference, bool_or(ot) AS is_overtime, bool_or(scrim) AS is_scrimmage,
               CASE WHEN bool_or(done) THEN min(hs) END AS home_score,
               CASE WHEN bool_or(done) THEN min(vs) END AS away_score,
               CASE WHEN bool_or(done) THEN 'completed' ELSE 'scheduled' END AS status, min(l_linenumber) AS slot
        FROM (SELECT year(l_shipdate)::INTEGER AS season, l_suppkey AS home_team_id,
                     l_partkey % (SELECT n FROM nt) AS away_team_id, l_shipdate::DATE AS game_date,
                     (trunc(l_quantity)::INTEGER % 21)::INTEGER AS hs,
                     ((l_partkey * 7 + l_linenumber * 3) % 21)::INTEGER AS vs,
                     l_linestatus = 'F' AS done, l_returnflag = 'R' AS scrim, l_linenumber % 2 = 0 AS conf,
                     l_linenumber = 3 AS ot, l_linenumber FROM lineitem)
        WHERE home_team_id <> away_team_id GROUP BY season, home_team_id, away_team_id, game_date"""),
    "sides": (("games",), """
        SELECT season, game_date, is_conference, is_overtime, is_scrimmage, status, slot, home_team_id, away_team_id,
               home_team_id AS me, away_team_id AS opp, true AS is_home, home_score AS my_score, away_score AS opp_score
        FROM games UNION ALL
        SELECT season, game_date, is_conference, is_overtime, is_scrimmage, status, slot, home_team_id, away_team_id,
               away_team_id, home_team_id, false, away_score, home_score FROM games"""),
    "schedule": (("sides", "nt"), """
        SELECT 's' || me AS team_id, game_date,
               CASE WHEN slot < 7 THEN (CASE WHEN slot + 10 > 12 THEN slot - 2 ELSE slot + 10 END) || ':00' ||
                    (CASE WHEN slot + 10 >= 12 THEN 'pm' ELSE 'am' END) END AS game_time,
               CASE (home_team_id + away_team_id + day(game_date)) % 4
                    WHEN 0 THEN 'Supplier#' || lpad(opp::VARCHAR, 9, '0')
                    WHEN 1 THEN upper('Supplier#' || lpad(opp::VARCHAR, 9, '0'))
                    WHEN 2 THEN '  ' || 'Supplier#' || lpad(opp::VARCHAR, 9, '0') || ' '
                    ELSE 's' || opp END AS opponent,
               is_home, is_conference,
               CASE WHEN my_score > opp_score THEN 'W' WHEN my_score < opp_score THEN 'L' END AS result,
               my_score AS team_score, opp_score, is_overtime AS is_ot, season, is_scrimmage,
               game_date::TIMESTAMP + INTERVAL 20 HOUR AS scraped_at
        FROM sides WHERE me * 10 < (SELECT n FROM nt) * 8"""),
    "teams": (("nt",), """
        SELECT s_suppkey AS team_id, 's' || s_suppkey AS slug, s_name AS name, 'city' || s_nationkey AS city,
               CASE WHEN s_suppkey * 10 < (SELECT n FROM nt) * 8 THEN 'OR' ELSE 'XX' END AS state,
               CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END AS home_venue_id, 'conf' || (s_nationkey % 8) AS conference
        FROM supplier"""),
    "alias_claims": (("teams",), """
        SELECT team_id, alias, pos, lower(trim(alias)) AS alias_normalized FROM (
            SELECT team_id, slug AS alias, 0 AS pos FROM teams WHERE team_id % 10 <> 9
            UNION ALL SELECT team_id, name, 1 FROM teams WHERE team_id % 10 <> 9
            UNION ALL SELECT team_id, replace(name, '#', ' '), 2 FROM teams WHERE team_id % 10 <> 9
            UNION ALL SELECT team_id, upper(name), 3 FROM teams WHERE team_id % 10 <> 9
            UNION ALL SELECT team_id, 'pool ' || (team_id // 10), 4 FROM teams WHERE team_id % 10 <> 9)"""),
    "aliases": (("alias_claims",), """
        SELECT team_id, alias, alias_normalized, 'seed' AS source FROM alias_claims
        QUALIFY row_number() OVER (PARTITION BY alias_normalized ORDER BY team_id, pos) = 1"""),
    "team_seasons": (("teams",), """
        SELECT team_id, season::INTEGER AS season, conference, 0::BIGINT AS wins, 0::BIGINT AS losses,
               NULL::TIMESTAMP AS wl_computed_at
        FROM teams, range(1995, 2002) r(season) WHERE state = 'OR'"""),
    "record": (("sides",), """
        SELECT me AS team_id, season, count(*) FILTER (my_score > opp_score) AS wins,
               count(*) FILTER (my_score < opp_score) AS losses
        FROM sides WHERE status = 'completed' AND NOT is_scrimmage AND my_score IS NOT NULL AND opp_score IS NOT NULL
        GROUP BY me, season"""),
    "fresh_seasons": (("team_seasons", "record"), """
        SELECT t.team_id, t.season, t.conference, coalesce(r.wins, 0) AS wins, coalesce(r.losses, 0) AS losses,
               TIMESTAMP '2026-05-01 00:00:00' AS wl_computed_at
        FROM team_seasons t LEFT JOIN record r USING (team_id, season)"""),
    "rankings": ((), """
        SELECT (s_nationkey % 7 + 1995)::INTEGER AS season, (s_suppkey + 1)::INTEGER AS rank_position,
               s_name AS team_name, (s_suppkey % 15) || '-' || (s_nationkey % 12) AS record,
               (s_suppkey % 15)::INTEGER AS wins, (s_nationkey % 12)::INTEGER AS losses,
               (s_acctbal / 10)::DECIMAL(8,3) AS rating, ((s_suppkey % 1000) / 8.0)::DECIMAL(8,3) AS agd,
               ((s_suppkey % 500) / 4.0)::DECIMAL(8,3) AS sched,
               TIMESTAMP '2026-03-01 00:00:00' + to_minutes((s_suppkey % 1000)::BIGINT) AS scraped_at FROM supplier"""),
    "rankings_consensus": ((), """
        SELECT (c_nationkey % 7 + 1995)::INTEGER AS season, (c_custkey + 1)::INTEGER AS rank_position,
               c_name AS team_name, (c_custkey % 15) || '-' || (c_nationkey % 12) AS record,
               (c_custkey % 15)::INTEGER AS wins, (c_nationkey % 12)::INTEGER AS losses,
               (c_acctbal / 10)::DECIMAL(8,3) AS consensus,
               TIMESTAMP '2026-03-01 00:00:00' + to_minutes((c_custkey % 1000)::BIGINT) AS scraped_at FROM customer"""),
    "rank_history": (("nt",), """
        SELECT source, season, captured_at, 'Supplier#' || lpad(team::VARCHAR, 9, '0') AS team_name,
               (team + 1)::INTEGER AS rank_position, floor(min(o_totalprice) / 100) / 10.0::DOUBLE AS rating,
               count(*)::DOUBLE AS agd, count(*) * 0.5::DOUBLE AS sched, count(*)::INTEGER AS record_wins,
               (team % 10)::INTEGER AS record_losses
        FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'laxnumbers' ELSE 'laxpower' END AS source,
                     year(o_orderdate)::INTEGER AS season, date_trunc('month', o_orderdate)::TIMESTAMP AS captured_at,
                     o_custkey % (SELECT n FROM nt) AS team, o_totalprice FROM orders)
        GROUP BY source, season, captured_at, team"""),
    "run_log": ((), """
        SELECT 'src' || (user_id % 5) AS source, floor(value)::BIGINT AS teams_scraped,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               CASE WHEN event_type = 'error' THEN 'load failed' END AS error_message, ts AS scraped_at FROM events"""),
    "reports": ((), """
        SELECT event_id, ts, user_id AS reporter_id, user_id % 20 AS game_id,
               (floor(value)::BIGINT % 20)::INTEGER AS home_score, (event_id % 15)::INTEGER AS away_score,
               CASE event_type WHEN 'click' THEN 'q1' WHEN 'view' THEN 'q2' WHEN 'error' THEN 'q3'
                    WHEN 'signup' THEN 'q4' WHEN 'purchase' THEN 'final' ELSE 'pregame' END AS game_state,
               45 + (event_id * 104729 % 5000) / 10000.0::DOUBLE AS lat,
               -122 - (event_id * 7919 % 5000) / 10000.0::DOUBLE AS lon FROM events"""),
    "venues": ((), """
        SELECT s_suppkey AS venue_id, s_name AS name, 'city' || s_nationkey AS city,
               45 + (s_suppkey * 1301 % 5000) / 10000.0::DOUBLE AS lat,
               -122 - (s_suppkey * 2741 % 5000) / 10000.0::DOUBLE AS lon FROM supplier"""),
    "live_games": (("nt",), """
        SELECT o_orderkey AS game_id, 2024::INTEGER AS season, o_custkey % (SELECT n FROM nt) AS home_team_id,
               (o_custkey + 1 + o_orderkey % ((SELECT n FROM nt) - 1)) % (SELECT n FROM nt) AS away_team_id,
               o_orderkey % (SELECT n FROM nt) AS venue_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey * 37 % 43200) AS start_ts,
               NULL::INTEGER AS home_score, NULL::INTEGER AS away_score, 'scheduled' AS status FROM orders"""),
    "live": (("reports",), """
        SELECT game_id, home_score, away_score, game_state, reporter_id, ts AS last_updated_at, event_id FROM reports
        QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ts DESC, event_id DESC) = 1"""),
    "changes": (("reports",), """
        SELECT * FROM (SELECT *, lag(game_state) OVER (PARTITION BY game_id ORDER BY ts, event_id) AS previous_state
                       FROM reports)
        WHERE previous_state IS NULL OR previous_state <> game_state OR game_state = 'final'"""),
    "followers": (("nt",), """
        SELECT c_custkey AS user_id, c_custkey % (SELECT n FROM nt) AS team_id FROM customer
        UNION SELECT c_custkey, (c_custkey * 3 + 1) % (SELECT n FROM nt) FROM customer"""),
    "reporters": ((), "SELECT DISTINCT user_id AS reporter_id, user_id % 3 <> 0 AS is_active FROM events"),
    "source_scores": ((), """
        SELECT l_orderkey AS game_id, CASE l_linenumber % 3 WHEN 0 THEN 'ohsla' WHEN 1 THEN 'laxnumbers'
                    ELSE 'laxpower' END AS source,
               min(trunc(l_quantity)::INTEGER % 3)::INTEGER AS home_score, min(l_partkey % 3)::INTEGER AS away_score
        FROM lineitem GROUP BY ALL"""),
    "neutral": (("schedule", "aliases", "teams"), """
        SELECT f.season, f.home_team_id, f.away_team_id, f.game_date, NULL::TIMESTAMP AS game_datetime,
               t.home_venue_id AS venue_id, is_conference, is_overtime, is_scrimmage, home_score, away_score,
               CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN 'completed' ELSE 'scheduled' END AS status,
               NULL::VARCHAR AS canonical_source, false AS has_conflict
        FROM (SELECT season, CASE WHEN is_home THEN a.team_id ELSE b.team_id END AS home_team_id,
                     CASE WHEN is_home THEN b.team_id ELSE a.team_id END AS away_team_id, game_date, is_conference,
                     is_ot AS is_overtime, is_scrimmage, CASE WHEN is_home THEN team_score ELSE opp_score END AS home_score,
                     CASE WHEN is_home THEN opp_score ELSE team_score END AS away_score, is_home, game_time,
                     s.team_id AS raw_id, opponent
              FROM schedule s JOIN aliases a ON a.alias_normalized = lower(trim(s.team_id))
              JOIN aliases b ON b.alias_normalized = lower(trim(s.opponent))
              QUALIFY row_number() OVER (PARTITION BY season, home_team_id, away_team_id, game_date
                                         ORDER BY is_home DESC, game_time NULLS LAST, raw_id, opponent) = 1) f
        LEFT JOIN teams t ON t.team_id = f.home_team_id"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named shapes, and what they need, as a WITH clause."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    heads = [f"{n} AS ({CTES[n][1].strip()})" for n in ordered]
    return (f"WITH {', '.join(heads)} " if heads else "") + body.strip()
