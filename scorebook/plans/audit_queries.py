"""Data-quality audits over the adapted tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.operators import audit as au
from scorebook.operators import ratings as rt
from scorebook.operators import records as rc
from scorebook.operators import reshape as rs
from scorebook.plans import adapters as ad
from scorebook.plans.adapters import sql, text
from scorebook.plans.core_queries import APPEARANCES, AS_OF, fresh_seasons
from scorebook.plans.registry import query
from scorebook.session import durable, shuffle_slots
from scorebook.schemas import (
    COACH_ROLE, GAME_STATE, GAME_STATUS, KEYS, REFERENCES, SMALLINT_UNSIGNED, SNAPSHOT_SOURCE, TINYINT_UNSIGNED,
)


def _games_with_ids(s, d):
    return ad.games(s, d).withColumn("game_id", ad.game_id())


@query("row_count_reconcile", """
    SELECT tbl AS "check", expected, n AS actual, n = expected AS passed FROM (
        SELECT 'orders' AS tbl, (SELECT count(DISTINCT o_orderkey) FROM orders) AS expected, (SELECT count(*) FROM orders) AS n
        UNION ALL SELECT 'lineitem', (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem), (SELECT count(*) FROM lineitem)
        UNION ALL SELECT 'customer', (SELECT count(DISTINCT c_custkey) FROM customer), (SELECT count(*) FROM customer))""")
def _(s, d):
    # Rows against a recorded baseline: here the number of distinct keys.
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"]}
    tables = {t: ad.table(s, d, t, *k) for t, k in keys.items()}
    baseline = reduce(DataFrame.unionByName, [
        tables[t].agg(F.count_distinct(*k).alias("baseline")).select(F.lit(t).alias("tbl"), "baseline") for t, k in keys.items()])
    return au.row_count_reconcile(tables, baseline)


@query("normalization_audit", sql("""
    SELECT opponent AS raw_value, lower(trim(opponent)) AS normalized, length(opponent)::INTEGER AS raw_len,
           length(lower(trim(opponent)))::INTEGER AS norm_len,
           CASE WHEN opponent <> lower(trim(opponent)) THEN 'NEEDS_NORM' ELSE 'ok' END AS status FROM schedule""", "schedule"))
def _(s, d):
    return au.normalization_audit(ad.schedule(s, d), "opponent")


@query("null_and_zero_dates", """
    SELECT count(*) FILTER (o_orderkey % 50 = 0) AS null_dates,
           count(*) FILTER (o_orderkey % 50 = 0 OR o_orderkey % 50 = 1) AS zero_or_invalid_dates,
           count(*) FILTER (o_orderkey % 50 = 2) AS utc_midnight_strings FROM orders""")
def _(s, d):
    k = F.col("o_orderkey") % 50
    stored = (F.when(k == 0, F.lit(None)).when(k == 1, "0000-01-01").when(k == 2, text(F.to_date("o_orderdate"), "T00:00:00.000Z"))
              .otherwise(F.to_date("o_orderdate").cast("string")))
    return au.null_and_zero_dates(ad.table(s, d, "orders", "o_orderkey", "o_orderdate").select(stored.alias("date")), "date")


@query("time_format_audit", sql("""
    SELECT t AS stored_value, length(t)::INTEGER AS len, count(*) AS occurrences FROM (
        SELECT CASE WHEN is_conference THEN game_time ELSE replace(game_time, 'pm', ' p.m. PST') END AS t FROM schedule)
    WHERE NOT regexp_matches(t, '^(1[0-2]|[1-9]):[0-5][0-9](am|pm)$') OR length(t) > 8 GROUP BY ALL""", "schedule"))
def _(s, d):
    odd = F.when(F.col("is_conference"), F.col("game_time")).otherwise(F.replace("game_time", F.lit("pm"), F.lit(" p.m. PST")))
    return au.time_format_audit(ad.schedule(s, d).withColumn("game_time", odd), "game_time")


@query("decimal_drift", """
    SELECT column_name, count(*) FILTER (abs(v - round(v, 2)) > 0.0045 OR abs(v) >= 999999.995) AS drifted_rows, count(v) AS checked_rows
    FROM (SELECT 'seventh' AS column_name, p_retailprice / 7 AS v FROM part
          UNION ALL SELECT 'large', CASE WHEN p_size % 3 > 0 THEN p_retailprice * 1000 END FROM part) GROUP BY column_name""")
def _(s, d):
    # The large values do not fit the stored type, and some are missing.
    price = F.col("p_retailprice")
    part = ad.table(s, d, "part", "p_retailprice", "p_size").select(
        (price / 7).alias("seventh"), F.when(F.col("p_size") % 3 > 0, price * 1000).alias("large"))
    return au.decimal_drift(part, ["seventh", "large"], tolerance=0.0045)


@query("orphans", """
    SELECT count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey
    WHERE o_orderkey IS NULL""")
def _(s, d):
    parents = ad.table(s, d, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus <> 'P'")
    return au.orphans(ad.table(s, d, "lineitem", "l_orderkey"), "l_orderkey", parents, "o_orderkey").agg(F.count("*").alias("n"))


@query("missing_children", """
    SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL""")
def _(s, d):
    return au.missing_children(ad.table(s, d, "orders", "o_orderkey"), "o_orderkey",
                               ad.table(s, d, "lineitem", "l_orderkey"), "l_orderkey")


@query("unique_key_check", sql("""
    SELECT 'unique_' || t AS "check", 0::BIGINT AS expected, n AS actual, n = 0 AS passed FROM (
        SELECT 'games' AS t, count(*) AS n FROM (SELECT 1 FROM games GROUP BY season, home_team_id, away_team_id, game_date HAVING count(*) > 1)
        UNION ALL SELECT 'team_aliases', count(*) FROM (SELECT 1 FROM aliases GROUP BY alias_normalized HAVING count(*) > 1)
        UNION ALL SELECT 'team_seasons', count(*) FROM (SELECT 1 FROM team_seasons GROUP BY team_id, season HAVING count(*) > 1)
        UNION ALL SELECT 'schedule', count(*) FROM (SELECT 1 FROM schedule GROUP BY team_id, game_date, opponent, game_time HAVING count(*) > 1))
    """, "games", "aliases", "team_seasons", "schedule"))
def _(s, d):
    with shuffle_slots(s, ad.game_slots(s, d)):
        return durable(au.unique_key_check(
            {"games": ad.games(s, d), "team_aliases": ad.aliases(s, d), "team_seasons": ad.team_seasons(s, d),
             "schedule": ad.schedule(s, d)}, KEYS))


@query("foreign_key_check", sql("""
    SELECT c AS "check", 0::BIGINT AS expected, n AS actual, n = 0 AS passed FROM (
        SELECT 'team_aliases.team_id->teams.team_id' AS c, count(*) AS n FROM aliases WHERE team_id % 13 = 12
        UNION ALL SELECT 'team_seasons.team_id->teams.team_id', count(*) FROM team_seasons WHERE team_id % 13 = 12
        UNION ALL SELECT 'games.home_team_id->teams.team_id', count(*) FROM games WHERE home_team_id % 13 = 12
        UNION ALL SELECT 'games.away_team_id->teams.team_id', count(*) FROM games WHERE away_team_id % 13 = 12
        UNION ALL SELECT 'games.venue_id->venues.venue_id', 0
        UNION ALL SELECT 'teams.home_venue_id->venues.venue_id', 0)""", "aliases", "team_seasons", "games"))
def _(s, d):
    tables = {"teams": ad.teams(s, d).filter("team_id % 13 <> 12"), "venues": ad.venues(s, d), "games": ad.games(s, d),
              "team_aliases": ad.aliases(s, d), "team_seasons": ad.team_seasons(s, d)}
    return au.foreign_key_check(tables, REFERENCES)


def _schema_row(tbl, col, want, have, passed):
    value = lambda v: f"'{v}'" if v else "NULL"
    return f"SELECT '{tbl}' AS tbl, '{col}' AS column_name, {value(want)} AS expected_type, {value(have)} AS actual_type, " \
           f"{passed} AS passed"


@query("schema_check", " UNION ALL ".join([
    _schema_row("orders", "o_orderkey", "bigint", "bigint", True), _schema_row("orders", "o_custkey", "bigint", "bigint", True),
    _schema_row("orders", "o_orderstatus", "string", "string", True),
    _schema_row("orders", "o_totalprice", "decimal(8,2)", "double", False), _schema_row("orders", "o_note", "string", None, False),
    _schema_row("orders", "o_orderdate", None, "timestamp_ntz", False),
    _schema_row("orders", "o_orderpriority", None, "string", False),
    _schema_row("labels", "doc_id", "bigint", "bigint", True), _schema_row("labels", "quality", "int", "int", True),
    _schema_row("labels", "toxic", "int", "int", True)]))
def _(s, d):
    declared = {"orders": T.StructType.fromDDL("o_orderkey long, o_custkey long, o_orderstatus string, "
                                               "o_totalprice decimal(8,2), o_note string"),
                "labels": T.StructType.fromDDL("doc_id long, quality int, toxic int")}
    return au.schema_check(s, {t: ad.table(s, d, t) for t in declared}, declared)


@query("game_count_parity", sql(f"""
    SELECT (SELECT count(*) FROM neutral) AS new_games, (SELECT count(*) FROM ({APPEARANCES})) AS source_matchups,
           coalesce((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM schedule GROUP BY team_id, opponent, game_date
                                    HAVING count(*) > 1)), 0)::BIGINT AS duplicate_rows,
           (SELECT count(*) FROM neutral) - (SELECT count(*) FROM ({APPEARANCES})) AS gap""", "neutral", "schedule"))
def _(s, d):
    sched = ad.schedule(s, d)
    return au.game_count_parity(rs.to_neutral(sched, ad.aliases(s, d), ad.teams(s, d)), sched, "team_id", "opponent", "game_date")


@query("appearance_arithmetic", sql(f"""
    SELECT count(*) FILTER (appearances = 1) AS singles, count(*) FILTER (appearances = 2) AS doubles,
           count(*) FILTER (appearances > 2) AS more, sum(appearances)::BIGINT AS row_count,
           count(*) FILTER (appearances = 1) + 2 * count(*) FILTER (appearances = 2) = sum(appearances) AS passed
    FROM ({APPEARANCES})""", "schedule"))
def _(s, d):
    return au.appearance_arithmetic(ad.schedule(s, d), "team_id", "opponent", "game_date")


@query("not_computed", sql("""
    SELECT 'not_yet_computed' AS "check", 0::BIGINT AS expected, count(*) AS actual, count(*) = 0 AS passed
    FROM team_seasons WHERE season <> 1998""", "team_seasons"))
def _(s, d):
    some = F.when(F.col("season") == 1998, F.col("wl_computed_at"))
    return au.not_computed(fresh_seasons(s, d).withColumn("wl_computed_at", some), ad.teams(s, d))


@query("spot_check", sql("""
    SELECT raw, slug AS expected_slug, CASE WHEN hit IS NOT NULL THEN 's' || hit END AS actual_slug,
           hit IS NOT NULL AND slug = 's' || hit AS passed
    FROM (SELECT t.name AS raw, t.slug, a.team_id AS hit FROM teams t LEFT JOIN aliases a ON a.alias_normalized = lower(trim(t.name))
          UNION ALL SELECT 'POOL ' || (t.team_id // 10), t.slug, a.team_id FROM teams t
          LEFT JOIN aliases a ON a.alias_normalized = lower('pool ' || (t.team_id // 10)))""", "teams", "aliases"))
def _(s, d):
    t = ad.teams(s, d)
    expected = t.select(F.col("name").alias("raw"), "slug").unionByName(
        t.select(text("POOL ", F.floor(F.col("team_id") / 10)).alias("raw"), "slug"))
    return au.spot_check(expected, ad.aliases(s, d), t)


@query("freshness", """
    SELECT * FROM (
        SELECT 'events' AS tbl, max(ts) AS last_write, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR) AS recent_rows,
               max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AS frozen FROM events
        UNION ALL SELECT 'orders', max(o_orderdate)::TIMESTAMP, count(*) FILTER (o_orderdate >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR),
               max(o_orderdate) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR FROM orders)""")
def _(s, d):
    return au.freshness({"events": (ad.table(s, d, "events", "ts"), "ts"),
                         "orders": (ad.table(s, d, "orders", "o_orderdate"), "o_orderdate")}, ad.ntz("2024-01-30 12:00:00"))


@query("missing_canonical_source", sql("""
    SELECT 'missing_canonical_source' AS "check", 0::BIGINT AS expected, count(*) AS actual, count(*) = 0 AS passed
    FROM games WHERE slot % 2 = 0 AND NOT is_overtime""", "games"))
def _(s, d):
    g = _games_with_ids(s, d).withColumn("canonical_source", F.when(F.col("is_overtime"), "ohsla"))
    records = g.select("game_id", F.when(F.col("slot") % 2 == 0, "ohsla").otherwise("backfill").alias("source"))
    return au.missing_canonical_source(g, records)


@query("schema_growth_sync", """
    WITH b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS load_time, count(*) FILTER (event_type <> 'error') AS new_rows,
                      count(*) FILTER (event_type <> 'click') AS legacy_rows FROM events GROUP BY 1)
    SELECT load_time, new_rows, legacy_rows, new_rows - lag(new_rows) OVER (ORDER BY load_time) AS new_delta,
           legacy_rows - lag(legacy_rows) OVER (ORDER BY load_time) AS legacy_delta, new_rows = legacy_rows AS in_sync FROM b""")
def _(s, d):
    ev = ad.table(s, d, "events", "ts", "event_type")
    return au.schema_growth_sync(ev.filter("event_type <> 'error'"), ev.filter("event_type <> 'click'"), "ts").withColumn(
        "load_time", F.col("load_time").cast("timestamp_ntz"))


@query("growth_since_last", sql("""
    SELECT source, captured_at, n, n - lag(n) OVER (PARTITION BY source ORDER BY captured_at) AS growth
    FROM (SELECT source, captured_at, count(*) AS n FROM rank_history GROUP BY ALL)""", "rank_history"))
def _(s, d):
    loads = rc.group_counts(ad.rank_history(s, d), ["source", "captured_at"])
    return au.growth_since_last(loads, ["source"], "captured_at", "n")


@query("soak_gate", sql("""
    SELECT count(*) AS clean_runs, min(scraped_at) AS first_clean, max(scraped_at) AS last_clean,
           (epoch_us(max(scraped_at)) - epoch_us(min(scraped_at))) // 1000000 AS span_seconds,
           count(*) >= 3 AND epoch_us(max(scraped_at)) - epoch_us(min(scraped_at)) >= 172800000000 AS passed
    FROM run_log WHERE status = 'success' AND scraped_at > (SELECT max(scraped_at) FROM run_log WHERE status <> 'success')""", "run_log"))
def _(s, d):
    return au.soak_gate(ad.run_log(s, d), "scraped_at", F.col("status") == "success")


@query("traffic_ratio_streak", """
    WITH q AS (SELECT ts::DATE AS day FROM events GROUP BY 1
               HAVING count(*) FILTER (event_type = 'signup') < 0.26 * count(*) FILTER (event_type <> 'signup')),
         i AS (SELECT day, day - row_number() OVER (ORDER BY day)::INTEGER AS island FROM q)
    SELECT min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS streak_days,
           CASE WHEN count(*) >= 3 THEN (min(day) + 2)::VARCHAR END AS reached_on FROM i GROUP BY island""")
def _(s, d):
    return au.traffic_ratio_streak(ad.table(s, d, "events", "ts", "event_type"), "ts", F.col("event_type") == "signup", 0.26, 3)


@query("domain_check", sql("""
    SELECT 'domain_status' AS "check", 0::BIGINT AS expected, count(*) FILTER (slot = 7) AS actual, count(*) FILTER (slot = 7) = 0 AS passed FROM games
    UNION ALL SELECT 'domain_season', 0, 0, true
    UNION ALL SELECT 'domain_game_state', 0, 0, true
    UNION ALL SELECT 'domain_snapshot_source', 0, count(*) FILTER (slot = 5), count(*) FILTER (slot = 5) = 0 FROM games
    UNION ALL SELECT 'domain_role', 0, count(*) FILTER (slot = 4), count(*) FILTER (slot = 4) = 0 FROM games
    UNION ALL SELECT 'domain_slot', 0, 0, true
    UNION ALL SELECT 'domain_home_score', 0, count(*) FILTER (home_score = 0), count(*) FILTER (home_score = 0) = 0 FROM games""", "games"))
def _(s, d):
    slot = F.col("slot")
    g = ad.games(s, d).withColumns({
        "status": F.when(slot == 7, "unknown").otherwise(F.col("status")), "home_score": F.col("home_score") - 1,
        "game_state": F.get(F.array(*map(F.lit, GAME_STATE)), (slot % len(GAME_STATE)).cast("int")),
        "snapshot_source": F.when(slot == 5, "backfill").otherwise(F.get(F.array(*map(F.lit, SNAPSHOT_SOURCE)), (slot % 2).cast("int"))),
        "role": F.when(slot == 4, "manager").otherwise(F.get(F.array(*map(F.lit, COACH_ROLE)), (slot % 2).cast("int")))})
    legal = {"status": GAME_STATUS, "game_state": GAME_STATE, "snapshot_source": SNAPSHOT_SOURCE, "role": COACH_ROLE}
    return au.domain_check(g, legal, {"season": SMALLINT_UNSIGNED, "home_score": SMALLINT_UNSIGNED, "slot": TINYINT_UNSIGNED})


@query("recent_records", sql("""
    SELECT season || '-' || home_team_id || '-' || away_team_id || '-' || game_date AS game_id, 'ohsla' AS source,
           game_date::TIMESTAMP + to_minutes(slot) AS scraped_at, 's' || home_team_id AS home, 's' || away_team_id AS away
    FROM games WHERE slot < 7 AND game_date::TIMESTAMP + to_minutes(slot) >= TIMESTAMP '2001-11-01 01:00:00' - INTERVAL 48 HOUR
    ORDER BY scraped_at DESC, game_id LIMIT 20""", "games"))
def _(s, d):
    g = _games_with_ids(s, d)
    at = F.col("game_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("slot"))
    records = g.select("game_id", F.when(F.col("slot") < 7, "ohsla").otherwise("backfill").alias("source"), at.alias("scraped_at"))
    return au.recent_records(records, g, ad.teams(s, d), ad.ntz("2001-11-01 01:00:00"), 48)


@query("gate", sql("""
    SELECT 'null_team_id_games' AS "check", true AS passed
    UNION ALL SELECT 'orphaned_records', true
    UNION ALL SELECT 'games_missing_record', count(*) = 0 FROM games WHERE is_overtime
    UNION ALL SELECT 'not_yet_computed', true
    UNION ALL SELECT 'unique_games', true""", "games"))
def _(s, d):
    g = _games_with_ids(s, d)
    records = rt.source_records(g.filter("NOT is_overtime"), ad.teams(s, d), "backfill", ad.ntz(AS_OF))
    with shuffle_slots(s, ad.game_slots(s, d)):
        return durable(au.gate([
            au.count_metric(g.filter("home_team_id IS NULL OR away_team_id IS NULL"), "null_team_id_games"),
            au.count_metric(au.orphans(records, "game_id", g, "game_id"), "orphaned_records"),
            au.count_metric(au.missing_children(g, "game_id", records, "game_id"), "games_missing_record"),
            au.not_computed(fresh_seasons(s, d), ad.teams(s, d)),
            au.unique_key_check({"games": g}, KEYS)]))


def _unique_sql(table: str, *columns: str) -> str:
    names = ",".join(columns)
    return f"""SELECT '{table}.unique({names})' AS "check", 0::BIGINT AS expected, count(*) AS actual, count(*) = 0 AS passed
        FROM (SELECT 1 FROM {table} GROUP BY {names} HAVING count(*) > 1)"""


def _none_sql(table: str, name: str, condition: str) -> str:
    return f"SELECT '{table}.{name}', 0::BIGINT, count(*) FILTER ({condition}), count(*) FILTER ({condition}) = 0 FROM {table}"


@query("table_checks", sql(" UNION ALL ".join([
    _unique_sql("games", *KEYS["games"]), _unique_sql("games", "season", "game_date"), _unique_sql("games", "game_date", "venue_id"),
    _none_sql("games", "null_team", "home_team_id IS NULL OR away_team_id IS NULL"), _none_sql("games", "no_score", "home_score IS NULL OR away_score IS NULL"),
    _none_sql("games", "tie", "home_score = away_score"), _none_sql("schedule", "no_time", "game_time IS NULL"),
    _unique_sql("schedule", *KEYS["schedule"]), _unique_sql("schedule", "team_id", "game_date"),
    _none_sql("teams", "no_venue", "home_venue_id IS NULL")]), "games", "schedule", "teams"))
def _(s, d):
    c = F.col
    with shuffle_slots(s, ad.game_slots(s, d)):
        return durable(au.table_checks(
            {"games": ad.games(s, d), "schedule": ad.schedule(s, d), "teams": ad.teams(s, d)},
            {"games": {"null_team": c("home_team_id").isNull() | c("away_team_id").isNull(),
                       "no_score": c("home_score").isNull() | c("away_score").isNull(), "tie": c("home_score") == c("away_score")},
             "schedule": {"no_time": c("game_time").isNull()}, "teams": {"no_venue": c("home_venue_id").isNull()}},
            {"games": [KEYS["games"], ["season", "game_date"], ["game_date", "venue_id"]], "schedule": [KEYS["schedule"], ["team_id", "game_date"]]}))
