"""Entity resolution, merges and logs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from scorebook.operators import repair as rp
from scorebook.operators import resolve as rv
from scorebook.operators import reshape as rs
from scorebook.plans import adapters as ad
from scorebook.plans.adapters import sql, text
from scorebook.plans.core_queries import AS_OF, NEUTRAL_COLUMNS
from scorebook.plans.registry import query
from scorebook.schemas import KEYS, REFERENCES, UPDATE_COLUMNS
from scorebook.session import scratch_path
from scorebook.sources import layout, readers, sinks


# --- resolution -----------------------------------------------------------------------

@query("build_alias_table", sql("SELECT team_id, alias, alias_normalized, source FROM aliases", "aliases"))
def _(s, d):
    return ad.aliases(s, d)


@query("alias_collisions", sql("""
    SELECT alias_normalized, count(DISTINCT team_id) AS teams, min(team_id) AS kept_by FROM alias_claims
    GROUP BY alias_normalized HAVING count(DISTINCT team_id) > 1""", "alias_claims"))
def _(s, d):
    return rv.alias_collisions(ad.alias_teams(s, d), ad.alias_variants(s, d))


@query("resolve_alias", sql("""
    SELECT s.season, s.team_id, s.game_date::VARCHAR AS game_date, opponent, a.team_id AS resolved_id
    FROM schedule s JOIN aliases a ON a.alias_normalized = lower(trim(s.opponent))""", "schedule", "aliases"))
def _(s, d):
    return rv.resolve(ad.schedule(s, d), "opponent", ad.aliases(s, d)).select(
        "season", "team_id", "game_date", "opponent", "resolved_id")


@query("resolve_two_stage", sql("""
    SELECT lower(trim(s.opponent)) AS normalized, s.opponent AS raw, count(*) AS occurrences,
           CASE WHEN a.slug IS NOT NULL THEN 'resolved_by_slug' WHEN b.slug IS NOT NULL THEN 'resolved_by_name'
                ELSE 'UNRESOLVED' END AS resolution_status, coalesce(a.slug, b.slug) AS resolved_to
    FROM schedule s LEFT JOIN (SELECT * FROM teams WHERE team_id % 10 <> 9) a ON lower(trim(a.slug)) = lower(trim(s.opponent))
    LEFT JOIN (SELECT * FROM teams WHERE team_id % 10 <> 9) b ON lower(trim(b.name)) = lower(trim(s.opponent))
    GROUP BY ALL""", "schedule", "teams"))
def _(s, d):
    return rv.resolve_two_stage(ad.schedule(s, d), "opponent", ad.alias_teams(s, d))


@query("unresolved_names", sql("""
    SELECT opponent AS raw_name, count(*) AS occurrences, min(game_date)::VARCHAR AS earliest, max(game_date)::VARCHAR AS latest
    FROM schedule s LEFT JOIN aliases a ON a.alias_normalized = lower(trim(s.opponent)) WHERE a.team_id IS NULL
    GROUP BY opponent""", "schedule", "aliases"))
def _(s, d):
    return rv.unresolved(ad.schedule(s, d), "opponent", ad.aliases(s, d), "game_date")


@query("unresolved_count", sql("""
    SELECT count(DISTINCT lower(trim(opponent))) AS unresolved_count FROM schedule s
    LEFT JOIN aliases a ON a.alias_normalized = lower(trim(s.opponent)) WHERE a.team_id IS NULL""", "schedule", "aliases"))
def _(s, d):
    return rv.unresolved_count(ad.schedule(s, d), "opponent", ad.aliases(s, d))


@query("unresolved_ledger", sql("""
    SELECT opponent AS raw_name, 'schedule' AS source, min(scraped_at) AS first_seen_at, max(scraped_at) AS last_seen_at,
           count(*) AS occurrence_count, any_value(f.team_id) AS resolved_team_id
    FROM schedule s LEFT JOIN aliases a ON a.alias_normalized = lower(trim(s.opponent))
    LEFT JOIN teams f ON lower(trim(f.slug)) = lower(trim(s.opponent))
    WHERE a.team_id IS NULL GROUP BY opponent""", "schedule", "aliases", "teams"))
def _(s, d):
    # Two loads folded one after the other; then slugs of all teams become known.
    from scorebook.schemas import TABLES
    sched = ad.schedule(s, d)
    miss = rv.resolve(sched, "opponent", ad.aliases(s, d), how="left").filter("resolved_id IS NULL").select(
        F.col("opponent").alias("raw_name"), F.lit("schedule").alias("source"), F.col("scraped_at").alias("seen_at"), "season")
    as_of = ad.ntz(AS_OF)
    empty = s.createDataFrame([], TABLES["unresolved_aliases"])
    first = rv.unresolved_ledger(empty, miss.filter("season < 1998").drop("season"), as_of)
    slugs = ad.teams(s, d).select("team_id", F.col("slug").alias("alias_normalized"))
    return rv.unresolved_ledger(first, miss.filter("season >= 1998").drop("season"), as_of, slugs)


@query("repair_and_reinsert", sql(f"SELECT {NEUTRAL_COLUMNS} FROM neutral", "neutral"))
def _(s, d):
    # Games loaded while only display names were known, then the rest after repair.
    sched, teams = ad.schedule(s, d), ad.teams(s, d)
    full = ad.aliases(s, d)
    partial = full.filter("team_id % 3 <> 0")
    return rs.reinsert_dropped(rs.to_neutral(sched, partial, teams), sched, full, teams)


def _repair_sql(rounds: int) -> str:
    """The rounds written out one after the other; one more than the tables need proposes nothing."""
    steps = ["""known0 AS (SELECT alias_normalized, team_id FROM aliases WHERE NOT (CASE WHEN alias_normalized LIKE 'supplier#%'
                 THEN team_id % 3 = 0 ELSE team_id % 5 = 0 END)),
        told AS (SELECT season, game_date, is_home, lower(trim(team_id)) AS me, lower(trim(opponent)) AS opp,
                 CASE WHEN is_home THEN team_score ELSE opp_score END AS hs, CASE WHEN is_home THEN opp_score ELSE team_score END AS aws FROM schedule)"""]
    for i in range(1, rounds + 1):
        steps.append(f"""
        r{i} AS (SELECT t.*, a.team_id AS me_id, b.team_id AS opp_id FROM told t LEFT JOIN known{i - 1} a ON a.alias_normalized = me
                 LEFT JOIN known{i - 1} b ON b.alias_normalized = opp),
        e{i} AS (SELECT o.opp AS name, m.me_id AS found, o.season, o.game_date, o.me_id AS other FROM r{i} o JOIN r{i} m
                   ON m.season = o.season AND m.game_date = o.game_date AND m.hs = o.hs AND m.aws = o.aws AND m.is_home <> o.is_home
                  AND m.opp_id = o.me_id AND m.me_id <> o.me_id WHERE o.opp_id IS NULL
                 UNION ALL
                 SELECT o.me, m.opp_id, o.season, o.game_date, o.opp_id FROM r{i} o JOIN r{i} m
                   ON m.season = o.season AND m.game_date = o.game_date AND m.hs = o.hs AND m.aws = o.aws AND m.is_home <> o.is_home
                  AND m.me_id = o.opp_id AND m.opp_id <> o.opp_id WHERE o.me_id IS NULL),
        f{i} AS (SELECT name, min(found) AS team_id, count(DISTINCT found) AS candidates, count(DISTINCT (season, game_date, other)) AS evidence
                 FROM e{i} GROUP BY name),
        known{i} AS (FROM known{i - 1} UNION ALL SELECT name, team_id FROM f{i} WHERE candidates = 1)""")
    added = " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS round, name AS alias_normalized, team_id, evidence AS n, 1::BIGINT AS candidates FROM f{i} WHERE candidates = 1"
        for i in range(1, rounds + 1))
    return sql(f"""SELECT * FROM (WITH {", ".join(steps)} {added} UNION ALL
        SELECT NULL, name, NULL, count(*), coalesce(any_value(f{rounds}.candidates), 0)
        FROM (SELECT me AS name FROM r{rounds} WHERE me_id IS NULL UNION ALL SELECT opp FROM r{rounds} WHERE opp_id IS NULL)
        LEFT JOIN f{rounds} USING (name) GROUP BY name)""", "schedule", "aliases")


def _short_of_aliases(s, d):
    """Aliases without the display name of every third and the slug of every fifth team."""
    gone = F.when(F.col("alias_normalized").startswith("supplier#"), F.col("team_id") % 3 == 0).otherwise(F.col("team_id") % 5 == 0)
    return ad.aliases(s, d).filter(~gone)


def _repaired(s, d):
    sched, teams, short = ad.schedule(s, d), ad.teams(s, d), _short_of_aliases(s, d)
    return rp.repair_rounds(rs.to_neutral(sched, short, teams), sched, short, teams, max(8, ad.game_slots(s, d)))


@query("repair_rounds", _repair_sql(4))
def _(s, d):
    done = _repaired(s, d)
    none = F.lit(None)
    return done.added.withColumn("candidates", F.lit(1).cast("long")).withColumnRenamed("evidence", "n").unionByName(
        done.open.select(none.cast("int").alias("round"), "alias_normalized", none.cast("long").alias("team_id"),
                         F.col("occurrences").alias("n"), "candidates"))


@query("map_update", """
    SELECT s_suppkey AS team_id, CASE WHEN s_suppkey % 5 <> 0 THEN n_nationkey END AS home_venue_id
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def _(s, d):
    t = ad.table(s, d, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("team_id"), "s_nationkey", F.lit(None).cast("int").alias("home_venue_id"))
    mapping = t.filter("team_id % 5 <> 0").select("team_id", text("NATION_", F.col("s_nationkey")).alias("label"))
    return rv.map_update(t, mapping, "team_id", "label", ad.table(s, d, "nation"), "n_name", "n_nationkey",
                         "home_venue_id").select("team_id", "home_venue_id")


@query("link_many_to_many", """
    SELECT s_suppkey AS team_id, c_custkey AS coach_id, 2026::INTEGER AS season,
           CASE WHEN c_custkey % 2 = 0 THEN 'head' ELSE 'assistant' END AS role,
           CASE WHEN c_custkey % 10 = 0 THEN 'old' ELSE 'seed' END AS source
    FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)""")
def _(s, d):
    n = ad.team_count(s, d)
    cust = ad.table(s, d, "customer", "c_custkey", "c_name")
    role = F.when(F.col("c_custkey") % 2 == 0, "head").otherwise("assistant")
    pairs = cust.select(ad.team_name(F.col("c_custkey") % n).alias("name"), F.col("c_name").alias("full_name"),
                        F.lit(2026).alias("season"), role.alias("role"), F.lit("seed").alias("source"))
    coaches = cust.select(F.col("c_name").alias("full_name"), F.col("c_custkey").alias("coach_id"))
    old = cust.filter("c_custkey % 10 = 0").select(
        (F.col("c_custkey") % n).alias("team_id"), F.col("c_custkey").alias("coach_id"), F.lit(2026).alias("season"),
        role.alias("role"), F.lit("old").alias("source"))
    return rv.link(pairs, ad.teams(s, d), "name", "team_id", coaches, "full_name", "coach_id", old)


@query("seed_group_assignment", """
    SELECT s_suppkey AS team_id, 2026::INTEGER AS season, r_name AS conference
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(s, d):
    members = ad.table(s, d, "nation").join(ad.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("conference"), F.col("n_name").alias("place"))
    t = ad.table(s, d, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("team_id"), text("NATION_", F.col("s_nationkey")).alias("place"))
    return rv.assign_groups(t, members, "place", 2026)


@query("self_not_exists", sql("""
    SELECT g.season, g.team_id, g.game_date::VARCHAR AS game_date, g.opponent, g.is_home FROM schedule g
    WHERE g.is_home OR NOT EXISTS (SELECT 1 FROM schedule h WHERE h.is_home
        AND lower(trim(h.team_id)) = lower(trim(g.opponent)) AND lower(trim(h.opponent)) = lower(trim(g.team_id))
        AND h.game_date = g.game_date)""", "schedule"))
def _(s, d):
    from scorebook.functions.clean import normalize_name
    p = ad.schedule(s, d).withColumns({"_t": normalize_name("team_id"), "_o": normalize_name("opponent")})
    return rv.prefer_or_unmatched(p, "is_home", ["_o", "_t", "game_date"], ["_t", "_o", "game_date"]).select(
        "season", "team_id", "game_date", "opponent", "is_home")


# --- merges ----------------------------------------------------------------------------

def _two_loads(s, d):
    """Rankings and a second load: half of the keys again, some new, one twice."""
    old = ad.rankings(s, d)
    key = F.col("rank_position")
    again = old.filter(key % 2 == 0).withColumns({
        "team_name": F.upper("team_name"), "wins": F.col("wins") + 1, "season": F.col("season"),
        "scraped_at": ad.ntz("2026-03-02 00:00:00")})
    extra = old.filter(key % 5 == 0).withColumns({"season": F.lit(2030), "scraped_at": ad.ntz("2026-03-02 00:00:00")})
    late = again.filter(key % 4 == 0).withColumns({"wins": F.col("wins") + 100, "scraped_at": ad.ntz("2026-03-03 00:00:00")})
    return old, again.unionByName(extra).unionByName(late)


UPSERT_SQL = sql("""
    SELECT season, rank_position, CASE WHEN rank_position % 2 = 0 THEN upper(team_name) ELSE team_name END AS team_name,
           (wins + CASE WHEN rank_position % 4 = 0 THEN 101 WHEN rank_position % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS wins,
           CASE WHEN rank_position % 4 = 0 THEN TIMESTAMP '2026-03-03' WHEN rank_position % 2 = 0 THEN TIMESTAMP '2026-03-02'
                ELSE scraped_at END AS scraped_at FROM rankings
    UNION ALL SELECT 2030, rank_position, team_name, wins, TIMESTAMP '2026-03-02' FROM rankings WHERE rank_position % 5 = 0
    """, "rankings")


@query("upsert", UPSERT_SQL)
def _(s, d):
    old, batch = _two_loads(s, d)
    return sinks.upsert_table("rankings", old, batch, ["scraped_at"]).select(
        "season", "rank_position", "team_name", "wins", "scraped_at")


@query("upsert_partitioned", UPSERT_SQL)
def _(s, d):
    """The same loads into a table stored by season: the batch brings seasons one by one, each rewrites its own partition."""
    old, batch = _two_loads(s, d)
    path = scratch_path(s, "rankings")
    old.write.partitionBy("season").parquet(path)
    for part in (batch.filter("season < 1998"), batch.filter("season >= 1998")):
        sinks.upsert_partitions(s, path, part, KEYS["rankings"], UPDATE_COLUMNS["rankings"], ["scraped_at"], ["season"])
    return s.read.schema(old.schema).parquet(path).select("season", "rank_position", "team_name", "wins", "scraped_at")


def _reload(s, d, null_safe):
    # The side in the name makes the declared key unique, as the stored table has it.
    sched = ad.schedule(s, d).drop("is_scrimmage").withColumn(
        "opponent", F.when(F.col("is_home"), F.col("opponent")).otherwise(text("vs ", F.col("opponent"))))
    again = sched.filter("season >= 1999").withColumns(
        {"team_score": F.col("team_score") + 1, "season": F.lit(1900), "scraped_at": ad.ntz(AS_OF)})
    return sinks.upsert_schedule(sched, again, ["scraped_at"], null_safe).select(
        "season", "team_id", "game_date", "opponent", "game_time", "team_score")


@query("upsert_schedule", sql("""
    SELECT season, team_id, game_date::VARCHAR AS game_date, CASE WHEN is_home THEN opponent ELSE 'vs ' || opponent END AS opponent, game_time,
           CASE WHEN season >= 1999 AND game_time IS NOT NULL THEN team_score + 1 ELSE team_score END AS team_score FROM schedule
    UNION ALL SELECT 1900, team_id, game_date::VARCHAR, CASE WHEN is_home THEN opponent ELSE 'vs ' || opponent END, game_time, team_score + 1 FROM schedule
    WHERE season >= 1999 AND game_time IS NULL""", "schedule"))
def _(s, d):
    return _reload(s, d, null_safe=False)


@query("upsert_schedule_null_safe", sql("""
    SELECT season, team_id, game_date::VARCHAR AS game_date, CASE WHEN is_home THEN opponent ELSE 'vs ' || opponent END AS opponent, game_time,
           CASE WHEN season >= 1999 THEN team_score + 1 ELSE team_score END AS team_score FROM schedule""", "schedule"))
def _(s, d):
    return _reload(s, d, null_safe=True)


@query("insert_ignore", sql("""
    SELECT season, rank_position, team_name, wins FROM rankings
    UNION ALL SELECT 2030, rank_position, team_name, wins FROM rankings WHERE rank_position % 5 = 0""", "rankings"))
def _(s, d):
    old, batch = _two_loads(s, d)
    cols = ["season", "rank_position", "team_name", "wins"]
    return sinks.insert_ignore(old.select(*cols), batch, ["season", "rank_position"], ["scraped_at"])


@query("replace_partition", sql("""
    SELECT season, rank_position, team_name FROM rankings WHERE season <> 1998
    UNION ALL SELECT season, rank_position, upper(team_name) FROM rankings WHERE season = 1998 AND rank_position % 2 = 0""",
    "rankings"))
def _(s, d):
    old = ad.rankings(s, d).select("season", "rank_position", "team_name")
    new = old.filter("season = 1998 AND rank_position % 2 = 0").withColumn("team_name", F.upper("team_name"))
    return sinks.replace_partition(old, new, "season")


@query("append_log", sql(f"""
    SELECT source, teams_scraped, status, error_message, scraped_at FROM run_log
    UNION ALL SELECT source, count(*), 'success', NULL, TIMESTAMP '{AS_OF}' FROM rank_history GROUP BY source""",
    "run_log", "rank_history"))
def _(s, d):
    return sinks.append_log(ad.run_log(s, d), sinks.run_counts(ad.rank_history(s, d), "source", ad.ntz(AS_OF)))


@query("isolated_multi_source_load", f"""
    SELECT 'customers' AS source, count(*) AS teams_scraped, 'success' AS status, NULL::VARCHAR AS error_message,
           TIMESTAMP '{AS_OF}' AS scraped_at FROM customer
    UNION ALL SELECT 'broken', 0, 'error', 'source is down', TIMESTAMP '{AS_OF}'
    UNION ALL SELECT 'suppliers', count(*), 'success', NULL, TIMESTAMP '{AS_OF}' FROM supplier""")
def _(s, d):
    def broken():
        raise OSError("source is down")
    root = scratch_path(s, "load")
    return sinks.isolated_load(
        s, {"customers": lambda: ad.rankings_consensus(s, d), "broken": broken, "suppliers": lambda: ad.rankings(s, d)},
        lambda name, df: sinks.write_table(df, f"{root}/{name}"), ad.ntz(AS_OF))


@query("concurrent_multi_source_load", f"""
    SELECT 'customers' AS source, count(*) AS teams_scraped, 'success' AS status, NULL::VARCHAR AS error_message,
           TIMESTAMP '{AS_OF}' AS scraped_at FROM customer
    UNION ALL SELECT 'stuck', 0, 'error', 'no end after 2 seconds', TIMESTAMP '{AS_OF}'
    UNION ALL SELECT 'broken', 0, 'error', 'source is down', TIMESTAMP '{AS_OF}'
    UNION ALL SELECT 'suppliers', count(*), 'success', NULL, TIMESTAMP '{AS_OF}' FROM supplier""")
def _(s, d):
    """Four sources at once: two load, one fails, one sleeps ten minutes a row and is cancelled."""
    def broken():
        raise OSError("source is down")

    def stuck():
        return ad.table(s, d, "orders", "o_orderkey").withColumn("slept", F.expr("java_method('java.lang.Thread', 'sleep', 600000L)"))
    root = scratch_path(s, "load")
    return sinks.concurrent_load(
        s, {"customers": lambda: ad.rankings_consensus(s, d), "stuck": stuck, "broken": broken, "suppliers": lambda: ad.rankings(s, d)},
        lambda name, df: sinks.write_table(df, f"{root}/{name}"), ad.ntz(AS_OF), {"stuck": 2})


@query("quarantine_unreadable", """
    SELECT event_type AS source, count(*) FILTER (event_id % 7 <> 0) AS teams_scraped,
           CASE WHEN count(*) FILTER (event_id % 7 = 0) > 0 THEN 'error' ELSE 'success' END AS status,
           CASE WHEN count(*) FILTER (event_id % 7 = 0) > 0
                THEN count(*) FILTER (event_id % 7 = 0) || ' unreadable rows' END AS error_message,
           TIMESTAMP '2026-05-01' AS scraped_at FROM events GROUP BY event_type""")
def _(s, d):
    ev = ad.table(s, d, "events", "event_id", "event_type", "props").withColumn(
        "props", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")))
    parsed = F.from_json("props", "k int, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return sinks.run_counts(ev.withColumn("p", parsed), "event_type", ad.ntz(AS_OF),
                            failed=F.col("p._corrupt_record").isNotNull())


@query("snapshot_table_copy", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(s, d):
    return sinks.snapshot_copy(ad.table(s, d, "supplier"), "supplier")


@query("cascade_delete", sql("""
    SELECT 'cascade' AS rule, team_id AS child, team_id AS ref FROM aliases WHERE team_id % 4 <> 0
    UNION ALL SELECT 'set_null', team_id, CASE WHEN home_venue_id % 4 <> 0 THEN home_venue_id END FROM teams
    UNION ALL SELECT 'restrict', home_team_id, home_team_id FROM games WHERE home_team_id % 4 = 0""",
    "aliases", "teams", "games"))
def _(s, d):
    gone = ad.teams(s, d).filter("team_id % 4 = 0").select("team_id")
    part = lambda df, rule, child, ref: sinks.cascade_delete(df, gone, ref, "team_id", rule).select(
        F.lit(rule).alias("rule"), F.col(child).alias("child"), F.col(ref).alias("ref"))
    return (part(ad.aliases(s, d), "cascade", "team_id", "team_id")
            .unionByName(part(ad.teams(s, d), "set_null", "team_id", "home_venue_id"))
            .unionByName(part(ad.games(s, d), "restrict", "home_team_id", "home_team_id")))


@query("delete_rows", sql("""
    , gone_games AS (SELECT *, season || '-' || home_team_id || '-' || away_team_id || '-' || game_date AS game_id,
                            home_team_id % 8 = 0 OR away_team_id % 8 = 0 AS gone FROM games),
    held AS (SELECT t.team_id FROM teams t JOIN gone_games g ON NOT g.gone AND (g.home_team_id = t.team_id OR g.away_team_id = t.team_id)
             WHERE t.team_id % 4 = 0 GROUP BY 1),
    dead AS (SELECT team_id FROM teams WHERE team_id % 4 = 0 AND team_id NOT IN (SELECT team_id FROM held))
    SELECT 'teams' AS tbl, team_id::VARCHAR AS row_key, CASE WHEN home_venue_id % 5 <> 0 THEN home_venue_id::VARCHAR END AS ref FROM teams WHERE team_id NOT IN (SELECT team_id FROM dead)
    UNION ALL SELECT 'team_aliases', alias_normalized, team_id::VARCHAR FROM aliases WHERE team_id NOT IN (SELECT team_id FROM dead)
    UNION ALL SELECT 'team_seasons', season::VARCHAR, team_id::VARCHAR FROM team_seasons WHERE team_id NOT IN (SELECT team_id FROM dead)
    UNION ALL SELECT 'games', game_id, CASE WHEN venue_id % 5 <> 0 THEN venue_id::VARCHAR END FROM gone_games WHERE NOT gone
    UNION ALL SELECT 'game_source_records', 'backfill', game_id FROM gone_games WHERE NOT gone
    UNION ALL SELECT 'refused', team_id::VARCHAR, NULL FROM held""", "games", "teams", "aliases", "team_seasons"))
def _(s, d):
    """Teams, games and venues deleted together: a team goes only if all its games go too; records and aliases follow, venues are cleared."""
    # Stored by the id that requests and records name, so that games are shuffled for it once.
    name = f"delete_games_{uuid.uuid4().hex}"
    games = layout.deal_bucketed(ad.games(s, d).withColumn("game_id", ad.game_id()), name, scratch_path(s, name),
                                 max(8, ad.game_slots(s, d)), ["game_id"])
    tables = {"teams": ad.teams(s, d), "team_aliases": ad.aliases(s, d), "team_seasons": ad.team_seasons(s, d), "games": games,
              "venues": ad.venues(s, d), "game_source_records": games.select("game_id", F.lit("backfill").alias("source"))}
    done = sinks.delete_rows(tables, {
        "teams": ("team_id", ad.teams(s, d).filter("team_id % 4 = 0").select("team_id")),
        "games": ("game_id", games.filter("home_team_id % 8 = 0 OR away_team_id % 8 = 0").select("game_id")),
        "venues": ("venue_id", ad.venues(s, d).filter("venue_id % 5 = 0").select("venue_id"))}, REFERENCES)
    shown = {"teams": ("team_id", "home_venue_id"), "team_aliases": ("alias_normalized", "team_id"), "team_seasons": ("season", "team_id"),
             "games": ("game_id", "venue_id"), "game_source_records": ("source", "game_id")}
    parts = [done.tables[t].select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("row_key"), F.col(r).cast("string").alias("ref"))
             for t, (k, r) in shown.items()]
    refused = done.refused.select(F.lit("refused").alias("tbl"), F.col("key").alias("row_key"), F.lit(None).cast("string").alias("ref")).distinct()
    return reduce(lambda a, b: a.unionByName(b), [*parts, refused])


@query("dual_write", sql("""
    SELECT 'legacy' AS store, count(*) AS n FROM schedule UNION ALL SELECT 'neutral', count(*) FROM neutral""",
    "schedule", "neutral"))
def _(s, d):
    root, teams, aliases = scratch_path(s, "dual"), ad.teams(s, d), ad.aliases(s, d)
    sinks.dual_write(ad.schedule(s, d), [
        lambda df: sinks.write_table(df, f"{root}/legacy", partition_by=["season"]),
        lambda df: sinks.write_table(rs.to_neutral(df, aliases, teams), f"{root}/neutral", partition_by=["season"])])
    return rs.stack_counts({name: s.read.parquet(f"{root}/{name}") for name in ("legacy", "neutral")}).withColumnRenamed(
        "tbl", "store")


# --- readers -----------------------------------------------------------------------------

@query("read_json_rankings", """
    SELECT 2026::INTEGER AS season, (s_suppkey + 1)::INTEGER AS rank_position, s_name AS team_name,
           (s_suppkey % 15) || '-' || (s_nationkey % 12) AS record, (s_suppkey % 15)::INTEGER AS wins,
           (s_nationkey % 12)::INTEGER AS losses, round(s_acctbal / 10, 3) AS rating, round(s_nationkey / 4, 3) AS agd,
           round(s_suppkey % 8 / 8, 3) AS sched, TIMESTAMP '2026-05-01' AS scraped_at FROM supplier""")
def _(s, d):
    # Ranking objects written as JSON lines by one job and read back by the reader.
    path = scratch_path(s, "payload")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    name = text("  ", F.col("s_name"), " ")
    ad.table(s, d, "supplier").select(
        F.to_json(F.array(F.struct(
            (key + 1).alias("ranking"), name.alias("name"), (key % 15).alias("wins"), (nation % 12).alias("losses"),
            (F.col("s_acctbal") / 10).alias("rating"), (nation / 4).alias("agd"), (key % 8 / 8).alias("sched")))).alias("value")
    ).write.text(path)
    return readers.read_json_rankings(s, path, 2026, ad.ntz(AS_OF), multi_line=False)


@query("rejected_json_rankings", """SELECT '{"ranking": ' || s_suppkey || ', "name": [' AS record FROM supplier WHERE s_suppkey % 3 = 0""")
def _(s, d):
    # Every third line breaks off.
    path = scratch_path(s, "payload")
    key = F.col("s_suppkey")
    ad.table(s, d, "supplier").select(F.when(key % 3 == 0, text('{"ranking": ', key, ', "name": [')).otherwise(
        F.to_json(F.array(F.struct(key.alias("ranking"), F.col("s_name").alias("name"))))).alias("value")).write.text(path)
    return readers.rejected_json_rankings(s, path, multi_line=False).select("record")


@query("read_raw_pages", "SELECT page_id, url, sha256(html) AS html_sha256 FROM pages")
def _(s, d):
    return readers.read_raw_pages(s, f"{d}/pages.parquet").select("page_id", "url", F.sha2("html", 256).alias("html_sha256"))


@query("read_tables", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(s, d):
    return readers.read_table(s, d, "orders", ["o_orderkey", "o_totalprice"],
                              (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
