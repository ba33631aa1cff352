"""Records, ratings, snapshots, reshaping and served queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scorebook.functions import clean
from scorebook.operators import ratings as rt
from scorebook.operators import records as rc
from scorebook.operators import reshape as rs
from scorebook.operators import serve
from scorebook.operators import sketches as sk
from scorebook.plans import adapters as ad
from scorebook.plans.adapters import sql
from scorebook.plans.registry import SQL, query
from scorebook.session import durable, scratch_path, shuffle_slots
from scorebook.sources import layout

AS_OF = "2026-05-01 00:00:00"
BUCKETS = 8


def fresh_seasons(s, d):
    return rc.refresh_record(ad.team_seasons(s, d), rc.season_record(ad.games(s, d)), ad.ntz(AS_OF))


# --- reshaping and duplicates ---------------------------------------------------------

@query("neutral_to_perspective", sql("""
    SELECT season, game_date::VARCHAR AS game_date, me AS team_id, opp AS opponent_id, is_home, my_score, opp_score,
           status FROM sides""", "sides"))
def _(s, d):
    return rs.to_perspective(ad.games(s, d)).select(
        "season", "game_date", "team_id", "opponent_id", "is_home", "my_score", "opp_score", "status")


NEUTRAL_COLUMNS = """season, home_team_id, away_team_id, game_date::VARCHAR AS game_date, game_datetime, venue_id,
    is_conference, is_overtime, is_scrimmage, home_score, away_score, status, canonical_source, has_conflict"""


@query("perspective_to_neutral", sql(f"SELECT {NEUTRAL_COLUMNS} FROM neutral", "neutral"))
def _(s, d):
    return rs.to_neutral(ad.schedule(s, d), ad.aliases(s, d), ad.teams(s, d))


DEDUP_KEYS = ["season", "home_team_id", "away_team_id"]


@query("dedup_first_by_key", sql("""
    SELECT season, home_team_id, away_team_id, game_date::VARCHAR AS game_date, status FROM games
    QUALIFY row_number() OVER (PARTITION BY season, home_team_id, away_team_id ORDER BY games.game_date) = 1""", "games"))
def _(s, d):
    return rs.dedup_first(ad.games(s, d), DEDUP_KEYS, ["game_date"]).select(*DEDUP_KEYS, "game_date", "status")


@query("dedup_unordered_pair", sql("""
    SELECT DISTINCT least(home_team_id, away_team_id) AS team_a, greatest(home_team_id, away_team_id) AS team_b,
           game_date::VARCHAR AS game_date FROM games""", "games"))
def _(s, d):
    return rs.dedup_pair(ad.games(s, d), "home_team_id", "away_team_id", "game_date")


@query("duplicate_rows", """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(s, d):
    return rs.duplicates(ad.table(s, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("distinct_events", sql("SELECT DISTINCT source, season, captured_at FROM rank_history", "rank_history"))
def _(s, d):
    return rs.distinct_events(ad.rank_history(s, d), ["source", "season", "captured_at"])


@query("union_all_counts", sql("""
    SELECT 'games' AS tbl, count(*) AS n FROM games UNION ALL SELECT 'teams', count(*) FROM teams
    UNION ALL SELECT 'team_aliases', count(*) FROM aliases UNION ALL SELECT 'rankings', count(*) FROM rankings""",
    "games", "teams", "aliases", "rankings"))
def _(s, d):
    return rs.stack_counts({"games": ad.games(s, d), "teams": ad.teams(s, d), "team_aliases": ad.aliases(s, d),
                            "rankings": ad.rankings(s, d)})


# --- aggregates -----------------------------------------------------------------------

@query("team_season_record", sql("SELECT team_id, season, wins, losses FROM record", "record"))
def _(s, d):
    return rc.season_record(ad.games(s, d))


@query("refresh_record_cache", sql("SELECT * FROM fresh_seasons", "fresh_seasons"))
def _(s, d):
    return fresh_seasons(s, d)


@query("record_parity", sql("""
    SELECT sum(wins)::BIGINT AS total_wins, sum(losses)::BIGINT AS total_losses,
           (sum(wins) - sum(losses))::BIGINT AS oos_delta FROM fresh_seasons""", "fresh_seasons"))
def _(s, d):
    return rc.record_parity(fresh_seasons(s, d))


@query("zero_record_teams", sql("""
    SELECT slug, season, wins, losses FROM team_seasons LEFT JOIN teams USING (team_id)
    WHERE state = 'OR' AND wins = 0 AND losses = 0""", "team_seasons", "teams"))
def _(s, d):
    return rc.zero_record(ad.team_seasons(s, d), ad.teams(s, d))


@query("group_size_counts", sql("SELECT state, conference, count(*) AS n FROM teams GROUP BY ALL", "teams"))
def _(s, d):
    return rc.group_counts(ad.teams(s, d), ["state", "conference"])


@query("value_histogram", sql("""
    SELECT game_time AS value, length(game_time)::INTEGER AS len, count(*) AS occurrences FROM schedule
    GROUP BY ALL""", "schedule"))
def _(s, d):
    return rc.value_histogram(ad.schedule(s, d), "game_time")


@query("min_max_range", sql("""
    SELECT min(game_date)::VARCHAR AS earliest, max(game_date)::VARCHAR AS latest,
           max(length(game_date::VARCHAR))::INTEGER AS max_len FROM schedule""", "schedule"))
def _(s, d):
    return rc.min_max(ad.schedule(s, d), "game_date")


APPEARANCES = """
    SELECT least(lower(trim(team_id)), lower(trim(opponent))) AS team_a,
           greatest(lower(trim(team_id)), lower(trim(opponent))) AS team_b, game_date, count(*) AS appearances
    FROM schedule GROUP BY ALL"""


@query("appearance_histogram", sql(f"""
    SELECT appearances, count(*) AS matchups FROM ({APPEARANCES}) GROUP BY appearances""", "schedule"))
def _(s, d):
    return rc.appearance_histogram(ad.schedule(s, d), clean.normalize_name("team_id"),
                                   clean.normalize_name("opponent"), "game_date")


@query("distinct_matchups", sql(f"SELECT count(*) AS distinct_matchups FROM ({APPEARANCES})", "schedule"))
def _(s, d):
    return rc.distinct_matchups(ad.schedule(s, d), clean.normalize_name("team_id"),
                                clean.normalize_name("opponent"), "game_date")


SKETCH_LG_K = 12


def _load_sketches(s, d):
    """Sketches of every month's load, merged to seasons."""
    rows = ad.schedule(s, d).withColumn("load", F.month("game_date"))
    matchup = sk.matchup_key(clean.normalize_name("team_id"), clean.normalize_name("opponent"), "game_date")
    loads = sk.load_sketches(rows, ["season", "load"], {"matchups": matchup}, {"times": F.col("game_time")}, SKETCH_LG_K)
    return sk.merge_sketches(loads, ["season"], ["matchups"], ["times"])


@query("merged_distinct_matchups", sql(f"""
    SELECT season, count(*) AS distinct_matchups, true AS within_bound
    FROM ({APPEARANCES.replace("SELECT least", "SELECT season, least")}) GROUP BY season""", "schedule"))
def _(s, d):
    # The exact counts stand beside what the merged sketches say, within four standard errors.
    pair = clean.ordered_pair(clean.normalize_name("team_id"), clean.normalize_name("opponent"))
    exact = ad.schedule(s, d).groupBy("season").agg(F.count_distinct(*pair, F.col("game_date")).alias("distinct_matchups"))
    merged = sk.distinct_counts(_load_sketches(s, d), ["matchups"]).select("season", "matchups")
    off = F.abs(F.col("matchups") - F.col("distinct_matchups"))
    return exact.join(merged, "season").select(
        "season", "distinct_matchups", (off <= 4 * sk.distinct_error(SKETCH_LG_K) * F.col("distinct_matchups")).alias("within_bound"))


@query("merged_value_histogram", sql("""
    SELECT season, game_time AS value, count(*) AS occurrences FROM schedule WHERE game_time IS NOT NULL GROUP BY ALL""", "schedule"))
def _(s, d):
    # Clock times are few, so the sketches hold all of them and their counts are exact.
    return sk.frequent_values(_load_sketches(s, d), ["season"], "times", 100)


@query("having_min_count", sql("""
    SELECT season, team_id, count(*) AS n FROM schedule GROUP BY ALL HAVING count(*) < 160""", "schedule"))
def _(s, d):
    return rc.groups_below(ad.schedule(s, d), ["season", "team_id"], 160)


@query("conference_record", sql("""
    SELECT me AS team_id, season, count(*) FILTER (my_score > opp_score) AS conf_wins,
           count(*) FILTER (my_score < opp_score) AS conf_losses
    FROM sides WHERE status = 'completed' AND NOT is_scrimmage AND is_conference AND my_score IS NOT NULL
    GROUP BY me, season""", "sides"))
def _(s, d):
    return rc.conference_record(ad.games(s, d))


def stats_cte(signed: bool = False) -> str:
    diff = "greatest(-10, least(my_score - opp_score, 10))" if signed else "least(abs(my_score - opp_score), 10)"
    return f"""
    SELECT season, me AS team_id,
           count(*) FILTER ((CASE WHEN is_home THEN my_score > opp_score ELSE opp_score > my_score END) = is_home) AS wins,
           count(*) FILTER ((CASE WHEN is_home THEN my_score > opp_score ELSE opp_score > my_score END) <> is_home) AS losses,
           count(*) AS games_played, sum({diff})::DOUBLE / count(*) AS agd
    FROM sides WHERE status = 'completed' AND NOT is_scrimmage AND my_score IS NOT NULL AND opp_score IS NOT NULL
    GROUP BY season, me"""


@query("team_game_stats", sql(f"""
    SELECT season, team_id, wins, losses, games_played, round(agd, 4) AS agd FROM ({stats_cte()})""", "sides"))
def _(s, d):
    return rc.team_game_stats(ad.games(s, d)).withColumn("agd", clean.round4("agd"))


# --- ratings and snapshots ----------------------------------------------------------------

@query("average_goal_diff", sql(f"SELECT season, team_id, round(agd, 4) AS agd FROM ({stats_cte()})", "sides"))
def _(s, d):
    return rt.average_goal_diff(rc.team_game_stats(ad.games(s, d))).withColumn("agd", clean.round4("agd"))


def ratings_sql(passes: int = 15, signed: bool = False, tail: str = "") -> str:
    steps = [f"st AS MATERIALIZED ({stats_cte(signed)})", """
        ed AS MATERIALIZED (SELECT season, me AS team_id, opp, count(*) AS n FROM sides
               WHERE status = 'completed' AND NOT is_scrimmage AND my_score IS NOT NULL AND opp_score IS NOT NULL
               GROUP BY ALL)""", "r0 AS MATERIALIZED (SELECT season, team_id, agd AS rating FROM st)"]
    for i in range(passes):
        steps.append(f"""
        r{i + 1} AS MATERIALIZED (SELECT st.season, st.team_id, any_value(st.agd) + sum(ed.n * r.rating) / any_value(st.games_played)
                 AS rating FROM st JOIN ed USING (season, team_id) JOIN r{i} r ON r.season = ed.season AND r.team_id = ed.opp
                 GROUP BY st.season, st.team_id)""")
    steps.append(f"""
        rated AS (SELECT season, team_id, round(rating, 4) AS rating, round(agd, 4) AS agd, round(rating - agd, 4) AS sched,
                  wins, losses, games_played FROM st JOIN r{passes} USING (season, team_id))""")
    return sql("", "sides").rstrip() + ", " + ", ".join(steps) + " " + (tail or "SELECT * FROM rated")


@query("power_ratings", ratings_sql())
def _(s, d):
    return rt.power_ratings(ad.games(s, d))


@query("power_ratings_signed", ratings_sql(signed=True))
def _(s, d):
    return rt.power_ratings(ad.games(s, d), signed=True)


@query("rank_by_rating", ratings_sql(tail="""
    SELECT season, team_id, rating, row_number() OVER (PARTITION BY season ORDER BY rating DESC, team_id) AS rank
    FROM rated"""))
def _(s, d):
    return rt.rank(rt.power_ratings(ad.games(s, d)).select("season", "team_id", "rating"), "rating", "team_id", ["season"])


@query("rank_with_ties", sql("""
    SELECT team_id, season, wins, rank() OVER (PARTITION BY season ORDER BY wins DESC) AS rank,
           dense_rank() OVER (PARTITION BY season ORDER BY wins DESC) AS dense FROM record""", "record"))
def _(s, d):
    rec = rc.season_record(ad.games(s, d)).drop("losses")
    ranked = rt.rank(rec, "wins", "team_id", ["season"], tie="rank")
    return rt.rank(ranked, "wins", "team_id", ["season"], tie="dense_rank", out="dense")


@query("weekly_ratings_upsert", ratings_sql(tail="""
    SELECT season, team_id, '2001-05-06' AS week_ending, rating, row_number() OVER (PARTITION BY season ORDER BY rating DESC, team_id) AS rank,
           agd, sched, wins, losses, games_played FROM rated
    UNION ALL SELECT season, team_id, '2001-04-29', 0.0::DOUBLE, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM rated"""))
def _(s, d):
    # An earlier week stays; a stale run of the same week is overwritten.
    columns = ["rating", "rank", "agd", "sched", "wins", "losses", "games_played"]
    rated = durable(rt.rank(rt.power_ratings(ad.games(s, d)), "rating", "team_id", ["season"]).select("season", "team_id", *columns))
    week = lambda t: F.lit(t).cast("date")
    zero = rated.withColumns({c: F.lit(0).cast(rated.schema[c].dataType) for c in columns})
    old = zero.withColumn("week_ending", F.explode(F.array(week("2001-04-29"), week("2001-05-06")))).select("season", "team_id", "week_ending", *columns)
    return rt.weekly_ratings(old, rated, week("2001-05-06"))


def hashed_sql(extra: str = "") -> str:
    row = "concat_ws('|', team_name, rank_position::VARCHAR, rating::VARCHAR, agd::VARCHAR, sched::VARCHAR, " \
          "record_wins::VARCHAR, record_losses::VARCHAR)"
    words = ", ".join(f"sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT)::VARCHAR" for i in range(4))
    return f"""SELECT source, season, captured_at, sha256(concat_ws(':', count(*)::VARCHAR, {words})) AS content_hash
        FROM (SELECT *, sha256({row}) AS h FROM rank_history) GROUP BY source, season, captured_at"""


@query("ranking_snapshots", sql(hashed_sql(), "rank_history"))
def _(s, d):
    return rt.snapshots(ad.rank_history(s, d))


@query("ranking_snapshots_by_day", sql("""
    SELECT DISTINCT source, season, captured_at, md5(concat_ws('|', source, season::VARCHAR, captured_at::DATE::VARCHAR))
           AS content_hash FROM rank_history""", "rank_history"))
def _(s, d):
    return rt.snapshots(ad.rank_history(s, d), hash_content=False)


@query("ranking_entries", sql("""
    SELECT r.source, season, captured_at, a.team_id, rank_position, round(rating, 2) AS rating, round(agd, 2) AS agd,
           round(sched, 2) AS sched, record_wins, record_losses
    FROM rank_history r JOIN aliases a ON a.alias_normalized = lower(trim(r.team_name))""", "rank_history", "aliases"))
def _(s, d):
    hist = ad.rank_history(s, d)
    return rt.entries(hist, rt.snapshots(hist), ad.aliases(s, d))


@query("skip_unchanged_snapshot", sql("""
    SELECT source, season, captured_at, content_hash FROM (
        SELECT *, lag(content_hash) OVER (PARTITION BY source, season ORDER BY captured_at) AS prev FROM (
            SELECT source, season, unnest([captured_at, captured_at + INTERVAL 3 DAY]) AS captured_at, content_hash FROM (""" + hashed_sql() + """)))
    WHERE prev IS NULL OR prev <> content_hash""", "rank_history"))
def _(s, d):
    # Every ranking is captured a second time three days later, with the same content.
    hist = ad.rank_history(s, d)
    later = F.col("captured_at") + F.make_dt_interval(days=F.lit(3))
    again = hist.withColumn("captured_at", F.explode(F.array(F.col("captured_at"), later)))
    return rt.skip_unchanged(rt.snapshots(again))


@query("canonical_source_pick", sql("""
    SELECT game_id, arg_max(home_score, p) AS home_score, arg_max(away_score, p) AS away_score,
           arg_max(source, p) AS canonical_source, count(*) AS sources,
           count(DISTINCT (home_score, away_score)) > 1 AS has_conflict
    FROM (SELECT *, CASE source WHEN 'ohsla' THEN 100 WHEN 'laxnumbers' THEN 50 ELSE 0 END AS p FROM source_scores)
    GROUP BY game_id""", "source_scores"))
def _(s, d):
    from scorebook.schemas import SOURCE_PRIORITY
    return rt.pick_canonical(ad.source_scores(s, d), s.createDataFrame(SOURCE_PRIORITY, "source string, priority int"))


GAME_ID_SQL = "season || '-' || home_team_id || '-' || away_team_id || '-' || game_date AS game_id"


@query("source_records", sql(f"""
    SELECT {GAME_ID_SQL}, 'backfill' AS source, 's' || home_team_id AS home_team_raw, 's' || away_team_id AS away_team_raw,
           home_score, away_score, TIMESTAMP '{AS_OF}' AS scraped_at FROM games""", "games"))
def _(s, d):
    g = ad.games(s, d).withColumn("game_id", ad.game_id())
    have = rt.source_records(g.filter("is_overtime"), ad.teams(s, d), "backfill", ad.ntz(AS_OF))
    return rt.source_records(g, ad.teams(s, d), "backfill", ad.ntz(AS_OF), have)


# --- served queries ---------------------------------------------------------------------------

@query("latest_success", sql("""
    SELECT max(scraped_at) AS last_success FROM run_log WHERE status = 'success'""", "run_log"))
def _(s, d):
    return serve.latest_success(ad.run_log(s, d))


RANKING_SQL = """rank_position AS rank, team_name AS "teamName", record, wins, losses"""


@query("rankings_by_season", sql(f"""
    SELECT {RANKING_SQL}, rating::DOUBLE AS rating, agd::DOUBLE AS agd, sched::DOUBLE AS sched,
           scraped_at AS "scrapedAt" FROM rankings WHERE season = 1998""", "rankings"))
def _(s, d):
    return serve.rankings(ad.rankings(s, d), 1998)


@query("rankings_updated", sql("""
    SELECT arg_min(scraped_at, rank_position) AS updated FROM rankings WHERE season = 1998""", "rankings"))
def _(s, d):
    return serve.rankings_updated(ad.rankings(s, d), 1998)


@query("rankings_consensus", sql(f"""
    SELECT {RANKING_SQL}, consensus::DOUBLE AS consensus, scraped_at AS "scrapedAt" FROM rankings_consensus
    WHERE season = 1998""", "rankings_consensus"))
def _(s, d):
    return serve.rankings_consensus(ad.rankings_consensus(s, d), 1998)


@query("rankings_both", sql(f"""
    SELECT {RANKING_SQL}, rating::DOUBLE AS rating, agd::DOUBLE AS agd, sched::DOUBLE AS sched, NULL::DOUBLE AS consensus,
           scraped_at AS "scrapedAt", 'laxnumbers' AS source FROM rankings WHERE season = 1998
    UNION ALL
    SELECT {RANKING_SQL}, NULL, NULL, NULL, consensus::DOUBLE, scraped_at, 'laxpower' FROM rankings_consensus
    WHERE season = 1998""", "rankings", "rankings_consensus"))
def _(s, d):
    return serve.rankings_both(ad.rankings(s, d), ad.rankings_consensus(s, d), 1998)


SCHEDULE_SQL = """game_date::VARCHAR AS "date", game_time AS "time", opponent, is_home AS "isHome",
    is_conference AS "isConference", result, team_score AS "teamScore", opp_score AS "oppScore", is_ot AS "isOT" """


@query("schedule_all", sql(f"""SELECT team_id AS "teamId", {SCHEDULE_SQL} FROM schedule WHERE season = 1998""", "schedule"))
def _(s, d):
    return serve.schedule_all(ad.schedule(s, d), 1998)


@query("schedule_by_team", sql(f"SELECT {SCHEDULE_SQL} FROM schedule WHERE season = 1998 AND team_id = 's3'", "schedule"))
def _(s, d):
    return serve.schedule_by_team(ad.schedule(s, d), "s3", 1998)


@query("schedule_by_team_bucketed", SQL["schedule_by_team"])
def _(s, d):
    with shuffle_slots(s, ad.game_slots(s, d)):
        stored = _bucketed(ad.schedule(s, d), ["team_id"])
    return serve.schedule_by_team(stored, "s3", 1998)


@query("refresh_record_bucketed", SQL["refresh_record_cache"])
def _(s, d):
    # Written once by their key, both sides meet without an exchange.
    key = ["team_id", "season"]
    return rc.refresh_record(_bucketed(ad.team_seasons(s, d), key), _bucketed(rc.season_record(ad.games(s, d)), key), ad.ntz(AS_OF))


def _bucketed(df, keys):
    name = f"bucketed_{uuid.uuid4().hex}"
    return layout.save_bucketed(df, name, scratch_path(df.sparkSession, name), BUCKETS, keys)


@query("playoff_games", sql("""
    SELECT team_id AS home_team_id, opp AS away_team, game_date::VARCHAR AS game_date, game_time,
           team_score AS home_score, opp_score AS away_score, scraped_at
    FROM (SELECT *, CASE WHEN is_conference THEN opponent ELSE 'TEAM Place holder' END AS opp FROM schedule)
    WHERE season = 1998 AND game_date >= DATE '1998-05-14' AND is_home AND lower(opp) <> 'team place holder'""", "schedule"))
def _(s, d):
    rows = ad.schedule(s, d).withColumn(
        "opponent", F.when(F.col("is_conference"), F.col("opponent")).otherwise("TEAM Place holder"))
    return serve.playoff_games(rows, 1998, "1998-05-14")


@query("upcoming_vs_completed", sql("""
    SELECT season, CASE WHEN h IS NOT NULL AND away_score IS NOT NULL THEN 'completed' ELSE 'scheduled' END AS status,
           count(*) AS n
    FROM (SELECT *, CASE WHEN slot < 5 THEN home_score END AS h FROM games) GROUP BY ALL""", "games"))
def _(s, d):
    # Some games lack one of the two scores only.
    g = ad.games(s, d).withColumn("home_score", F.when(F.col("slot") < 5, F.col("home_score"))).drop("status")
    return rc.group_counts(serve.with_status(g), ["season", "status"])


LIVE_SQL = """
    SELECT g.game_id, g.home_team_id, g.away_team_id, g.start_ts, l.home_score AS live_home, l.away_score AS live_away,
           l.game_state AS live_state, l.reporter_id AS live_reporter, l.last_updated_at AS live_at,
           l.game_id IS NOT NULL AS has_live
    FROM live_games g LEFT JOIN live l USING (game_id)"""


def _live_columns(df):
    return df.select("game_id", "home_team_id", "away_team_id", "start_ts", F.col("live.home_score").alias("live_home"),
                     F.col("live.away_score").alias("live_away"), F.col("live.game_state").alias("live_state"),
                     F.col("live.reporter_id").alias("live_reporter"), F.col("live.last_updated_at").alias("live_at"),
                     F.col("live").isNotNull().alias("has_live"))


@query("schedule_with_live", sql(LIVE_SQL, "live_games", "live"))
def _(s, d):
    from scorebook.streaming.live import live_upsert
    return _live_columns(serve.schedule_with_live(ad.live_games(s, d), live_upsert(ad.reports(s, d)), 2024))


@query("schedule_with_live_by_team", sql(LIVE_SQL + " WHERE g.home_team_id = 3 OR g.away_team_id = 3", "live_games", "live"))
def _(s, d):
    from scorebook.streaming.live import live_upsert
    return _live_columns(serve.schedule_with_live(
        ad.live_games(s, d), live_upsert(ad.reports(s, d)), 2024, "s3", ad.teams(s, d)))


@query("top_n", sql("""
    SELECT team_id, season, wins, losses FROM fresh_seasons ORDER BY wins + losses DESC, team_id, season LIMIT 10""",
    "fresh_seasons"))
def _(s, d):
    return serve.top_n(fresh_seasons(s, d).select("team_id", "season", "wins", "losses"),
                       [(F.col("wins") + F.col("losses")).desc(), F.col("team_id"), F.col("season")], 10)


@query("top_n_per_group", sql("""
    SELECT team_id, season, wins FROM record
    QUALIFY row_number() OVER (PARTITION BY season ORDER BY wins DESC, team_id) <= 3""", "record"))
def _(s, d):
    return serve.top_n(rc.season_record(ad.games(s, d)).drop("losses"), [F.desc("wins"), F.col("team_id")], 3, ["season"])
