"""Live reports: batch forms, and streams run to completion over the events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorebook.operators import geo
from scorebook.operators import resolve as rv
from scorebook.plans import adapters as ad
from scorebook.plans.adapters import sql
from scorebook.plans.registry import SQL, query
from scorebook.session import scratch_path
from scorebook.sources.sinks import upsert
from scorebook.sources.readers import read_table_stream
from scorebook.streaming import live

REPORT_COLUMNS = "event_id, ts, reporter_id, game_id, home_score, away_score, game_state"
_REPORT = REPORT_COLUMNS.split(", ")


def report_stream(s, d):
    events = read_table_stream(s, d, ad.table(s, d, "events").schema, files="events.parquet")
    return ad.report_rows(events).select(*_REPORT)


def _run(df, s, name, mode="append"):
    """Run a stream until its input is used up; return what it wrote."""
    root = scratch_path(s, name)
    keep = lambda batch, i: batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/out/batch_id={i}")
    (df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return s.read.schema(df.schema.add("batch_id", "long")).option("basePath", f"{root}/out").parquet(f"{root}/out")


@query("semi_active_reporters", sql(f"""
    SELECT {REPORT_COLUMNS} FROM reports SEMI JOIN (FROM reporters WHERE is_active) USING (reporter_id)""", "reports", "reporters"))
def _(s, d):
    return rv.active_only(ad.reports(s, d).select(*_REPORT), ad.reporters(s, d))


HAVERSINE = """2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(v.lat - r.lat) / 2), 2)
    + cos(radians(r.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - r.lon) / 2), 2))))"""


@query("geofence_match", sql(f"""
    SELECT r.event_id, v.venue_id, round({HAVERSINE}, 3) AS distance_m FROM reports r, venues v
    WHERE abs(r.lat - v.lat) < 0.01 AND {HAVERSINE} <= 500""", "reports", "venues"))
def _(s, d):
    return geo.geofence(ad.reports(s, d), ad.venues(s, d)).select(
        "event_id", "venue_id", F.round("distance_m", 3).alias("distance_m"))


@query("game_window_match", sql("""
    SELECT r.event_id, g.game_id AS matched_game_id, g.venue_id, g.start_ts
    FROM (SELECT *, event_id % (SELECT n FROM nt) AS venue_id FROM reports) r JOIN live_games g USING (venue_id)
    WHERE r.ts BETWEEN g.start_ts - INTERVAL 30 MINUTE AND g.start_ts + INTERVAL 180 MINUTE""", "reports", "live_games", "nt"))
def _(s, d):
    r = ad.reports(s, d).withColumn("venue_id", F.col("event_id") % ad.team_count(s, d))
    return geo.game_window(r, ad.live_games(s, d)).select("event_id", "matched_game_id", "venue_id", "start_ts")


@query("stream_eligibility", sql(f"""
    SELECT r.event_id, v.venue_id, g.game_id AS matched_game_id
    FROM reports r SEMI JOIN (FROM reporters WHERE is_active) a USING (reporter_id), venues v, live_games g
    WHERE abs(r.lat - v.lat) < 0.01 AND {HAVERSINE} <= 500 AND g.venue_id = v.venue_id
      AND r.ts BETWEEN g.start_ts - INTERVAL 30 MINUTE AND g.start_ts + INTERVAL 180 MINUTE""",
    "reports", "reporters", "venues", "live_games"))
def _(s, d):
    return live.eligible(ad.reports(s, d), ad.venues(s, d), ad.live_games(s, d), ad.reporters(s, d)).select(
        "event_id", "venue_id", "matched_game_id")


ELIGIBLE_STREAM_LATENESS = "60 days"
ROWS_PER_FILE = 250_000


@query("stream_eligibility_stream", SQL["stream_eligibility"])
def _(s, d):
    # Games come in files of their own, in no order, some before and some after the reports on them; two micro-batches bring them all.
    def arriving(df, name):
        path, files = scratch_path(s, name), max(4, -(-df.count() // ROWS_PER_FILE))
        df.repartition(files, df.columns[0]).write.option("compression", "zstd").parquet(path)
        return read_table_stream(s, path, df.schema, files_per_trigger=-(-files // 2))

    matched = live.eligible_stream(
        arriving(ad.reports(s, d), "reports").select("event_id", "ts", "reporter_id", "lat", "lon"), ad.venues(s, d),
        arriving(ad.live_games(s, d).select("game_id", "venue_id", "start_ts"), "games"), ad.reporters(s, d), ELIGIBLE_STREAM_LATENESS)
    return _run(matched.select("event_id", "venue_id", "matched_game_id"), s, "eligible").drop("batch_id")


LIVE = "SELECT game_id, home_score, away_score, game_state, reporter_id, last_updated_at, event_id FROM live"


@query("live_score_upsert", sql(LIVE, "live"))
def _(s, d):
    return live.live_upsert(ad.reports(s, d))


@query("live_score_upsert_stream", sql(LIVE, "live"))
def _(s, d):
    # Update mode emits a game whenever it changes; the last batch that holds it is its state.
    out = _run(live.live_upsert(report_stream(s, d)), s, "live", "update")
    return out.groupBy("game_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("game_id", "batch_id")]),
                                               "batch_id").alias("l")).select("game_id", "l.*")


@query("live_score_from_state", sql(LIVE, "live"))
def _(s, d):
    root, rows = scratch_path(s, "state"), ad.reports(s, d).select(*_REPORT)
    rows.repartition(4, "event_id").write.parquet(f"{root}/reports")
    source = read_table_stream(s, f"{root}/reports", rows.schema, files_per_trigger=1)
    (live.live_upsert(source).writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.format("noop").mode("append").save())
     .option("checkpointLocation", f"{root}/live").trigger(availableNow=True).start().awaitTermination())
    return live.live_at(s, f"{root}/live")


LIMITED = """
    SELECT event_id, game_id, ts FROM (
        WITH RECURSIVE c AS (
            (SELECT game_id, ts, event_id FROM reports QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ts, event_id) = 1)
            UNION ALL
            SELECT game_id, (n).ts, (n).event_id FROM (
                SELECT c.game_id, min({'ts': r.ts, 'event_id': r.event_id}) AS n FROM c JOIN reports r
                  ON r.game_id = c.game_id AND r.ts >= c.ts + INTERVAL 30 MINUTE GROUP BY c.game_id))
        SELECT * FROM c)"""


@query("rate_limit", sql(LIMITED, "reports"))
def _(s, d):
    return live.rate_limit(ad.reports(s, d), 30 * 60, ("game_id",)).select("event_id", "game_id", "ts")


@query("rate_limit_by_reporter", sql(
    LIMITED.replace("game_id", "reporter_id").replace("30 MINUTE", "1440 MINUTE").replace("AS n FROM c", "AS n FROM c"), "reports"))
def _(s, d):
    return live.rate_limit(ad.reports(s, d), 24 * 3600, ("reporter_id",)).select("event_id", "reporter_id", "ts")


@query("rate_limit_stream", sql(LIMITED, "reports"))
def _(s, d):
    stream = _closed_stream(s, d)
    out = _run(live.rate_limit_stream(stream, 30 * 60, ("game_id",), "60 days", "1 day"), s, "limited")
    return out.select("event_id", "game_id", "ts")


def _closed_stream(s, d):
    """The reports over several files, out of order, with an end.

    A stream releases a report once a later one has passed it by the allowed
    lateness, so a closing report of its own game ends the input.
    """
    path = scratch_path(s, "reports")
    rows = ad.reports(s, d).select(*_REPORT)
    last = rows.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.make_dt_interval(days=F.lit(100))).alias("ts"),
        F.lit(-1).cast("long").alias("reporter_id"), F.lit(-1).cast("long").alias("game_id"), F.lit(0).alias("home_score"),
        F.lit(0).alias("away_score"), F.lit("final").alias("game_state"))
    rows.repartition(4, "event_id").write.parquet(path)
    last.write.mode("append").parquet(path)
    return read_table_stream(live.state_session(s), path, rows.schema, files_per_trigger=2)


FINALIZED = sql("""
    SELECT 'game' AS kind, g.game_id, coalesce(l.home_score, g.home_score) AS home_score,
           coalesce(l.away_score, g.away_score) AS away_score, CASE WHEN l.game_id IS NULL THEN g.status ELSE 'completed' END AS state
    FROM live_games g LEFT JOIN (FROM live WHERE game_state = 'final') l USING (game_id)
    UNION ALL SELECT 'live', game_id, home_score, away_score, game_state FROM live WHERE game_state <> 'final'""", "live_games", "live")


def _finalized(games, rest):
    return games.select(F.lit("game").alias("kind"), "game_id", "home_score", "away_score", F.col("status").alias("state")).unionByName(
        rest.select(F.lit("live").alias("kind"), "game_id", "home_score", "away_score", F.col("game_state").alias("state")))


@query("finalize_merge", FINALIZED)
def _(s, d):
    return _finalized(*live.finalize(ad.live_games(s, d), live.live_upsert(ad.reports(s, d))))


@query("finalize_merge_stream", FINALIZED)
def _(s, d):
    root = scratch_path(s, "final")
    start, none = ad.live_games(s, d), live.live_upsert(ad.reports(s, d)).limit(0)
    state = {"live": none}  # its version, replaced per batch id

    def save(completed, rest, batch_id):
        completed.write.mode("overwrite").parquet(f"{root}/completed/batch_id={batch_id}")
        rest.write.mode("overwrite").parquet(f"{root}/live/{batch_id}")
        state["live"] = s.read.schema(rest.schema).parquet(f"{root}/live/{batch_id}")

    # The reports come in four files, so rows of one game meet across batches.
    live.finalize_stream(_split_stream(s, d), lambda: start, lambda: state["live"], save, f"{root}/state").awaitTermination()
    completed = s.read.parquet(f"{root}/completed")
    changed = [c for c in start.columns if c != "game_id"]
    return _finalized(upsert(start, completed, ["game_id"], changed, ["batch_id"]), state["live"])


def _split_stream(s, d):
    """The reports in four files by time, one per micro-batch."""
    path = scratch_path(s, "ordered")
    rows = ad.reports(s, d).select(*_REPORT)
    # Only the last report of a game may say final: a game does not go on afterwards.
    last = live.live_upsert(rows).select(F.col("event_id").alias("_last"))
    early = (F.col("game_state") == "final") & F.col("_last").isNull()
    rows = rows.join(last, F.col("event_id") == F.col("_last"), "left").withColumn(
        "game_state", F.when(early, "q4").otherwise(F.col("game_state"))).select(*_REPORT)
    # One file after the other, as the source takes them by age.
    low, high = rows.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    quarter = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * 4 / (high - low + 1))
    for part in range(4):
        rows.filter(quarter == part).coalesce(1).write.mode("append").parquet(path)
    return read_table_stream(s, path, rows.schema, files_per_trigger=1)


CHANGES = f"SELECT {REPORT_COLUMNS}, previous_state FROM changes"


@query("state_transitions", sql(CHANGES, "changes"))
def _(s, d):
    return live.transitions(ad.reports(s, d).select(*_REPORT))


@query("state_transitions_stream", sql(CHANGES, "changes"))
def _(s, d):
    # No game is forgotten here, as the given games go on after their final reports.
    changed = live.transitions_stream(_closed_stream(s, d), "60 days", "1000 days", "1 day")
    return _run(changed, s, "changes").drop("batch_id")


@query("favorite_notifications", sql("""
    SELECT DISTINCT c.event_id, f.user_id, c.game_id, c.ts, c.game_state
    FROM changes c JOIN live_games g USING (game_id) JOIN followers f ON f.team_id IN (g.home_team_id, g.away_team_id)
    """, "changes", "live_games", "followers"))
def _(s, d):
    return live.notifications(live.transitions(ad.reports(s, d).select(*_REPORT)), ad.live_games(s, d), ad.followers(s, d))


@query("dual_write_stream", sql("""
    SELECT 'history' AS store, count(*) AS n FROM reports UNION ALL SELECT 'latest', count(*) FROM live""", "reports", "live"))
def _(s, d):
    root = scratch_path(s, "both")
    live.dual_write_stream(report_stream(s, d), [
        live.batch_folder_writer(f"{root}/history"), live.batch_folder_writer(f"{root}/latest", live.live_upsert)],
        f"{root}/state").awaitTermination()
    history = s.read.parquet(f"{root}/history").drop("batch_id")
    latest = s.read.parquet(f"{root}/latest").select("game_id").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
    return count(history, "history").unionByName(count(latest, "latest"))
