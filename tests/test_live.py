import json
import random
from datetime import datetime, timedelta
from math import cos, radians

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.operators import geo
from scorebook.schemas import TABLES
from scorebook.sources.readers import read_table_stream
from scorebook.streaming import live

T0 = datetime(2026, 4, 1, 16)
COLS = ["event_id", "ts", "reporter_id", "game_id", "home_score", "away_score", "game_state"]


def reports(spark, data):
    return spark.createDataFrame(data, TABLES["live_reports"])


def at(seconds, event_id, reporter=1, game=1, state="q1"):
    return (event_id, T0 + timedelta(seconds=seconds), reporter, game, 1, 2, state)


def brute_limit(data, seconds, key):
    last, taken = {}, set()
    for r in sorted(data, key=lambda r: (r[1], r[0])):
        k = key(r)
        if k not in last or r[1] - last[k] >= timedelta(seconds=seconds):
            last[k] = r[1]
            taken.add(r[0])
    return taken


def test_rate_limit_golden(spark):
    df = reports(spark, [at(t, i) for i, t in enumerate((0, 20, 40, 60, 70))])
    for per_chunk in (1, 2, 500_000):
        assert {r.event_id for r in live.rate_limit(df, 30, rows_per_chunk=per_chunk).collect()} == {0, 2, 4}


@pytest.mark.parametrize("per_chunk", [1, 3, 17, 500_000])
def test_rate_limit_equals_brute_force(spark, per_chunk):
    rnd = random.Random(per_chunk)
    data = [at(rnd.choice([rnd.randrange(4000), rnd.randrange(200), 50]), i, 1 if rnd.random() < 0.6 else rnd.randrange(4))
            for i in range(900)]
    got = {r.event_id for r in live.rate_limit(reports(spark, data), 30, rows_per_chunk=per_chunk).collect()}
    assert got == brute_limit(data, 30, lambda r: (r[2], r[3]))


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Reports in files that arrive out of order, closed by a much later one."""
    rnd = random.Random(11)
    states = ["pregame", "q1", "q2", "halftime", "q3", "q4", "final"]
    data = [at(rnd.randrange(3000), i, rnd.randrange(3), rnd.randrange(4), rnd.choice(states)) for i in range(300)]
    folder = tmp_path_factory.mktemp("reports")
    order = data[:]
    rnd.shuffle(order)
    for i in range(0, 300, 60):
        reports(spark, order[i:i + 60]).coalesce(1).write.mode("append").parquet(str(folder))
    reports(spark, [at(10_000_000, 9999, 99, 99)]).coalesce(1).write.mode("append").parquet(str(folder))
    return data, str(folder)


def run(spark, df, folder, mode="append"):
    keep = lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/batch_id={i}")
    (df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def stream(spark, folder):
    return read_table_stream(live.state_session(spark), folder, TABLES["live_reports"], files_per_trigger=1)


def test_rate_limit_stream_does_not_depend_on_arrival(spark, arriving, tmp_path):
    data, folder = arriving
    got = run(spark, live.rate_limit_stream(stream(spark, folder), 30, lateness="10 days"), str(tmp_path))
    assert {r.event_id for r in got.collect()} - {9999} == brute_limit(data, 30, lambda r: (r[2], r[3]))
    assert got.select("event_id").distinct().count() == got.count()


def test_live_upsert_stream_equals_batch(spark, rows, arriving, tmp_path):
    data, folder = arriving
    out = run(spark, live.live_upsert(stream(spark, folder)), str(tmp_path), "update")
    last = out.groupBy("game_id").agg(F.max_by("event_id", "batch_id").alias("event_id")).filter("game_id <> 99")
    assert rows(last) == rows(live.live_upsert(reports(spark, data)), "game_id", "event_id")


def test_merge_is_idempotent_and_ignores_older_reports(spark, rows):
    batch = reports(spark, [at(10, 1), at(20, 2), at(5, 3, game=2)])
    none = live.live_upsert(batch).limit(0)
    once = live.merge_live(none, batch)
    assert rows(live.merge_live(once, batch)) == rows(once)
    assert rows(live.merge_live(once, reports(spark, [at(15, 9)]))) == rows(once)


def test_finalize_stream_moves_finished_games(spark, rows, arriving, tmp_path):
    data, folder = arriving
    games = spark.createDataFrame([(g, None, None, "scheduled") for g in range(5)],
                                  "game_id long, home_score int, away_score int, status string")
    ordered = tmp_path / "ordered"
    for i, part in enumerate(sorted(data, key=lambda r: (r[1], r[0]))[j:j + 60] for j in range(0, 300, 60)):
        reports(spark, part).coalesce(1).write.parquet(str(ordered / f"part={i}"))
    state = {"l": live.live_upsert(reports(spark, [])).limit(0)}
    written = []

    def save(g, l, batch_id):
        written.append(g.collect())
        l.write.mode("overwrite").parquet(str(tmp_path / "l" / str(batch_id)))
        state["l"] = spark.read.schema(l.schema).parquet(str(tmp_path / "l" / str(batch_id)))

    src = spark.readStream.schema(TABLES["live_reports"]).option("maxFilesPerTrigger", 1).parquet(str(ordered / "*"))
    live.finalize_stream(src, lambda: games, lambda: state["l"], save, str(tmp_path / "cp")).awaitTermination()
    assert all(r.status == "completed" for batch in written for r in batch)
    state["g"] = spark.createDataFrame([r for batch in written for r in batch], games.schema)
    finished = {g for g in range(4) if any(r[6] == "final" and r[3] == g for r in data)}
    assert {r.game_id for r in state["g"].filter("status = 'completed'").collect()} <= finished
    assert not rows(state["l"].filter("game_state = 'final'"))


def test_transitions(spark, rows):
    df = reports(spark, [at(0, 1, state="q1"), at(10, 2, state="q1"), at(20, 3, state="q2"), at(30, 4, state="final"),
                         at(40, 5, state="final"), at(100_000, 6, state="final"), at(5, 7, game=2, state="q2")])
    assert rows(live.transitions(df), "event_id", "previous_state") == [
        (1, None), (3, "q1"), (4, "q2"), (5, "final"), (6, "final"), (7, None)]


def test_transitions_stream_does_not_depend_on_arrival(spark, rows, arriving, tmp_path):
    data, folder = arriving
    got = run(spark, live.transitions_stream(stream(spark, folder), "10 days", "100 days"), str(tmp_path)).filter("game_id <> 99")
    assert rows(got, "event_id", "previous_state") == rows(live.transitions(reports(spark, data)), "event_id", "previous_state")


def test_follower_of_both_teams_is_told_once(spark, rows):
    changes = live.transitions(reports(spark, [at(0, 1)]))
    games = spark.createDataFrame([(1, 10, 20)], "game_id long, home_team_id long, away_team_id long")
    fans = spark.createDataFrame([(10, 7), (20, 7), (20, 8), (30, 9)], "team_id long, user_id long")
    assert rows(live.notifications(changes, games, fans), "event_id", "user_id") == [(1, 7), (1, 8)]


def test_geofence_equals_brute_force(spark):
    from math import asin, cos, radians, sin, sqrt
    rnd = random.Random(2)
    for base in ((45.0, -122.0), (-0.001, 0.001), (78.2, 15.6)):
        r = [(i, base[0] + rnd.uniform(-0.02, 0.02), base[1] + rnd.uniform(-0.03, 0.03)) for i in range(150)]
        v = [(i, base[0] + rnd.uniform(-0.02, 0.02), base[1] + rnd.uniform(-0.03, 0.03)) for i in range(60)]

        def dist(a, b):
            h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
            return 2 * 6371000 * asin(sqrt(h))

        want = {(a[0], b[0]) for a in r for b in v if dist(a, b) <= 500}
        got = geo.geofence(spark.createDataFrame(r, "event_id long, lat double, lon double"),
                           spark.createDataFrame(v, "venue_id long, lat double, lon double"))
        pairs = [(x.event_id, x.venue_id) for x in got.collect()]
        assert set(pairs) == want and len(pairs) == len(want) and want


def test_game_window_edges(spark, rows):
    games = spark.createDataFrame([(1, 5, T0)], "game_id long, venue_id long, start_ts timestamp_ntz")
    minutes = (-31, -30, 0, 180, 181)
    df = spark.createDataFrame([(i, 5, T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)],
                               "event_id long, venue_id long, ts timestamp_ntz")
    assert rows(geo.game_window(df, games), "event_id") == [(1,), (2,), (3,)]


def test_dual_write_stream_replaces_a_replayed_batch(spark, arriving, tmp_path):
    _, folder = arriving
    write = live.batch_folder_writer(str(tmp_path / "a"))
    live.dual_write_stream(stream(spark, folder), [write, live.batch_folder_writer(str(tmp_path / "b"))],
                           str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 301
    write(reports(spark, [at(0, 1)]), 0)
    assert spark.read.parquet(str(tmp_path / "a" / "batch_id=0")).count() == 1


def test_waiting_reports_cost_a_batch_nothing(spark, tmp_path):
    # One key, 30,000 reports that wait; then three batches of one report each.
    folder = str(tmp_path / "in")
    reports(spark, [at(i, i) for i in range(30_000)]).coalesce(1).write.parquet(folder)
    for i in range(3):
        reports(spark, [at(30_000 + i, 30_000 + i)]).coalesce(1).write.mode("append").parquet(folder)
    query = (live.rate_limit_stream(stream(spark, folder), 30, lateness="10 days").writeStream.format("noop")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    seen = {p["numInputRows"]: p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["numInputRows"]}
    moved = {n: m["rocksdbTotalBytesRead"] + m["rocksdbTotalBytesWritten"] for n, m in seen.items()}
    assert set(moved) == {30_000, 1} and moved[1] < moved[30_000] / 100, moved


def test_reports_after_a_forgotten_final_begin_anew(spark, rows, tmp_path):
    data = [at(0, 1, state="final"), at(1800, 5, state="final"), at(7200, 2, state="final"), at(100_000, 3, state="q1"),
            at(150_000, 4, state=None), at(10_000_000, 9999, game=99)]
    folder = str(tmp_path / "in")
    for r in data:
        reports(spark, [r]).coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, live.transitions_stream(stream(spark, folder), "100 days", "1 hour"), str(tmp_path)).filter("game_id <> 99")
    assert rows(got, "event_id", "previous_state") == [(1, None), (2, None), (3, None), (5, "final")]


def test_streams_of_state_name_the_store_they_need(spark, tmp_path):
    reports(spark, [at(0, 1)]).write.parquet(str(tmp_path / "in"))
    plain = read_table_stream(spark, str(tmp_path / "in"), TABLES["live_reports"])
    if spark.conf.get(live.STATE_STORE) != live.ROCKSDB:
        with pytest.raises(RuntimeError, match="stateStore"):
            live.rate_limit_stream(plain)


def test_games_that_arrive_after_their_reports_match(spark, tmp_path):
    """Both sides stream in file by file; the result is the batch form's, and what no later row can match leaves the state."""
    rnd = random.Random(5)
    hours = [T0 + timedelta(hours=h) for h in range(48)]
    games = [(i, i % 3, at) for i, at in enumerate(hours)]
    data = [(i, rnd.choice(hours) + timedelta(minutes=rnd.randrange(-60, 240)), 1 if rnd.random() < 0.8 else 2, 0, 0, 0, "q1",
             45.0 + 0.1 * rnd.randrange(3), -122.0) for i in range(600)]
    schema = T.StructType([*TABLES["live_reports"].fields, T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
    reports_df = spark.createDataFrame(data, schema)
    games_df = spark.createDataFrame(games, "game_id long, venue_id long, start_ts timestamp_ntz")
    venues = spark.createDataFrame([(v, 45.0 + 0.1 * v, -122.0) for v in range(3)], "venue_id long, lat double, lon double")
    active = spark.createDataFrame([(1, True), (2, False)], "reporter_id long, is_active boolean")
    none = (None,) * 9
    folders = {name: str(tmp_path / name) for name in ("reports", "games")}
    for day in range(6):  # eight hours a file; the games of a file come one file later than the reports on them
        here = [r for r in data if day * 8 <= (r[1] - T0) / timedelta(hours=1) + 1 < day * 8 + 8 or day == 5 and r[1] >= T0 + timedelta(hours=47)]
        spark.createDataFrame(here + [none], schema).coalesce(1).write.mode("append").parquet(folders["reports"])
        spark.createDataFrame(games[max(0, day * 8 - 8):day * 8] if day < 5 else games[32:], games_df.schema).coalesce(1).write.mode(
            "append").parquet(folders["games"])
    # Two closing rows, long after all others, match nothing.
    for _ in range(2):
        spark.createDataFrame([(9999, T0 + timedelta(days=90), 1, 0, 0, 0, "q1", 45.0, -122.0)], schema).coalesce(1).write.mode("append").parquet(folders["reports"])
        spark.createDataFrame([(9999, 0, T0 + timedelta(days=80))], games_df.schema).coalesce(1).write.mode("append").parquet(folders["games"])
    arriving = [read_table_stream(spark, folders[n], df.schema, files_per_trigger=1) for n, df in (("reports", reports_df), ("games", games_df))]
    matched = live.eligible_stream(arriving[0], venues, arriving[1], active, "20 hours").select("event_id", "venue_id", "matched_game_id", "ts", "start_ts")
    writer = (matched.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id={i}"))
              .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    writer.awaitTermination()
    got = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").drop("batch_id")
    want = live.eligible(reports_df, venues, games_df, active).select(*got.columns)
    assert want.count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = [sum(op.numRowsTotal for op in p.stateOperators) for p in writer.recentProgress if p.stateOperators]
    assert max(held) > 100 and held[-1] <= 10


def test_state_of_the_stream_does_not_hold_pairs(spark, tmp_path):
    """Thirty venues in one place: a report waits once for each cell around it, not once for each venue."""
    schema = T.StructType([*TABLES["live_reports"].fields, T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
    reports_df = spark.createDataFrame([(i, T0 + timedelta(seconds=i), 1, 0, 0, 0, "q1", 45.0 + i * 1e-6, -122.0) for i in range(1100)]
                                       + [(5000, T0, 1, 0, 0, 0, "q1", None, -122.0), (5001, T0, 1, 0, 0, 0, "q1", 46.0, -122.0)], schema)
    games_df = spark.createDataFrame([(v, v, T0) for v in range(30)] + [(99, 99, T0), (98, None, T0), (97, 3, None)],
                                     "game_id long, venue_id long, start_ts timestamp_ntz")
    # Venue 3 is stored twice, venue 98 has no place.
    venues = spark.createDataFrame([(v, 45.0, -122.0) for v in [*range(30), 3]] + [(98, None, None)], "venue_id long, lat double, lon double")
    active = spark.createDataFrame([(1, True)], "reporter_id long, is_active boolean")
    for name, df in (("reports", reports_df), ("games", games_df)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    matched = live.eligible_stream(read_table_stream(spark, f"{tmp_path}/reports", reports_df.schema), venues,
                                   read_table_stream(spark, f"{tmp_path}/games", games_df.schema), active)
    writer = (matched.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id={i}"))
              .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    writer.awaitTermination()
    got = spark.read.schema(matched.schema).option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").select(*matched.columns)
    want = live.eligible(reports_df, venues, games_df, active)
    assert got.columns == want.columns and want.count() == 31 * 1100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert max(sum(op.numRowsTotal for op in p.stateOperators) for p in writer.recentProgress if p.stateOperators) < 30


def test_cells_near_a_point_hold_all_that_is_near(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        lat, lon = rnd.choice([(45.0, -122.0), (0.0, 0.0), (0.0, 180.0), (70.0, -180.0), (-89.5, 10.0), (88.9, 0.0), (89.999, 50.0)])
        lat, lon = lat + rnd.uniform(-0.03, 0.03), lon + rnd.uniform(-0.05, 0.05)
        # A second point at some 400 to 550 m.
        far = rnd.uniform(400, 550) / geo.METERS_PER_DEGREE
        other = min(90.0, lat + rnd.uniform(-far, far)), lon + rnd.uniform(-1, 1) * (rnd.choice([1, 2]) * far / max(1e-4, cos(radians(min(lat, 90.0)))))
        data.append((i, min(lat, 90.0), lon, *other))
    pairs = spark.createDataFrame(data, "i int, lat double, lon double, lat2 double, lon2 double")
    near = pairs.filter(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 500)
    assert near.count() > 500
    assert near.filter(~F.array_contains(geo.cells_near("lat", "lon"), geo.cell("lat2", "lon2"))).count() == 0
    assert pairs.filter(F.size(geo.cells_near("lat", "lon")) > 4).count() == 0


def test_live_rows_of_any_batch_are_read_from_the_state(spark, arriving, tmp_path):
    _, folder = arriving
    source = read_table_stream(spark, folder, TABLES["live_reports"], files_per_trigger=1)
    writer = (live.live_upsert(source).writeStream.outputMode("update").foreachBatch(
        lambda b, i: b.write.format("noop").mode("append").save()).option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True).start())
    writer.awaitTermination()
    # Which file came in which batch is in the source's own log.
    seen = []
    for batch in range(6):
        log = (tmp_path / "state" / "sources" / "0" / str(batch)).read_text().splitlines()[1:]
        seen += [json.loads(line)["path"] for line in log]
        want = live.live_upsert(spark.read.schema(TABLES["live_reports"]).parquet(*seen))
        got = live.live_at(spark, f"{tmp_path}/state", batch)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    last = live.live_at(spark, f"{tmp_path}/state")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="(?i)batch"):
        live.live_at(spark, f"{tmp_path}/state", 99).collect()
