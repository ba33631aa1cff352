import threading
import time
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorebook.schemas import TABLES
from scorebook.sources import layout, readers, sinks

NOW = datetime(2026, 5, 1)


def schedule(spark, *data):
    full = [(t, date(2026, 3, 1), clock, opp, True, False, None, score, 0, False, 2026, datetime(2026, 3, 1, h))
            for t, clock, opp, score, h in data]
    return spark.createDataFrame(full, TABLES["schedule"])


def test_null_time_is_inserted_again_only_without_null_safety(spark):
    batch = schedule(spark, ("a", None, "x", 1, 1))
    for null_safe, expected in ((False, 2), (True, 1)):
        once = sinks.upsert_schedule(batch.limit(0), batch, ["scraped_at"], null_safe)
        assert sinks.upsert_schedule(once, batch, ["scraped_at"], null_safe).count() == expected
    timed = schedule(spark, ("a", "4pm", "x", 1, 1))
    once = sinks.upsert_schedule(timed.limit(0), timed, ["scraped_at"], False)
    assert sinks.upsert_schedule(once, timed, ["scraped_at"], False).count() == 1


def test_later_rows_win_and_other_columns_stay(spark, rows):
    target = schedule(spark, ("a", "4pm", "x", 1, 1), ("b", "4pm", "x", 2, 1))
    batch = schedule(spark, ("a", "4pm", "x", 7, 2), ("a", "4pm", "x", 9, 3), ("c", None, "y", 5, 2)).withColumn("season", F.lit(1))
    got = sinks.upsert_schedule(target, batch, ["scraped_at"])
    assert rows(got, "team_id", "team_score", "season") == [("a", 9, 2026), ("b", 2, 2026), ("c", 5, 1)]
    assert rows(sinks.upsert_schedule(got, batch, ["scraped_at"])) == rows(got)


def test_teams_tied_on_a_rank_overwrite_each_other(spark, rows):
    cols = "season int, rank_position int, team_name string, at int"
    batch = spark.createDataFrame([(2026, 3, "A", 1), (2026, 3, "B", 2)], cols)
    got = sinks.upsert(batch.limit(0), batch, ["season", "rank_position"], ["team_name", "at"], ["at"])
    assert rows(got) == [(2026, 3, "B", 2)]
    shorter = spark.createDataFrame([(2026, 1, "A", 3)], cols)
    assert sinks.upsert(got, shorter, ["season", "rank_position"], ["team_name", "at"], ["at"]).count() == 2
    assert rows(sinks.replace_partition(got, shorter, "season")) == [(2026, 1, "A", 3)]


def test_insert_ignore_is_idempotent_and_first_wins(spark, rows):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    batch = spark.createDataFrame([("a", 9), ("b", 2), ("b", 1), (None, 5)], "k string, v int")
    got = sinks.insert_ignore(target, batch, ["k"], ["v"])
    assert rows(got) == sorted([("a", 1), ("b", 1), (None, 5)], key=repr)
    keyed = batch.filter("k IS NOT NULL")
    assert rows(sinks.insert_ignore(got, keyed, ["k"], ["v"])) == rows(got)


def test_one_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = sinks.one_per_key(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) and plan.count("WindowGroupLimit") == 2


def test_one_failing_source_does_not_stop_the_others(spark, rows, tmp_path):
    def broken():
        raise ValueError("no table\nmore text")
    seen = {}

    def write(name, df):
        df.write.parquet(str(tmp_path / name))
        seen[name] = True

    at_run_time = lambda: spark.range(1).select(F.raise_error(F.lit("bad page")).alias("x"))
    log = sinks.isolated_load(spark, {"a": lambda: spark.range(5), "b": broken, "c": at_run_time, "d": lambda: spark.range(2)},
                              write, F.lit(NOW).cast("timestamp_ntz"))
    got = {r.source: (r.teams_scraped, r.status, r.error_message) for r in log.collect()}
    assert got["a"] == (5, "success", None) and got["b"] == (0, "error", "no table") and got["d"] == (2, "success", None)
    assert got["c"][:2] == (0, "error") and set(seen) == {"a", "d"}


def test_failing_log_does_not_fail_the_run(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    entry = sinks.log_entry(spark, "a", 1, "success", None, F.lit(NOW).cast("timestamp_ntz"))
    assert sinks.write_log(entry, str(tmp_path / "log")) is True
    assert sinks.write_log(entry, str(tmp_path / "file" / "log")) is False


@pytest.mark.parametrize("rule,expected", [("cascade", [(2, 20)]), ("set_null", [(1, None), (2, 20)]), ("restrict", [(1, 10)])])
def test_delete_rules(spark, rows, rule, expected):
    child = spark.createDataFrame([(1, 10), (2, 20)], "id int, parent int")
    gone = spark.createDataFrame([(10,), (10,), (30,)], "pid int")
    assert rows(sinks.cascade_delete(child, gone, "parent", "pid", rule)) == expected
    with pytest.raises(ValueError):
        sinks.cascade_delete(child, gone, "parent", "pid", "other")


def test_dual_write_fails_when_one_writer_fails(spark):
    done = []
    sinks.dual_write(spark.range(3), [lambda df: done.append(df.count()), lambda df: done.append(df.count())])
    assert done == [3, 3]
    with pytest.raises(RuntimeError):
        sinks.dual_write(spark.range(3), [lambda df: done.append(1), lambda df: (_ for _ in ()).throw(RuntimeError("x"))])


def test_json_rankings(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text('[{"ranking":1,"name":"  Mt.   View ","wins":5,"losses":0,"rating":91.2345,"agd":7.5,"sched":84},'
                                     '{"ranking":2,"name":"B","wins":1,"losses":2,"rating":80,"agd":1,"sched":79}]')
    got = readers.read_json_rankings(spark, str(tmp_path), 2026, F.lit(NOW).cast("timestamp_ntz"))
    assert [(r.season, r.rank_position, r.team_name, r.record, float(r.rating)) for r in got.orderBy("rank_position").collect()] == [
        (2026, 1, "Mt. View", "5-0", 91.235), (2026, 2, "B", "1-2", 80.0)]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 5 AS season", "id * 2 AS x").write.parquet(str(tmp_path / "t.parquet"))
    df = readers.read_table(spark, str(tmp_path), "t", ["x"], F.col("season") == 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(season,3)" in plan and "id:bigint" not in plan.split("ReadSchema")[1]


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_only_touched_partitions_are_rewritten(spark, rows, tmp_path):
    path = str(tmp_path / "table")
    schema = "season int, pos int, name string, at int"
    keys, cols = ["season", "pos"], ["name", "at"]
    old = spark.createDataFrame([(s, p, f"n{p}", 1) for s in (1, 2, None) for p in range(20)], schema)
    merge = lambda df: sinks.upsert_partitions(spark, path, df, keys, cols, ["at"], ["season"])
    stored = lambda: rows(spark.read.schema(schema).parquet(path), *old.columns)
    assert len(merge(old)) == 3 and stored() == rows(old)
    before = _files(path)
    batch = spark.createDataFrame([(2, 3, "x", 2), (2, 3, "y", 3), (2, 99, "new", 1), (None, 4, "z", 2), (7, 1, "first", 1)], schema)
    assert len(merge(batch)) == 3
    after = _files(path)
    same = {f: t for f, t in before.items() if f.startswith("season=1/")}
    assert same and same.items() <= after.items()
    assert not {f for f in before if f.startswith("season=2/")} & set(after)
    expected = sinks.upsert(old, batch, keys, cols, ["at"])
    assert stored() == rows(expected)
    assert merge(batch) and stored() == rows(expected)
    assert merge(batch.limit(0)) == [] and _files(path).keys() & after.keys()
    with pytest.raises(ValueError):
        sinks.upsert_partitions(spark, path, batch, ["pos"], cols, ["at"], ["season"])


def test_deletes_weigh_all_references_together(spark, rows):
    """A chain of three levels, a refusal that keeps a row which forbids another, and references that are cleared."""
    links = [("b", "a_id", "a", "a_id", "cascade"), ("c", "b_id", "b", "b_id", "cascade"), ("d", "c_id", "c", "c_id", "restrict"),
             ("a", "d_id", "d", "d_id", "restrict"), ("e", "b_id", "b", "b_id", "set_null"), ("c", "x,y", "p", "x,y", "cascade")]
    tables = {
        "a": spark.createDataFrame([(1, None), (2, None), (3, 30), (4, 40)], "a_id int, d_id int"),
        "b": spark.createDataFrame([(11, 1), (12, 2), (13, 3), (14, 4), (15, None)], "b_id int, a_id int"),
        "c": spark.createDataFrame([(21, 11, 1, 1), (22, 12, 1, 2), (23, 13, 2, 2), (24, 15, 1, 1)], "c_id int, b_id int, x int, y int"),
        "d": spark.createDataFrame([(30, 22), (40, None), (50, 24)], "d_id int, c_id int"),
        "e": spark.createDataFrame([(1, 11), (2, 12), (3, None)], "e_id int, b_id int"),
        "p": spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")}
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id int")
    done = sinks.delete_rows(tables, {"a": ("a_id", ids(1, 2, None, 77)), "d": ("d_id", ids(30, 40))}, links)
    # Row 3 of a stays and so forbids d 30; that keeps d 30, which forbids a 2; a 4 stays and forbids d 40.
    assert rows(done.refused, "tbl", "key", "child") == [("a", "2", "d"), ("d", "30", "a"), ("d", "40", "a")]
    assert rows(done.tables["a"], "a_id") == [(2,), (3,), (4,)] and rows(done.tables["b"], "b_id") == [(12,), (13,), (14,), (15,)]
    assert rows(done.tables["c"], "c_id") == [(22,), (23,), (24,)] and rows(done.tables["e"]) == [(1, None), (2, 12), (3, None)]
    both = sinks.delete_rows(tables, {"a": ("a_id", ids(2, 3)), "d": ("d_id", ids(30))}, links)
    assert rows(both.refused) == [] and rows(both.tables["d"], "d_id") == [(40,), (50,)] and rows(both.tables["c"], "c_id") == [(21,), (24,)]
    none = sinks.delete_rows(tables, {"a": ("a_id", ids())}, links)
    assert rows(none.refused) == [] and all(rows(none.tables[t]) == rows(df) for t, df in tables.items())


def test_deletes_copy_no_table(spark, rows, monkeypatch):
    """Only what decides about refusals is written; rows are taken by a chain, by a circle, by a request of their own, or stay with a key that is not there."""
    links = [("g", "t_id", "t", "t_id", "restrict"), ("r", "g_id", "g", "g_id", "cascade"), ("q", "r_id", "r", "r_id", "cascade"),
             ("n", "up", "n", "n_id", "cascade"), ("g", "v_id", "v", "v_id", "set_null")]
    games = [(i, i % 10, i % 5 if i % 4 else None) for i in range(400)] + [(None, 3, 1), (7, 7, 2)]
    tables = {
        "t": spark.createDataFrame([(i,) for i in range(10)], "t_id int"), "v": spark.createDataFrame([(i,) for i in range(5)], "v_id int"),
        "g": spark.createDataFrame(games, "g_id int, t_id int, v_id int"),
        "r": spark.createDataFrame([(1000 + i, i) for i in range(400)] + [(9999, 777), (9998, None)], "r_id int, g_id int"),
        "q": spark.createDataFrame([(1000 + i,) for i in range(400)] + [(9999,), (None,)], "r_id int"),
        "n": spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3), (5, 6), (6, None)], "n_id int, up int")}
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id int")
    paths, make = [], sinks.scratch_path
    monkeypatch.setattr(sinks, "scratch_path", lambda *a: paths.append(make(*a)) or paths[-1])
    gone = [i for i in range(400) if i % 10 in (3, 7)]
    done = sinks.delete_rows(tables, {"t": ("t_id", ids(3, 4, 7)), "g": ("g_id", ids(777, *gone)), "v": ("v_id", ids(1)), "n": ("n_id", ids(1))}, links)
    # Team 3 has a game without an id, which stays; all 40 games of team 4 stay.
    assert rows(done.refused) == [("t", "3", "g", "t_id", 1), ("t", "4", "g", "t_id", 40)]
    assert rows(done.tables["t"]) == [(i,) for i in range(10) if i != 7]
    assert rows(done.tables["g"]) == sorted([(g, t, None if v == 1 else v) for g, t, v in games if g not in gone], key=repr)
    assert rows(done.tables["r"]) == sorted([(1000 + i, i) for i in range(400) if i not in gone] + [(9999, 777), (9998, None)], key=repr)
    assert rows(done.tables["q"]) == sorted([(1000 + i,) for i in range(400) if i not in gone] + [(9999,), (None,)], key=repr)
    assert rows(done.tables["n"]) == [(5, 6), (6, None)] and rows(done.tables["v"]) == [(0,), (2,), (3,), (4,)]
    assert sum(spark.read.parquet(p).count() for p in paths) < 50


def test_deletes_leave_a_table_stored_by_its_key_in_place(spark, rows, tmp_path):
    games = spark.range(2000).selectExpr("cast(id AS string) AS g_id", "id % 50 AS t_id")
    stored = layout.deal_bucketed(games, "dealt_games", str(tmp_path / "games"), 4, ["g_id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = sinks.delete_rows({"g": stored, "r": stored.select("g_id")}, {"g": ("g_id", stored.filter("t_id < 9").select("g_id"))},
                                 [("r", "g_id", "g", "g_id", "cascade")])
        for t, column in (("g", "t_id"), ("r", "g_id")):
            assert "Exchange" not in done.tables[t]._jdf.queryExecution().executedPlan().toString()
            assert done.tables[t].select(column).count() == 2000 - 9 * 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        layout.drop_bucketed(spark, "dealt_games")


def test_sources_load_at_the_same_time_and_a_hanging_one_is_cancelled(spark, tmp_path):
    sleep = "java_method('java.lang.Thread', 'sleep', {}L)"
    slow = lambda ms, n=1: lambda: spark.range(0, n, 1, n).withColumn("slept", F.expr(sleep.format(ms)))
    here, there = threading.Event(), threading.Event()

    def meets(mine, other):
        def load():
            mine.set()
            assert other.wait(30), "the other source never started"
            return spark.range(5)
        return load

    def fails():
        raise ValueError()
    began = time.monotonic()
    log = sinks.concurrent_load(
        spark, {"a": meets(here, there), "hangs": slow(600_000, 4), "b": meets(there, here), "fails": fails, "slow": slow(100)},
        lambda name, df: df.write.parquet(str(tmp_path / name)), F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"), {"hangs": 4, "a": 60})
    assert [(r.source, r.teams_scraped, r.status, r.error_message) for r in log.collect()] == [
        ("a", 5, "success", None), ("hangs", 0, "error", "no end after 4 seconds"), ("b", 5, "success", None),
        ("fails", 0, "error", "ValueError"), ("slow", 1, "success", None)]
    assert time.monotonic() - began < 60
    assert not (tmp_path / "hangs" / "_SUCCESS").exists() and (tmp_path / "a" / "_SUCCESS").exists()
    # The tasks of the cancelled source have left their slots, and the caller's own jobs carry no tag.
    for _ in range(40):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.25)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds() and not spark.sparkContext.getJobTags()


def test_a_loader_that_returns_too_late_is_not_written(spark, tmp_path):
    release, written = threading.Event(), []

    def late():
        release.wait(30)
        return spark.range(3)
    log = sinks.concurrent_load(spark, {"late": late}, lambda name, df: written.append(df.count()),
                                F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"), 0.5)
    release.set()
    time.sleep(1)
    assert [r.error_message for r in log.collect()] == ["no end after 0.5 seconds"] and not written
    assert not sinks.concurrent_load(spark, {}, lambda name, df: None, F.lit(None).cast("timestamp_ntz")).collect()
