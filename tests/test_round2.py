"""Inputs that earlier versions lost or misread."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scorebook.functions import clean, html
from scorebook.operators import audit as au
from scorebook.operators import extract as ex
from scorebook.operators import geo
from scorebook.operators import ratings as rt
from scorebook.sources import readers, sinks
from scorebook.streaming import live

NOW = "2026-05-01 00:00:00"


@pytest.mark.parametrize("tie", ["row_number", "rank", "dense_rank"])
def test_ranks_keep_rows_without_a_value(spark, tie):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, None)], "id int, v double")
    got = {r.id: r["rank"] for r in rt.rank(df, "v", "id", tie=tie).collect()}
    last = {"row_number": (3, 4), "rank": (3, 3), "dense_rank": (3, 3)}[tie]
    assert got == {3: 1, 1: 2, 2: last[0], 4: last[1]}


def test_unlisted_sources_come_last(spark):
    records = spark.createDataFrame([(1, "new", 1, 2), (2, "new", 3, 4), (2, "known", 5, 6)], "game_id int, source string, home_score int, away_score int")
    listed = spark.createDataFrame([("known", 0)], "source string, priority int")
    got = {r.game_id: (r.home_score, r.canonical_source) for r in rt.pick_canonical(records, listed).collect()}
    assert got == {1: (1, "new"), 2: (5, "known")}


@pytest.mark.parametrize("rows_per_chunk", [500_000, 2])
def test_rate_limit_takes_null_keys_as_keys(spark, rows_per_chunk):
    at = lambda second: datetime(2026, 3, 1, 12, 0, second)
    rows = [(1, None, 7, at(0)), (2, None, 7, at(10)), (3, None, 7, at(40)), (4, 5, 7, at(0)), (5, 5, None, at(5)), (6, 5, None, at(6))]
    reports = spark.createDataFrame(rows, "event_id long, reporter_id long, game_id long, ts timestamp")
    got = live.rate_limit(reports, 30, rows_per_chunk=rows_per_chunk)
    assert sorted(r.event_id for r in got.collect()) == [1, 3, 4, 5]


def test_drift_counts_values_that_do_not_fit(spark):
    df = spark.createDataFrame([(2_000_000.0, 1.25), (1.004, None), (1.0, 1.2)], "a double, b double")
    got = {r.column_name: (r.drifted_rows, r.checked_rows) for r in au.decimal_drift(df, ["a", "b"], tolerance=0.003).collect()}
    assert got == {"a": (2, 3), "b": (0, 2)}


@pytest.mark.parametrize("states,passed", [("gbgbg", False), ("bggg", True), ("gggb", False), ("ggg", True), ("", False)])
def test_soak_needs_clean_runs_in_a_row(spark, states, passed):
    loads = spark.createDataFrame([(datetime(2026, 3, 1 + i), s == "g") for i, s in enumerate(states)], "ts timestamp, ok boolean")
    assert au.soak_gate(loads, "ts", F.col("ok"), runs=3, hours=48).first().passed == passed


def test_load_survives_an_error_without_text(spark, tmp_path):
    def silent():
        raise KeyboardError

    class KeyboardError(Exception):
        pass

    log = sinks.isolated_load(spark, {"a": silent, "b": lambda: spark.range(2)}, lambda n, df: df.write.parquet(str(tmp_path / n)), F.lit(NOW).cast("timestamp_ntz"))
    assert {r.source: (r.status, r.error_message) for r in log.collect()} == {"a": ("error", "KeyboardError"), "b": ("success", None)}


@pytest.mark.parametrize("radius", [500.0, 30_000.0, 300_000.0])
def test_geofence_around_the_date_line_and_the_poles(spark, radius):
    lats = [-90.0, -89.95, -88.0, 0.0, 45.0, 60.2, 87.5, 89.0, 89.9, 89.999, 90.0]
    lons = [-180.0, -179.9999, -179.7, -90.0, 0.0, 0.001, 90.0, 179.7, 179.9999, 180.0]
    points = [(a, b) for a in lats for b in lons]
    reports = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "rid int, lat double, lon double")
    venues = spark.createDataFrame([(i, a + 0.001 * (-1 if a > 0 else 1), b) for i, (a, b) in enumerate(points)], "venue_id int, lat double, lon double")
    found = [(r.rid, r.venue_id) for r in geo.geofence(reports, venues, radius).collect()]
    pairs = reports.crossJoin(venues.select("venue_id", F.col("lat").alias("a"), F.col("lon").alias("b")))
    near = pairs.where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")) <= radius)
    assert len(found) == len(set(found)) and set(found) == {(r.rid, r.venue_id) for r in near.collect()}


def test_unreadable_rankings_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"ranking":1,"name":"A"}]\n{"ranking": 2, "na\n[{"ranking":3,"name":"C"},{"ranking":4,"name":"D"}]\n')
    stamp = F.lit(NOW).cast("timestamp_ntz")
    good = readers.read_json_rankings(spark, str(tmp_path), 2026, stamp, multi_line=False)
    bad = readers.rejected_json_rankings(spark, str(tmp_path), multi_line=False)
    assert sorted(r.rank_position for r in good.collect()) == [1, 3, 4]
    assert [tuple(r) for r in bad.collect()] == [("a.json", '{"ranking": 2, "na')]
    texts = spark.createDataFrame([(1, '[{"ranking":1}]'), (2, "broken"), (3, None)], "id int, t string")
    assert sorted(r.id for r in readers.rejected_texts(texts, "t").collect()) == [2, 3]


@pytest.mark.parametrize("null_safe", [True, False])
def test_upsert_moves_no_more_of_the_target_than_the_batch_meets(spark, null_safe):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k int, v string, w int")
    batch = spark.createDataFrame([(2, "B", 9), (2, "C", 9), (3, "d", 9), (None, "N", 9)], "k int, v string, w int")
    out = sinks.upsert(target, batch, ["k"], ["v"], ["v"], null_safe)
    kept = {(1, "a", 1), (2, "C", 1), (3, "d", 9)} | ({(None, "N", 1)} if null_safe else {(None, "n", 1), (None, "N", 9)})
    assert {tuple(r) for r in out.collect()} == kept and out.count() == len(kept)
    assert "FullOuter" not in out._jdf.queryExecution().executedPlan().toString()


TEAM = '<a href="/BHS/school.asp?id={}">T{}</a>'


def team(i):
    return TEAM.format(i, i)


@pytest.fixture
def page(spark):
    return lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, html string")


@pytest.mark.parametrize("text,expected", [
    ("<a href=/BHS/School.asp?id=4>O&rsquo;Dea</a>", [(4, "O’Dea")]),
    ('<!-- <a href="school.asp?id=1">no</a> --><a href="school.asp?id=2">yes</a>', [(2, "yes")]),
    ('<script>var x = \'<a href="school.asp?id=1">no</a>\'</script><a href="school.asp?id=2">A &amp; B', [(2, "A & B")]),
    ('<a title="a>b" href="school.asp?id=3">x</a>&copy;', [(3, "x")]),
])
def test_links_of_irregular_pages(page, text, expected):
    assert sorted(tuple(r) for r in ex.extract_links(page(text)).collect()) == expected


def games(df):
    return sorted((str(r.game_date), r.away_team_id, r.home_team_id, r.away_score, r.home_score) for r in ex.extract_scoreboard(df, 2026).collect())


def test_scoreboards_of_irregular_pages(page):
    assert games(page("<b>Mon, Mar 16th</b><p><a href=school.asp?id=1>A</a> 3 @ <a href=school.asp?id=2>B</a> 4</p>")) == [("2026-03-16", 1, 2, 3, 4)]
    assert games(page(f"<b>Mar 16</b><p>{team(1)} 3 @ <a href='school.asp?id=2'>B</a> 4<p>{team(3)} 5 @ <a href='school.asp?id=4'>C</a> 6")) == [
        ("2026-03-16", 1, 2, 3, 4), ("2026-03-16", 3, 4, 5, 6)]
    row = f"<tr><td>Mon, Mar 16th</td><td>{team(1)} 3 @ <a href='school.asp?id=2'>B</a> 4</td></tr>"
    assert games(page(f"<table>{row}</table>")) == games(page(f"<table>{row.replace('</td>', '')}</table>")) == [("2026-03-16", 1, 2, 3, 4)]


def test_an_unreadable_date_ends_the_running_one(page):
    text = f"<b>Mar 16</b><p>{team(1)} 3 @ <a href='school.asp?id=2'>B</a> 4</p><h3>Feb 30th</h3><p>{team(5)} 3 @ <a href='school.asp?id=6'>B</a> 4</p>"
    assert games(page(text)) == [("2026-03-16", 1, 2, 3, 4)] == games(page(text + "<!-- x"))
    assert games(page(f"<p>Mar 16</p><p>{team(1)} 3 @ {team(2)}</p>")) == []


def standings(df):
    return sorted((r.team_id, r.conference, r.overall_wins, r.overall_losses) for r in ex.extract_standings(df, 2026).collect())


def test_standings_take_headings_from_heading_tags_only(page):
    titles = "<tr><td>Conference Team</td><td>W</td><td>L</td></tr>"
    row = lambda i: f"<tr><td>{team(i)}</td><td>{i}</td><td>1</td></tr>"
    flat = f"<h3>Metro Conference</h3><table>{titles}{row(1)}{row(2)}<tr><td colspan=3><b>Pacific Division</b></td></tr>{row(3)}</table>"
    expected = [(1, "Metro", 1, 1), (2, "Metro", 2, 1), (3, "Pacific", 3, 1)]
    assert standings(page(flat)) == expected
    assert standings(page(flat.replace("</td>", "").replace("</tr>", ""))) == expected
    layout = f"<table><tr><td>{flat}</td><td>side</td><td>bar</td></tr></table>"
    assert standings(page(layout)) == expected


def test_rows_of_pages_with_scripts_comments_and_brackets(page):
    text = '<style>td{}</style>&copy; 2026<!-- <table> --><table><tr><td title="a>b">x</td><td>y</td></tr></table><script>"</td>"</script>'
    cells = lambda mode: [r.cells for r in ex.extract_table_rows(page(text), mode=mode).collect()]
    assert cells("auto") == cells("parser") == [["x", "y"]]
    plain = text.replace(' title="a>b"', "")
    assert page(plain).select(html.is_flat(html.cleaned(F.col("html")))).first()[0]
    assert [r.cells for r in ex.extract_table_rows(page(plain), mode="flat").collect()] == [["x", "y"]]


def test_the_given_pages_need_no_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    clean = html.cleaned(F.col("html"))
    flat = html.is_regular(clean, ("a",), html.anchors(clean))
    assert pages.where(flat).count() == pages.count()


def test_stored_decimals_do_not_overflow_silently(spark):
    df = spark.createDataFrame([(1.005,), (None,), (99_999.0,)], "v double")
    assert [r[0] is None for r in df.select(clean.store_decimal("v", 3)).collect()] == [False, True, False]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(123_456.0,)], "v double").select(clean.store_decimal("v", 3)).collect()


def test_table_checks_read_a_table_once(spark, rows, tmp_path):
    from scorebook.operators import audit
    data = [(1, "a", None, 5), (1, "a", 2, None), (2, "b", None, 5), (2, "c", None, 5), (None, None, None, None), (None, None, None, None)]
    spark.createDataFrame(data, "_n int, _k0 string, _f0 int, _set int").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    keys = [["_n", "_k0"], ["_k0"], ["_set"], ["_n", "_k0", "_f0", "_set"], ["_k0", "_n"]]
    checks = audit.table_checks({"t": t, "unread": t}, {"t": {"low": F.col("_n") < 2, "none": F.col("_f0") > 5, "null": F.col("_n").isNull()}}, {"t": keys})
    assert rows(checks) == [
        ("t.low", 0, 2, False), ("t.none", 0, 0, True), ("t.null", 0, 2, False), ("t.unique(_k0)", 0, 2, False), ("t.unique(_k0,_n)", 0, 2, False),
        ("t.unique(_n,_k0)", 0, 2, False), ("t.unique(_n,_k0,_f0,_set)", 0, 1, False), ("t.unique(_set)", 0, 2, False)]
    assert checks._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert rows(audit.table_checks({"t": t}, {"t": {"low": F.col("_n") < 2}}, {})) == [("t.low", 0, 2, False)]
    assert {r.passed for r in audit.table_checks({"t": t.limit(0)}, {"t": {"low": F.col("_n") < 2}}, {"t": keys}).collect()} == {True}
