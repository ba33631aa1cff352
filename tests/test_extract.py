from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scorebook.functions import html
from scorebook.operators import extract as ex


# --- Fixed values.
# Page number of a team page -> team key.
SCHOOL_PAGES = [
    (7, "aloha_southridge"), (20, "beaverton"), (131, "bend_caldera"), (479, "burns"), (288, "canby"),
    (243, "central_catholic"), (10, "century"), (201, "corvallis"), (360, "forest_grove"), (14, "glencoe"),
    (1, "grant"), (178, "hillsboro"), (13, "hood_river"), (9, "ida_b_wells"), (199, "jesuit"),
    (4, "lake_oswego"), (19, "lakeridge"), (79, "liberty"), (11, "lincoln"), (183, "marist"),
    (476, "mountainside"), (289, "mt_view"), (182, "nelson"), (204, "newberg"), (177, "oes"),
    (21, "oregon_city"), (3, "roseburg"), (18, "sheldon"), (57, "sherwood"), (200, "south_eugene"),
    (17, "sprague"), (163, "summit"), (2, "sunset"), (56, "thurston"), (12, "tigard"),
    (167, "tualatin"), (330, "west_albany"), (8, "west_linn"), (25, "west_salem"), (23, "westview"),
    (80, "wilsonville"),
]
# --- End of fixed values.


def school_page_map(spark):
    return spark.createDataFrame(SCHOOL_PAGES, "page_number long, team_id string")


def pages(spark, *texts):
    return spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "page_id long, team_id string, html string")


def cell_rows(spark, text, mode, min_cells=1):
    df = ex.extract_table_rows(pages(spark, text), min_cells, mode)
    return [r.cells for r in df.orderBy("pos").collect()]


FLAT = ('<table><tr class="h"><td>March</td></tr><tr><td> A &amp; B </td><td><a href="school.asp?id=4">@ X</a> y</td></tr>'
        "<tr><th>no</th></tr></table>")


@pytest.mark.parametrize("mode", ["flat", "parser", "auto"])
def test_rows_of_a_flat_table(spark, mode):
    assert cell_rows(spark, FLAT, mode) == [["March"], ["A & B", "@ X y"]]
    assert cell_rows(spark, FLAT, mode, 2) == [["A & B", "@ X y"]]


@pytest.mark.parametrize("text,expected", [
    # Missing end tags: the next cell or row ends the one before.
    ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c"]]),
    # An outer row holds the cells and the text of the table inside it.
    ("<table><tr><td>x<table><tr><td>1</td><td>2</td></tr></table></td></tr></table>", [["x12", "1", "2"], ["1", "2"]]),
    ("<table><!-- <tr><td>no</td></tr> --><tr><td>caf&eacute;</td></tr></table>", [["café"]]),
    ("<table><tr><td><script>if (a<b) '</td>'</script>ok</td></tr></table>", [["ok"]]),
    ("<table><tr><td>1 &lt; 2 &amp;amp; &#39;q&#39;</td></tr></table>", [["1 < 2 &amp; 'q'"]]),
    ("<table><tr><td>a&nbsp;</td></tr></table>", [["a"]]),
    ("plain text", []), ("", []),
])
def test_irregular_pages_are_parsed(spark, text, expected):
    assert cell_rows(spark, text, "auto") == expected


def test_flat_and_parser_agree(spark):
    text = FLAT + '<table id="b"><tr><td>1</td><td>"q" &lt;b&gt;</td></tr></table>'
    assert pages(spark, text).select(html.is_flat(F.col("html"))).first()[0]
    assert cell_rows(spark, text, "flat") == cell_rows(spark, text, "parser") == cell_rows(spark, text, "auto")


def game(day, opp="X", time="4pm", conf="Yes", result="W 3-2"):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in ("", "Mo", day, time, opp, conf, result)) + "</tr>"


def month(name):
    return f"<tr><td colspan='7'> {name} </td></tr>"


def test_month_rows_carry_to_the_rows_below(spark):
    text = f"<table>{game('1st')}{month('March')}{game('2nd')}{game('3rd', '@ Y', '')}{month('April')}{game('4th', result='L 4-5 OT')}"\
           f"{game('TBD')}{game('5', ' ')}</table>"
    got = ex.extract_team_schedule(pages(spark, text), 2026).orderBy("game_date").collect()
    assert [(r.game_date, r.opponent, r.is_home, r.game_time, r.result, r.is_ot) for r in got] == [
        (date(2026, 3, 2), "X", True, "4pm", "W", False), (date(2026, 3, 3), "Y", False, None, "W", False),
        (date(2026, 4, 4), "X", True, "4pm", "L", True)]


def test_only_mapped_pages_are_read(spark):
    body = f"<table>{month('March')}{game('2nd')}</table>"
    df = spark.createDataFrame([(1, "http://h/school.asp?id=289", body), (2, "http://h/school.asp?x=1&ID=5", body)],
                               "page_id long, url string, html string")
    got = ex.extract_all_schedules(df, school_page_map(spark), 2026)
    assert [r.team_id for r in got.collect()] == ["mt_view"]
    assert school_page_map(spark).select("team_id").distinct().count() == 41


def test_ranking_table(spark):
    now = F.lit(datetime(2026, 5, 1)).cast("timestamp_ntz")
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    text = ('<table id="rankingTable"><tbody>' + row("5-0", "8 . Mountain  Vie", "x", "91.5") + row("1-1", "no dot", "2")
            + row("1-1", "9 . ", "2") + row("1-1", "9 . B", "-") + "</tbody></table>")
    got = ex.extract_ranking_table(pages(spark, text), as_of=now).collect()
    assert [(r.rank_position, r.team_name, r.wins, r.losses, r.consensus) for r in got] == [(8, "Mountain Vie", 5, 0, 91.5)]
    with pytest.raises(Exception, match="no table rankingTable"):
        ex.extract_ranking_table(pages(spark, "<p>moved</p>"), as_of=now).collect()


def test_scoreboard(spark):
    link = lambda i: f'<a href="/BHS/school.asp?id={i}">T</a>'
    text = (f"<p>{link(1)} 1 @ {link(2)} 2</p><b>Monday, Mar 16th</b><div><p class='conf'>{link(1)} 10 @ {link(2)} 6</p></div>"
            f"<p>{link(1)} 0 @ {link(2)} 0</p><h3>Tue, Mar 17th</h3><p>{link(1)} 7:00pm @ {link(2)} scrimmage "
            f"<a href='field.asp?id=1'>East</a></p><p>{link(3)} 1 @ {link(3)} 2</p>")
    got = ex.extract_scoreboard(pages(spark, text), 2026).orderBy("game_date").collect()
    assert [(r.game_date, r.away_team_id, r.home_team_id, r.away_score, r.home_score, r.is_conference, r.is_scrimmage, r.location)
            for r in got] == [(date(2026, 3, 16), 1, 2, 10, 6, True, False, None),
                              (date(2026, 3, 17), 1, 2, None, None, False, True, "East")]


def test_long_pages_do_not_overflow_the_matcher(spark):
    link = '<a href="school.asp?id={}">T</a>'
    text = "<b>Mar 1</b>" + "".join(
        f"<p>{'x' * 200} {link.format(2 * i + 1)} 1 @ {link.format(2 * i + 2)} 2</p>" for i in range(3000))
    assert ex.extract_scoreboard(pages(spark, text), 2026).count() == 3000
    block = "<b>Mar 1</b><p>" + "y" * 200_000 + f"{link.format(1)} 1 @ {link.format(2)} 2</p>"
    assert ex.extract_scoreboard(pages(spark, block), 2026).count() == 1


@pytest.mark.parametrize("tag", ["font", "div", "table"])
def test_deep_pages_do_not_end_the_job(spark, tag):
    deep = f"<{tag}>" * 100_000 + "<p><a href='/t/1'>Owls</a> x</p><tr><td>a<td>b"
    good = "<p><a href='/t/2'>Rams</a></p>"
    for extract in (ex.extract_scoreboard, ex.extract_standings):
        extract(pages(spark, deep, good), 2026).collect()
    assert {"Rams", "Owls"} == {r.name for r in ex.extract_links(pages(spark, deep, good), "/t/", "/t/([0-9]+)").collect()}


def test_a_page_that_cannot_be_read_spoils_only_itself(spark):
    bad, good = "<![x[ <a href='/t/1'>", "<p><a href='/t/2'>Rams</a></p>"
    assert [r.name for r in ex.extract_links(pages(spark, bad, good), "/t/", "/t/([0-9]+)").collect()] == ["Rams"]


def test_enrichment_fills_from_the_first_page_only(spark, rows):
    games = spark.createDataFrame([(date(2026, 3, 1), 1, 2, False, False, None, None), (date(2026, 3, 2), 1, 2, False, False, 5, 6)],
                                  "game_date date, home_team_id long, away_team_id long, is_conference boolean, "
                                  "is_scrimmage boolean, home_score int, away_score int")
    results = spark.createDataFrame(
        [(2, 1, 0, date(2026, 3, 1), 1, False, True, False, None, None), (1, 2, 0, date(2026, 3, 1), 2, True, False, True, 7, 8),
         (1, 2, 1, date(2026, 3, 2), 2, True, False, True, 1, 1), (2, 3, 1, date(2026, 3, 1), 1, False, False, False, 9, 9)],
        "team_id long, page_id long, pos int, game_date date, opponent_id long, is_conference boolean, is_scrimmage boolean, "
        "is_home boolean, team_score int, opp_score int")
    cols = ("game_date", "is_conference", "is_scrimmage", "home_score", "away_score")
    assert rows(ex.enrich_games(games, results), *cols) == [
        (date(2026, 3, 1), True, True, 7, 8), (date(2026, 3, 2), True, False, 5, 6)]
