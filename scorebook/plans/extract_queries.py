"""Extraction jobs over the given pages and over pages rendered from the tables.

The given pages hold no tables, so schedule, ranking, scoreboard and standings
pages are rendered from orders, customers and suppliers, one page per row; the
SQL side computes the expected rows without any HTML.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorebook.functions.clean import MONTH_ABBREVIATIONS, MONTH_NAMES
from scorebook.functions.html import fixed
from scorebook.operators import extract as ex
from scorebook.plans import adapters as ad
from scorebook.plans.adapters import sql, text
from scorebook.plans.registry import query
from scorebook.sources.readers import spread


def _pick(words: list[str], index) -> object:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def _orders(s, d):
    n = ad.team_count(s, d)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return spread(ad.table(s, d, "orders"), "o_orderkey").select(
        k.alias("k"), c.alias("c"), (c % n).alias("team"), ((c + 1 + k % (n - 1)) % n).alias("opp"),
        (F.col("o_orderstatus") == "F").alias("home"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


ORDERS_SQL = """(SELECT o_orderkey AS k, o_custkey AS c, o_custkey % (SELECT n FROM nt) AS team,
    (o_custkey + 1 + o_orderkey % ((SELECT n FROM nt) - 1)) % (SELECT n FROM nt) AS opp,
    o_orderstatus = 'F' AS home, o_orderpriority = '1-URGENT' AS urgent FROM orders)"""


# --- the given pages ------------------------------------------------------------------------

@query("extract_links", """
    SELECT id, name FROM (
        SELECT (page_id * 10 + pos) % 397 AS id, regexp_extract(a, '>(.*?)</a>', 1) AS name,
               row_number() OVER (PARTITION BY (page_id * 10 + pos) % 397 ORDER BY page_id, pos) AS rn
        FROM (SELECT page_id, unnest(links) AS a, generate_subscripts(links, 1) - 1 AS pos
              FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>') AS links FROM pages))
        WHERE (page_id * 10 + pos) % 397 > 0 AND regexp_extract(a, '>(.*?)</a>', 1) <> '')
    WHERE rn = 1""")
def _(s, d):
    # Give the links of every page entity numbers, so that ids repeat across pages.
    pages = ad.table(s, d, "pages", "page_id", "html")
    links = F.regexp_extract_all("_raw", F.lit('(?s)<a href="[^"]*">.*?</a>'), F.lit(0))
    numbered = F.transform(links, lambda a, i: F.regexp_replace(
        a, F.lit('^<a href="[^"]*"'),
        F.concat(F.lit('<a class="t" href="/BHS/School.asp?id='), ((F.col("page_id") * 10 + i) % 397).cast("string"), F.lit('"'))))
    return ex.extract_links(fixed(pages.withColumnRenamed("html", "_raw"), html=F.array_join(numbered, " ")).drop("_raw"))


@query("extract_page_links", r"""
    SELECT id, name FROM (
        SELECT regexp_extract(a, 'href="/([^"]*)"', 1) AS id, replace(replace(regexp_extract(a, '>(.*?)</a>', 1), '&quot;', '"'), '&amp;', '&') AS name,
               row_number() OVER (PARTITION BY regexp_extract(a, 'href="/([^"]*)"', 1) ORDER BY page_id, pos) AS rn
        FROM (SELECT page_id, unnest(links) AS a, generate_subscripts(links, 1) AS pos FROM (
            SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script>.*?</script>', '', 'g'),
                                               '(?s)<a href="[^"]*">.*?</a>') AS links FROM pages))
        WHERE regexp_extract(a, 'href="/([^"]*)"', 1) <> '' AND trim(regexp_extract(a, '>(.*?)</a>', 1)) <> '')
    WHERE rn = 1""")
def _(s, d):
    # The pages as they are; entities are told apart by the path of their address.
    return ex.extract_links(ad.table(s, d, "pages", "page_id", "html"), "/", r"^/(.+)$")


@query("carry_forward_header", r"""
    WITH el AS (SELECT page_id, unnest(els) AS e, generate_subscripts(els, 1)::INTEGER - 1 AS pos
                FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h1>.*?</h1>|<li>.*?</li>|<p>.*?</p>') AS els FROM pages))
    SELECT page_id, pos, md5(e) AS element, md5(header) AS header FROM (
        SELECT *, last_value(CASE WHEN starts_with(e, '<h1>') THEN e END IGNORE NULLS)
                  OVER (PARTITION BY page_id ORDER BY pos) AS header FROM el)
    WHERE header IS NOT NULL""")
def _(s, d):
    found = F.regexp_extract_all("html", F.lit("(?s)<h1>.*?</h1>|<li>.*?</li>|<p>.*?</p>"), F.lit(0))
    rows = ad.table(s, d, "pages", "page_id", "html").select("page_id", F.posexplode(found).alias("pos", "e"))
    rows = rows.select("page_id", "pos", F.md5("e").alias("element"), F.when(F.startswith("e", F.lit("<h1>")), F.col("e")).alias("_h"))
    return ex.carry_forward(rows, "_h", ["page_id"], "pos", block=2).drop("_h").withColumn("header", F.md5("header"))


# --- rendered pages ---------------------------------------------------------------------------

def _cells(*values: object, close: str = "</td>"):
    return text(*[part for v in values for part in ("<td>", v, close)])


def _schedule_pages(s, d):
    """Two months per page; every tenth page nests its table, every tenth omits end tags."""
    o = _orders(s, d)
    k, c = F.col("k"), F.col("c")
    result = (F.when(k % 4 == 0, text("W ", c % 15, "-", k % 15)).when(k % 4 == 1, text(" l ", c % 15, "-", k % 15, " OT"))
              .when(k % 4 == 2, "").otherwise("not played"))
    opponent = text(F.when(F.col("home"), "").otherwise("@ "), "Team  &amp; ", F.col("opp"))
    clock = F.when(k % 5 == 0, " ").otherwise(text(k % 12 + 1, ":30pm"))
    conf = F.when(F.col("urgent"), "Yes").otherwise("No")

    def game(day, close="</td>", end="</tr>"):
        return text('<tr class="g">', _cells("1", "Mo", day, clock, opponent, conf, result, close=close), end)

    def body(close, end):
        day1 = text(c % 28 + 1, "th")
        day2 = F.when(k % 7 == 0, "TBD").otherwise(text(k % 28 + 1, "st"))
        head = lambda m: text("<tr>", _cells(text(" ", _pick([m.title() for m in MONTH_NAMES], m), " "), close=close), end)
        return text("<table>", game("9th", close, end), head(k % 12), game(day1, close, end),
                    "<tr>", _cells("short", "row", close=close), end, head((k + 1) % 12), game(day2, close, end), "</table>")

    flat = body("</td>", "</tr>")
    page = (F.when(k % 10 == 0, text("<table><tr><td>", flat, "</td></tr></table>"))
            .when(k % 10 == 1, body("", "")).otherwise(flat))
    keyed = o.withColumns({"page_id": k, "url": text("https://host.example/BHS/school.asp?id=", F.col("team"))})
    return fixed(keyed, html=text("<html><body>", page, "</body></html>")).select("page_id", "team", "url", "html")


SCHEDULE_ROWS = f"""
    SELECT k AS page_id, team, strftime(make_date(2026, mon::BIGINT, day::BIGINT), '%Y-%m-%d') AS game_date,
           CASE WHEN k % 5 <> 0 THEN (k % 12 + 1) || ':30pm' END AS game_time, 'Team & ' || opp AS opponent,
           home AS is_home, urgent AS is_conference,
           CASE k % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'L' END AS result,
           CASE WHEN k % 4 < 2 THEN (c % 15)::INTEGER END AS team_score,
           CASE WHEN k % 4 < 2 THEN (k % 15)::INTEGER END AS opp_score, k % 4 IN (1, 3) AS is_ot, 2026::INTEGER AS season
    FROM (SELECT *, k % 12 + 1 AS mon, c % 28 + 1 AS day FROM {ORDERS_SQL}
          UNION ALL SELECT *, (k + 1) % 12 + 1, k % 28 + 1 FROM {ORDERS_SQL} WHERE k % 7 <> 0)"""
SCHEDULE_OUT = ("game_date", "game_time", "opponent", "is_home", "is_conference", "result", "team_score", "opp_score",
                "is_ot", "season", "page_id")


@query("extract_table_rows", sql(f"""
    SELECT k AS page_id, CASE WHEN i = 0 THEN '9th' WHEN i = 1 THEN (c % 28 + 1) || 'th'
           ELSE CASE WHEN k % 7 = 0 THEN 'TBD' ELSE (k % 28 + 1) || 'st' END END AS day, 'Team  & ' || opp AS opponent
    FROM {ORDERS_SQL}, range(3) r(i)""", "nt"))
def _(s, d):
    # On nested pages an outer row holds all cells of its table; it is told by its first cell.
    rows = ex.extract_table_rows(_schedule_pages(s, d), min_cells=7).filter(F.size("cells") == 7)
    return rows.select("page_id", F.get("cells", F.lit(2)).alias("day"),
                       F.regexp_replace(F.get("cells", F.lit(4)), "^@ ", "").alias("opponent"))


@query("extract_team_schedule", sql(f"""
    SELECT 's' || team AS team_id, {", ".join(SCHEDULE_OUT)} FROM ({SCHEDULE_ROWS})""", "nt"))
def _(s, d):
    pages = _schedule_pages(s, d).withColumn("team_id", text("s", F.col("team")))
    return ex.extract_team_schedule(pages.select("team_id", "page_id", "html"), 2026).select("team_id", *SCHEDULE_OUT)


@query("extract_all_schedules", sql(f"""
    SELECT 's' || team AS team_id, {", ".join(SCHEDULE_OUT)} FROM ({SCHEDULE_ROWS}) WHERE team % 2 = 0""", "nt"))
def _(s, d):
    page_map = ad.table(s, d, "supplier", "s_suppkey").filter("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").alias("page_number"), text("s", F.col("s_suppkey")).alias("team_id"))
    return ex.extract_all_schedules(_schedule_pages(s, d), page_map, 2026).select("team_id", *SCHEDULE_OUT)


@query("extract_ranking_table", """
    SELECT c_custkey AS page_id, 2026::INTEGER AS season, (c_custkey + 1)::INTEGER AS rank_position,
           'Team ' || c_name AS team_name,
           CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE (c_custkey % 15) || '-' || (c_nationkey % 12) END AS record,
           CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_custkey % 15 END::INTEGER AS wins,
           CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_nationkey % 12 END::INTEGER AS losses,
           c_acctbal AS consensus, TIMESTAMP '2026-05-01' AS scraped_at FROM customer""")
def _(s, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    record = F.when(key % 6 == 0, "x").otherwise(text(key % 15, "-", nation % 12))
    row = lambda name, value: text("<tr>", _cells(record, name, "pad", value), "</tr>")
    name = text(key + 1, " . Team  ", F.col("c_name"))
    other = text('<table id="other">', row("1 . Wrong", "5.0"), "</table>")
    page = text(other, '<table class="x" id="rankingTable"><tbody>', row(name, F.col("c_acctbal")), row("no dot", "1.5"),
                row("x . No Rank", "1.5"), row("3 . No Value", "n/a"), row("4 . ", "2.0"), "<tr><td>5-0</td></tr></tbody></table>")
    pages = fixed(spread(ad.table(s, d, "customer"), "c_custkey").withColumn("page_id", key), html=page).select("page_id", "html")
    return ex.extract_ranking_table(pages, "rankingTable", 2026, ad.ntz("2026-05-01 00:00:00"))


def _scoreboard_pages(s, d):
    """One dated page per order: its game, a copy, an upcoming game and a broken line."""
    k, c = F.col("k"), F.col("c")
    month = _pick([m.title() for m in MONTH_ABBREVIATIONS], k % 12)
    head = text("<h3>Early</h3><p>Nobody 1 @ Nowhere 2</p><b>Monday, ", month, " ", c % 28 + 1, "th</b>")
    team = lambda i: text('<a href="/BHS/school.asp?id=', i, '">Team ', i, "x</a>")
    field = F.when(k % 3 == 0, text(' <a href="field.asp?id=4"> Field ', k % 9, " </a>")).otherwise("")
    label = F.when(k % 11 == 0, " (Scrimmage)").otherwise("")
    away, home = F.col("opp") + 1, F.col("team") + 1
    css = F.when(F.col("urgent"), ' class="ConfGame"').otherwise("")
    game = lambda a, h: text(team(away), " ", a, " @ ", team(home), " ", h, field, label)
    done = game(text(c % 20), text(k % 20))
    first = F.when(k % 4 == 0, text("<p", css, ">", team(away), " 7:00pm @ ", team(home), field, label, "</p>")).when(
        k % 4 == 1, text("<div", css, ">", done, "</div>")).otherwise(
        text("<table><tr", css, "><td>", done, "</td></tr></table>"))
    again = text("<p>", game("1", "1"), "</p>")
    broken = text("<p>", team(home), " 3 @ ", team(home), " 4</p><p>", team(home), " @ none</p>")
    page = text("<html><body>", head, first, again, broken, "</body></html>")
    return fixed(_orders(s, d).withColumn("page_id", k), html=page).select("page_id", "html")


@query("extract_scoreboard_games", sql(f"""
    SELECT 2026::INTEGER AS season, strftime(make_date(2026, (k % 12 + 1)::BIGINT, (c % 28 + 1)::BIGINT), '%Y-%m-%d') AS game_date,
           opp + 1 AS away_team_id, team + 1 AS home_team_id,
           CASE WHEN k % 4 <> 0 THEN (c % 20)::INTEGER END AS away_score,
           CASE WHEN k % 4 <> 0 THEN (team + 1)::INTEGER END AS home_score,
           urgent AS is_conference, k % 11 = 0 AS is_scrimmage, CASE WHEN k % 3 = 0 THEN 'Field ' || (k % 9) END AS location
    FROM {ORDERS_SQL}
    QUALIFY row_number() OVER (PARTITION BY game_date, away_team_id, home_team_id ORDER BY k) = 1""", "nt"))
def _(s, d):
    # The home score is the first number right of the "@", here part of the team's name.
    return ex.extract_scoreboard(_scoreboard_pages(s, d), 2026)


@query("extract_standings", """
    SELECT c_custkey + 1 AS team_id, 2026::INTEGER AS season, conference, 0::INTEGER AS conf_wins, 0::INTEGER AS conf_losses,
           w AS overall_wins, l AS overall_losses
    FROM (SELECT c_custkey, 'Group ' || c_mktsegment AS conference, (c_custkey % 15)::INTEGER AS w,
                 CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_nationkey END::INTEGER AS l FROM customer
          UNION ALL SELECT c_custkey + 1000000, NULL, 1, 2 FROM customer WHERE c_custkey % 3 = 0)""")
def _(s, d):
    key = F.col("c_custkey")
    row = lambda i, w, l: text('<tr><td><a href="school.asp?id=', i, '">Team ', i, "</a></td>", _cells(w, l), "</tr>")
    losses = F.when(key % 4 == 0, "n/a").otherwise(text(F.col("c_nationkey"), " (x)"))
    early = F.when(key % 3 == 0, row(key + 1000001, "1", "2")).otherwise("")
    page = text("<table>", early, "</table><h3>Group ", F.col("c_mktsegment"), " Conference</h3><table>",
                row(key + 1, key % 15, losses), "<tr><td>no link</td><td>1</td><td>2</td></tr>",
                '<tr><td><a href="school.asp?id=77"> </a></td><td>1</td><td>2</td></tr></table>')
    pages = fixed(spread(ad.table(s, d, "customer"), "c_custkey").withColumn("page_id", key), html=page).select("page_id", "html")
    return ex.extract_standings(pages, 2026)


@query("extract_team_results", sql(f"""
    SELECT team + 1 AS team_id, k AS page_id,
           strftime(make_date(2026, (k % 12 + 1)::BIGINT, (c % 28 + 1)::BIGINT), '%Y-%m-%d') AS game_date, opp + 1 AS opponent_id,
           urgent AS is_conference, k % 11 = 0 AS is_scrimmage, home AS is_home,
           CASE WHEN k % 4 < 3 THEN (c % 15)::INTEGER END AS team_score,
           CASE WHEN k % 4 < 3 THEN (k % 15)::INTEGER END AS opp_score FROM {ORDERS_SQL}""", "nt"))
def _(s, d):
    k, c = F.col("k"), F.col("c")
    date = text("Mon, ", _pick([m.title() for m in MONTH_ABBREVIATIONS], k % 12), " ", c % 28 + 1, "th")
    link = text(F.when(F.col("home"), "").otherwise("@"), ' <a href="school.asp?id=', F.col("opp") + 1, '">Team</a>')
    conf = F.when(F.col("urgent"), "YES").otherwise("")
    result = text(F.when(k % 4 == 3, "").otherwise(text("W", c % 15, "-", k % 15)), F.when(k % 11 == 0, " scrimmage").otherwise(""))
    row = lambda when, who: text("<tr>", _cells(when, "4pm", who, conf, result), "</tr>")
    page = text("<table>", row(date, link), row("Mo 16th", link), row(date, "Team without link"), "</table>")
    pages = fixed(_orders(s, d).withColumns({"team_id": F.col("team") + 1, "page_id": k}), html=page).select(
        "team_id", "page_id", "html")
    return ex.extract_team_results(pages, 2026).drop("pos")


@query("enrich_games_from_pages", sql("""
    WITH g AS (SELECT game_date, home_team_id, away_team_id, is_conference AND slot > 3 AS is_conference, false AS is_scrimmage,
                      CASE WHEN slot % 2 = 0 THEN home_score END AS home_score,
                      CASE WHEN slot % 2 = 0 THEN away_score END AS away_score, season, home_score AS h, away_score AS a,
                      is_conference AS c, is_scrimmage AS sc, slot FROM games),
         fact AS (SELECT season, game_date, home_team_id, away_team_id, c, sc, slot, h, a FROM g WHERE slot <> 6)
    SELECT g.season, g.game_date::VARCHAR AS game_date, g.home_team_id, g.away_team_id,
           g.is_conference OR coalesce(f.c, false) AS is_conference, coalesce(f.sc, false) AS is_scrimmage,
           CASE WHEN g.home_score IS NULL AND f.h IS NOT NULL THEN f.h + 100 ELSE g.home_score END AS home_score,
           CASE WHEN g.home_score IS NULL AND f.h IS NOT NULL THEN f.a + 200 ELSE g.away_score END AS away_score
    FROM g LEFT JOIN fact f USING (game_date, home_team_id, away_team_id)""", "games").replace(
        "WITH g AS", ", g AS", 1).replace(") , g AS", "), g AS"))
def _(s, d):
    # Team-page rows of both sides: the away page comes first and scores differ per page.
    g = ad.games(s, d)
    found = g.filter("slot <> 6")
    page = lambda me, opp, home, number, da, db: found.select(
        F.col(f"{me}_team_id").alias("team_id"), F.lit(number).alias("page_id"), F.lit(0).alias("pos"), "game_date",
        F.col(f"{opp}_team_id").alias("opponent_id"), "is_conference", "is_scrimmage", F.lit(home).alias("is_home"),
        (F.col(f"{me}_score") + da).alias("team_score"), (F.col(f"{opp}_score") + db).alias("opp_score"))
    results = page("away", "home", False, 1, 200, 100).unionByName(page("home", "away", True, 2, 300, 400))
    half = F.col("slot") % 2 == 0
    start = g.select("season", "game_date", "home_team_id", "away_team_id",
                     (F.col("is_conference") & (F.col("slot") > 3)).alias("is_conference"), F.lit(False).alias("is_scrimmage"),
                     F.when(half, F.col("home_score")).alias("home_score"), F.when(half, F.col("away_score")).alias("away_score"))
    return ex.enrich_games(start, results)
