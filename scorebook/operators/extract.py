"""Extraction jobs: raw pages to rows, parallel over pages, no shuffle per page.

A page is one input row, so everything that depends on document order (running
headers, first cell of a row) is computed inside that row's arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions import html
from scorebook.functions.clean import (
    blank_to_null, collapse_whitespace, float_prefix, home_away_prefix, int_prefix, month_number,
    parse_day_ordinal, parse_month_day, parse_record, parse_result, parse_result_loose, parse_scoreline,
    season_date, strip_space,
)
from scorebook.functions.ordered import last_value_so_far
from scorebook.sources.sinks import one_per_key

# --- Fixed values: how the source pages mark things.
TEAM_LINK = "school.asp"
FIELD_LINK = "field.asp"
RANKING_TABLE_ID = "rankingTable"
# --- End of fixed values.

_ID_IN_HREF = r"(?i)[?&]id=(\d+)"
# --- Fixed values: headings, and how a date in one is told before it is read.
HEADING_TAGS = ("b", "strong", "h3", "h4")
DATE_LIKE = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b"
CONFERENCE = r"(?i)conference|division"
# --- End of fixed values.

# A block that holds no other block, or a heading, in document order.
_ELEMENT = r"(?is)<(b|strong|h3|h4|tr|div|p)\b[^>]*>[^<]*+(?:<(?!(?:h3|h4|tr|div|p|table)\b|/\1\s*>)[^<]*+)*+</\1\s*>"


def page_number(url: Column | str) -> Column:
    """Numeric ``id`` parameter of an address, null when there is none."""
    col = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(col, _ID_IN_HREF, 1).try_cast("long")


def _under_headers(df: DataFrame, items: str, header: Callable[[Column], Column]) -> DataFrame:
    """Explode an ordered array column into ``(other columns, head, pos, item)``.

    ``header`` maps an item to its heading or null. Every item gets the heading
    before it; headings themselves and items before the first one go. The array
    is cut at its headings inside the row, so no shuffle or window is needed.
    """
    keep = [c for c in df.columns if c != items]
    heads = F.filter(F.transform(F.col(items), lambda x, i: F.struct(header(x).alias("head"), i.alias("pos"))),
                     lambda m: m["head"].isNotNull())
    cut = html.fixed(df, _heads=heads)
    size = F.size(items)
    sections = F.transform("_heads", lambda h, i: F.struct(
        h["head"].alias("head"), h["pos"].alias("pos"),
        F.slice(items, h["pos"] + 2, F.coalesce(F.get("_heads", i + 1)["pos"], size) - h["pos"] - 1).alias("items")))
    return (
        html.fixed(cut, _sections=sections).select(*keep, F.explode("_sections").alias("_s"))
        .select(*keep, F.col("_s.head").alias("head"), F.col("_s.pos").alias("_at"),
                F.posexplode("_s.items").alias("_i", "item"))
        .select(*keep, "head", (F.col("_at") + F.col("_i") + 1).alias("pos"), "item"))


def _cell(i: int) -> Column:
    return strip_space(html.text_of(F.get("_cells", F.lit(i))))


def extract_links(pages: DataFrame, href_contains: str = TEAM_LINK, id_pattern: str | None = None) -> DataFrame:
    """Links to entities as ``(id, name)``; the first link of an id wins.

    Order is page, then position in the page. Links without a number or
    without text do not count. With ``id_pattern`` the id is the text of its first group in the address.
    """
    href = html.attribute(F.col("a"), "href")
    ident = page_number(href) if id_pattern is None else F.nullif(F.regexp_extract(href, id_pattern, 1), F.lit(""))
    links = html.with_fragments(pages.select("page_id", "html"), html.anchors, ("a",), lambda root: [a.written() for a in root.below("a")], "_links")
    found = (
        links.select("page_id", F.posexplode("_links").alias("pos", "a"))
        .filter(F.contains(F.lower(href), F.lit(href_contains.lower())))
        .select("page_id", "pos", ident.alias("id"), strip_space(html.text_of(F.col("a"))).alias("name"))
        .filter((F.col("id") > 0 if id_pattern is None else F.col("id").isNotNull()) & (F.col("name") != "")))
    return one_per_key(found, ["id"], [F.col("page_id"), F.col("pos")]).select("id", "name")


def extract_table_rows(pages: DataFrame, min_cells: int = 1, mode: str = "auto",
                       table_id: str | None = None) -> DataFrame:
    """All table rows with at least ``min_cells`` cells: page columns, ``pos, row_class, cells``."""
    keep = [c for c in pages.columns if c != "html"]
    rows = html.with_rows(pages, mode, table_id).select(*keep, F.posexplode("_rows").alias("pos", "_row"))
    cut = html.fixed(rows, cells=html.cell_texts(F.col("_row"))).filter(F.size("cells") >= min_cells)
    return cut.select(*keep, "pos", html.attribute(F.col("_row"), "class").alias("row_class"), "cells")


def carry_forward(rows: DataFrame, header_col: str, part: list[str], order: str, out: str = "header",
                  block: int = 10_000) -> DataFrame:
    """Every row gets the last header at or before it; rows before any header go.

    For rows already spread over the cluster. ``order`` is an integer position;
    positions are handled in blocks, so a partition of any length is shared out.
    """
    carried = last_value_so_far(rows, F.col(header_col), part, [order],
                                F.floor(F.col(order) / block).cast("long"), out)
    return carried.filter(F.col(out).isNotNull())


def extract_team_schedule(pages: DataFrame, season: int | Column, mode: str = "auto") -> DataFrame:
    """Schedule pages (``team_id, page_id, html``) to schedule rows.

    A row whose whole text is a month name sets the month. A game row has seven
    cells: 2 day, 3 time, 4 opponent, 5 conference flag, 6 result.
    """
    season = season if isinstance(season, Column) else F.lit(season)
    pages = pages.select("team_id", "page_id", season.cast("int").alias("_season"), "html")
    rows = _under_headers(html.with_rows(pages, mode), "_rows", lambda r: month_number(html.text_of(r)))
    cell = lambda i: F.get("_texts", F.lit(i))
    game = (
        html.fixed(rows, _texts=html.cell_texts(F.col("item"))).filter(F.size("_texts") >= 7)
        .select("team_id", "page_id", "pos", "_season", "head", parse_day_ordinal(cell(2)).alias("_day"),
                cell(3).alias("_time"), collapse_whitespace(cell(4)).alias("_opp"),
                F.lower(cell(5)).alias("_conf"), cell(6).alias("_result"))
        .filter(F.col("_day").isNotNull() & (F.col("_opp") != ""))
        .withColumn("_r", parse_result("_result")))
    side = home_away_prefix("_opp")
    return game.select(
        "team_id",
        season_date(F.col("_season"), F.col("head"), F.col("_day")).alias("game_date"),
        blank_to_null("_time").alias("game_time"),
        side["opponent"].alias("opponent"), side["is_home"].alias("is_home"),
        (F.col("_conf") == "yes").alias("is_conference"),
        F.col("_r.result").alias("result"), F.col("_r.team_score").alias("team_score"),
        F.col("_r.opp_score").alias("opp_score"), F.col("_r.is_ot").alias("is_ot"),
        F.col("_season").alias("season"), "page_id", "pos")


def extract_all_schedules(pages: DataFrame, page_map: DataFrame, season: int | Column) -> DataFrame:
    """Schedule rows of every page listed in ``page_map`` (by the id in its url)."""
    known = pages.withColumn("page_number", page_number("url")).join(page_map, "page_number")
    return extract_team_schedule(known.select("team_id", "page_id", "html"), season)


def extract_ranking_table(pages: DataFrame, table_id: str = RANKING_TABLE_ID, season: int | Column = 2026,
                          as_of: Column | None = None) -> DataFrame:
    """Rows of one ranking table: record, ``"8 . Name"``, ..., consensus value.

    A page without that table is an error, as the layout has changed then.
    """
    season = season if isinstance(season, Column) else F.lit(season)
    mark = rf"""(?is)<table\b[^>]*\sid\s*=\s*["']?{table_id}\b"""
    page = F.when(F.col("html").rlike(mark), F.col("html")).otherwise(
        F.raise_error(F.concat(F.lit(f"no table {table_id} on page "), F.col("page_id").cast("string"))).cast("string"))
    rows = extract_table_rows(pages.withColumn("html", page), min_cells=2, table_id=table_id)
    ranked = F.get("cells", F.lit(1))
    dot = F.instr(ranked, ".")
    parsed = rows.filter(dot > 0).select(
        "page_id", "pos", F.get("cells", F.lit(0)).alias("record"),
        int_prefix(F.substring(ranked, F.lit(1), dot - 1)).alias("rank_position"),
        collapse_whitespace(F.substring(ranked, dot + 1, F.length(ranked))).alias("team_name"),
        float_prefix(F.element_at("cells", -1)).alias("consensus"))
    count = parse_record("record")
    stamp = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    return (
        parsed.filter(F.col("rank_position").isNotNull() & (F.col("team_name") != "") & F.col("consensus").isNotNull())
        .select("page_id", season.cast("int").alias("season"), "rank_position", "team_name", "record",
                count["wins"].alias("wins"), count["losses"].alias("losses"), "consensus",
                stamp.alias("scraped_at")))


def _scoreboard_items(root) -> list[str]:
    """Headings, date cells in front of their row, and blocks without blocks inside, in document order."""
    out: list[str] = []
    for node in root.below(*HEADING_TAGS, "tr", "div", "p"):
        if node.tag in HEADING_TAGS:
            out.append(node.written())
        elif not any(True for _ in node.below("tr", "div", "p", "table", "h3", "h4")):
            out += [cell.written() for cell in node.below("td")] if node.tag == "tr" else []
            out.append(node.written())
        elif node.tag == "tr":
            out += [cell.written() for cell in node.below("td") if not any(True for _ in cell.below("tr", "div", "p", "table"))]
    return out


def extract_scoreboard(pages: DataFrame, season: int | Column) -> DataFrame:
    """Date-headed scoreboard pages to neutral games, first row per game.

    A heading or cell that names a month and a day sets the date, also for a game in its own
    row; one that looks like a date and is none ends it. An element with an ``@`` and two team
    links is a game, away team first. The innermost element counts.
    """
    season = season if isinstance(season, Column) else F.lit(season)
    pages = pages.select("page_id", season.cast("int").alias("_season"), "html")

    def as_date(element: Column) -> Column:
        text = html.text_of(element)
        told = (element.rlike(rf"(?i)^<(?:{'|'.join(HEADING_TAGS)}|td)\b") & text.rlike(DATE_LIKE) & text.rlike(r"\d")
                & ~F.contains(text, F.lit("@")))
        return F.when(told, F.struct(parse_month_day(text, F.col("_season")).alias("date")))

    def found(page: Column) -> Column:
        inner = lambda e: F.regexp_extract_all(e, F.lit(r"(?is)<(b|strong|td)\b[^>]*>.*?</\1\s*>"), F.lit(0))
        heading = lambda e: e.rlike(rf"(?i)^<(?:{'|'.join(HEADING_TAGS)})\b")
        return F.flatten(F.transform(F.regexp_extract_all(page, F.lit(_ELEMENT), F.lit(0)), lambda e: F.when(heading(e), F.array(e)).otherwise(
            F.concat(F.filter(inner(e), lambda i: html.text_of(i).rlike(DATE_LIKE)), F.array(e)))))

    keep = html.with_fragments(pages, found, ("tr", "td", "div", "p", *HEADING_TAGS), _scoreboard_items, "_items")
    rows = _under_headers(keep, "_items", as_date).select("page_id", "_season", F.col("head.date").alias("head"), "pos", "item").filter(
        F.contains("item", F.lit("@")) & F.col("head").isNotNull())
    href = lambda i: html.attribute(F.get("_links", F.lit(i)), "href")
    team_links = F.filter(html.anchors(F.col("item")), lambda a: F.contains(F.lower(html.attribute(a, "href")), F.lit(TEAM_LINK)))
    css = F.lower(F.coalesce(html.attribute(F.col("item"), "class"), F.lit("")))
    games = (
        html.fixed(rows, _links=team_links).filter(F.size("_links") >= 2)
        .select("page_id", "pos", "_season", "head", strip_space(html.text_of(F.col("item"))).alias("_text"),
                css.alias("_css"), page_number(href(0)).alias("away_team_id"), page_number(href(1)).alias("home_team_id"),
                html.text_of(html.first_anchor(F.col("item"), FIELD_LINK)).alias("_field"))
        .filter(F.contains("_text", F.lit("@")) & (F.col("away_team_id") > 0) & (F.col("home_team_id") > 0)
                & (F.col("away_team_id") != F.col("home_team_id")))
        .withColumn("_score", parse_scoreline("_text")))
    first = one_per_key(games, ["head", "home_team_id", "away_team_id"], [F.col("page_id"), F.col("pos")])
    return first.select(
        F.col("_season").alias("season"), F.col("head").alias("game_date"), "away_team_id", "home_team_id",
        F.col("_score.away_score").alias("away_score"), F.col("_score.home_score").alias("home_score"),
        (F.contains("_css", F.lit("conf")) | F.contains("_css", F.lit("red"))).alias("is_conference"),
        F.col("_text").rlike("(?i)scrimmage").alias("is_scrimmage"), strip_space("_field").alias("location"))


def extract_standings(pages: DataFrame, season: int | Column) -> DataFrame:
    """Conference-headed standings rows; counts that cannot be read are 0.

    Headings are b, strong, h3 and h4 elements, also inside a row; rows before the first
    one keep a null conference. A row around another table is layout.
    """
    season = season if isinstance(season, Column) else F.lit(season)
    pages = pages.select("page_id", season.cast("int").alias("_season"), "html")
    marks = "|".join(HEADING_TAGS)

    def conference(element: Column) -> Column:
        text = html.text_of(element)
        heading = element.rlike(rf"(?i)^<(?:{marks})\b") & text.rlike(CONFERENCE)
        return F.when(heading, strip_space(F.regexp_replace(text, CONFERENCE, "")))

    def found(page: Column) -> Column:
        each = F.regexp_extract_all(page, F.lit(rf"(?is)<({marks}|tr)\b[^>]*>.*?</\1\s*>"), F.lit(0))
        inner = lambda e: F.regexp_extract_all(e, F.lit(rf"(?is)<({marks})\b[^>]*>.*?</\1\s*>"), F.lit(0))
        return F.flatten(F.transform(each, lambda e: F.when(e.rlike("(?i)^<tr"), F.concat(F.array(e), inner(e))).otherwise(F.array(e))))

    def parsed(root) -> list[str]:
        return [n.written() for n in root.below(*HEADING_TAGS, "tr") if n.tag != "tr" or not any(True for _ in n.below("table"))]

    # An empty heading in front keeps the rows above the first real one.
    lead = "<b></b>"
    none = F.struct(F.lit(None).cast("string").alias("name"))
    head = lambda e: F.when(e == lead, none).otherwise(
        F.when(conference(e).isNotNull(), F.struct(conference(e).alias("name"))))
    read = html.with_fragments(pages, found, ("tr", "td", *HEADING_TAGS), parsed, "_elements")
    items = read.select("page_id", "_season", F.concat(F.array(F.lit(lead)), "_elements").alias("_items"))
    rows = html.fixed(_under_headers(items, "_items", head), _cells=html.cells(F.col("item"))).filter(F.size("_cells") >= 3)
    rows = html.fixed(rows, _team=html.first_anchor(F.get("_cells", F.lit(0)), TEAM_LINK))
    team_id = page_number(html.attribute(F.col("_team"), "href"))
    count = lambda i: F.coalesce(int_prefix(_cell(i)), F.lit(0))
    return (
        rows.filter((team_id > 0) & (strip_space(html.text_of(F.col("_team"))) != ""))
        .select(team_id.alias("team_id"), F.col("_season").alias("season"), F.col("head.name").alias("conference"),
                F.lit(0).alias("conf_wins"), F.lit(0).alias("conf_losses"),
                count(1).alias("overall_wins"), count(2).alias("overall_losses")))


def extract_team_results(pages: DataFrame, season: int | Column, mode: str = "auto") -> DataFrame:
    """Team pages (``team_id, page_id, html``) to one row per readable result.

    Five cells: date, time, opponent link, conference flag, result. Rows whose
    date or opponent number cannot be read are dropped.
    """
    season = season if isinstance(season, Column) else F.lit(season)
    pages = pages.select("team_id", "page_id", season.cast("int").alias("_season"), "html")
    rows = html.with_rows(pages, mode).select(
        "team_id", "page_id", "_season", F.posexplode("_rows").alias("pos", "_row"))
    rows = html.fixed(rows, _cells=html.cells(F.col("_row"))).filter(F.size("_cells") >= 5)
    opponent = page_number(html.attribute(html.first_anchor(F.get("_cells", F.lit(2)), TEAM_LINK), "href"))
    score = parse_result_loose(_cell(4))
    return (
        rows.select(
            "team_id", "page_id", "pos",
            parse_month_day(_cell(0), F.col("_season")).alias("game_date"), opponent.alias("opponent_id"),
            (F.lower(_cell(3)) == "yes").alias("is_conference"),
            F.concat(_cell(2), _cell(4)).rlike("(?i)scrimmage").alias("is_scrimmage"),
            (~F.startswith(_cell(2), F.lit("@"))).alias("is_home"),
            score["team_score"].alias("team_score"), score["opp_score"].alias("opp_score"))
        .filter(F.col("game_date").isNotNull() & (F.col("opponent_id") > 0)))


def enrich_games(games: DataFrame, team_results: DataFrame) -> DataFrame:
    """Add flags and missing scores to games from team-page rows.

    Flags are OR-ed over all matching rows; a game without a home score takes
    both scores from the first scored row in page order. All pages count.
    """
    home = F.col("is_home")
    oriented = team_results.select(
        F.col("game_date"),
        F.when(home, F.col("team_id")).otherwise(F.col("opponent_id")).alias("home_team_id"),
        F.when(home, F.col("opponent_id")).otherwise(F.col("team_id")).alias("away_team_id"),
        "is_conference", "is_scrimmage", "page_id", "pos",
        F.when(F.col("team_score").isNotNull(), F.struct(
            F.when(home, F.col("team_score")).otherwise(F.col("opp_score")).alias("h"),
            F.when(home, F.col("opp_score")).otherwise(F.col("team_score")).alias("a"))).alias("_s"))
    key = ["game_date", "home_team_id", "away_team_id"]
    facts = oriented.groupBy(*key).agg(
        F.bool_or("is_conference").alias("_conf"), F.bool_or("is_scrimmage").alias("_scrim"),
        F.min_by("_s", F.when(F.col("_s").isNotNull(), F.struct("page_id", "pos"))).alias("_fill"))
    missing = F.col("home_score").isNull() & F.col("_fill").isNotNull()
    return (
        games.join(facts, key, "left")
        .withColumn("is_conference", F.col("is_conference") | F.coalesce("_conf", F.lit(False)))
        .withColumn("is_scrimmage", F.col("is_scrimmage") | F.coalesce("_scrim", F.lit(False)))
        .withColumns({"away_score": F.when(missing, F.col("_fill.a")).otherwise(F.col("away_score")),
                      "home_score": F.when(missing, F.col("_fill.h")).otherwise(F.col("home_score"))})
        .select(*games.columns))
