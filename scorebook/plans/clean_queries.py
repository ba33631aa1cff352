"""Cleaning expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorebook.functions import clean
from scorebook.plans import adapters as ad
from scorebook.plans.adapters import sql, text
from scorebook.plans.registry import query

MONTH_CASE = "CASE lower(m) " + " ".join(
    f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(clean.MONTH_ABBREVIATIONS)) + " END"


@query("parse_month_day", f"""
    SELECT o_orderkey, TRY_CAST('2026-' || {MONTH_CASE} || '-' || dd AS DATE)::VARCHAR AS game_date
    FROM (SELECT o_orderkey, substr('JanFebMarAprMayJunJulAugSepOctNovDecFoo', 1 + 3 * (o_orderkey % 13)::INTEGER, 3) AS m,
                 (o_custkey % 31 + 1)::VARCHAR AS dd FROM orders)""")
def _(s, d):
    o = ad.table(s, d, "orders", "o_orderkey", "o_custkey")
    names = F.array(*[F.lit(n) for n in "January Febr. Mar April may Jun JUL August Sept. October Nov Dec. Foo".split()])
    day = F.col("o_custkey") % 31 + 1
    label = text("Mo, ", F.get(names, (F.col("o_orderkey") % 13).cast("int")), " ", day, "th")
    return o.select("o_orderkey", clean.parse_month_day(label, 2026).alias("game_date"))


@query("parse_day_ordinal", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 32 = 0 THEN NULL
                            ELSE (o_custkey % 32)::INTEGER END AS day FROM orders""")
def _(s, d):
    o = ad.table(s, d, "orders", "o_orderkey", "o_custkey")
    label = F.when(F.col("o_orderkey") % 11 == 0, "TBD").otherwise(text("the ", F.col("o_custkey") % 32, "nd"))
    return o.select("o_orderkey", clean.parse_day_ordinal(label).alias("day"))


@query("parse_scoreline", sql("""
    SELECT season, home_team_id, away_team_id, game_date::VARCHAR AS game_date,
           CASE WHEN slot <> 5 THEN away_score END AS parsed_away,
           CASE WHEN slot NOT IN (5, 6) THEN home_score END AS parsed_home FROM games""", "games"))
def _(s, d):
    g = ad.games(s, d)
    away, home = F.coalesce(F.col("away_score").cast("string"), F.lit("")), F.coalesce(F.col("home_score").cast("string"), F.lit(""))
    line = (F.when(F.col("slot") == 5, text("Team A 7:00pm @ Team B"))
            .when(F.col("slot") == 6, text("Team A ", away, " @ 7:00 Team B"))
            .otherwise(text("Team A ", away, "  @ Team B ", home, " OT")))
    score = clean.parse_scoreline(line)
    return g.select("season", "home_team_id", "away_team_id", "game_date",
                    score["away_score"].alias("parsed_away"), score["home_score"].alias("parsed_home"))


@query("parse_result", sql("""
    SELECT season, me AS team_id, opp AS opponent_id, game_date::VARCHAR AS game_date, is_home,
           CASE WHEN my_score IS NOT NULL AND slot <> 4 THEN CASE WHEN my_score > opp_score THEN 'W' ELSE 'L' END END AS result,
           CASE WHEN my_score IS NOT NULL AND slot <> 4 THEN my_score END AS team_score,
           CASE WHEN my_score IS NOT NULL AND slot <> 4 THEN opp_score END AS opp_score,
           (slot = 4 OR (my_score IS NOT NULL AND is_overtime)) AS is_ot,
           (my_score IS NOT NULL AND slot <> 4 AND is_overtime) AS strict_ot FROM sides""", "sides"))
def _(s, d):
    from scorebook.operators.reshape import to_perspective
    p = to_perspective(ad.games(s, d))
    won = F.when(F.col("my_score") > F.col("opp_score"), "w").otherwise("L")
    label = (F.when(F.col("slot") == 4, "not played").when(F.col("my_score").isNull(), "  ")
             .otherwise(text(" ", won, "  ", F.col("my_score"), "-", F.col("opp_score"),
                             F.when(F.col("is_overtime"), " OT ").otherwise(""))))
    r = clean.parse_result(label)
    return p.select("season", "team_id", "opponent_id", "game_date", "is_home", r["result"].alias("result"),
                    r["team_score"].alias("team_score"), r["opp_score"].alias("opp_score"), r["is_ot"].alias("is_ot"),
                    clean.parse_result(label, strict=True)["is_ot"].alias("strict_ot"))


@query("parse_result_loose", sql("""
    SELECT season, home_team_id, away_team_id, game_date::VARCHAR AS game_date, home_score AS team_score,
           away_score AS opp_score FROM games""", "games"))
def _(s, d):
    g = ad.games(s, d)
    label = F.when(F.col("home_score").isNotNull(), text("Final: w", F.col("home_score"), "-", F.col("away_score"), "!"))
    r = clean.parse_result_loose(label)
    return g.select("season", "home_team_id", "away_team_id", "game_date", r["team_score"].alias("team_score"),
                    r["opp_score"].alias("opp_score"))


@query("parse_record", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_suppkey % 15 END::INTEGER AS wins,
           CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_nationkey % 12 END::INTEGER AS losses,
           (s_suppkey % 15) || '-' || (s_nationkey % 12) AS record FROM supplier""")
def _(s, d):
    t = ad.table(s, d, "supplier", "s_suppkey", "s_nationkey")
    wins, losses = F.col("s_suppkey") % 15, F.col("s_nationkey") % 12
    r = clean.parse_record(F.when(F.col("s_suppkey") % 9 == 0, "x").otherwise(text(wins, " - ", losses)))
    return t.select("s_suppkey", r["wins"].alias("wins"), r["losses"].alias("losses"),
                    clean.format_record(wins, losses).alias("record"))


@query("home_away_prefix", sql("""
    SELECT season, team_id, game_date::VARCHAR AS game_date, is_home, trim(opponent) AS opponent FROM schedule""", "schedule"))
def _(s, d):
    p = ad.schedule(s, d)
    h = clean.home_away_prefix(F.when(F.col("is_home"), F.trim("opponent")).otherwise(text("@  ", F.col("opponent"))))
    return p.select("season", "team_id", "game_date", h["is_home"].alias("is_home"), h["opponent"].alias("opponent"))


@query("normalize_name", "SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS normalized FROM customer")
def _(s, d):
    return ad.table(s, d, "customer", "c_custkey", "c_name").select(
        "c_custkey", clean.normalize_name(text("  ", F.col("c_name"), " ")).alias("normalized"))


@query("collapse_whitespace", r"""
    SELECT doc_id, regexp_replace(regexp_replace(text, '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'),
                                  '^ +| +$', '', 'g') AS clean_text FROM documents""")
def _(s, d):
    return ad.table(s, d, "documents", "doc_id", "text").select(
        "doc_id", clean.collapse_whitespace("text").alias("clean_text"))


@query("blank_to_null", """
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment,
           CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE c_mktsegment END AS with_default FROM customer""")
def _(s, d):
    t = ad.table(s, d, "customer", "c_custkey", "c_mktsegment")
    value = clean.blank_to_null(F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")))
    return t.select("c_custkey", value.alias("segment"), clean.default_if_null(value, "none").alias("with_default"))


@query("decimal_round", """
    SELECT p_partkey, round(p_retailprice / 7, 4) AS rounded, round(p_retailprice / 7, 2) AS stored,
           round(p_retailprice / 7, 3) AS stored3 FROM part""")
def _(s, d):
    v = F.col("p_retailprice") / 7
    return ad.table(s, d, "part", "p_partkey", "p_retailprice").select(
        "p_partkey", clean.round4(v).alias("rounded"), clean.store_decimal(v, 2).alias("stored"),
        clean.store_decimal(v, 3).alias("stored3"))


@query("cap_abs_diff", sql("""
    SELECT season, home_team_id, away_team_id, game_date::VARCHAR AS game_date,
           CASE WHEN home_score IS NOT NULL THEN least(abs(home_score - away_score), 10) END::INTEGER AS diff,
           CASE WHEN home_score IS NOT NULL THEN greatest(-10, least(home_score - away_score, 10)) END::INTEGER AS signed_diff
    FROM games""", "games"))
def _(s, d):
    return ad.games(s, d).select(
        "season", "home_team_id", "away_team_id", "game_date",
        clean.cap_abs_diff("home_score", "away_score").alias("diff"),
        clean.cap_abs_diff("home_score", "away_score", signed=True).alias("signed_diff"))


@query("date_prefix", """
    SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS prefix, year(o_orderdate)::INTEGER AS year, o_orderkey % 2 = 0 AS iso_midnight
    FROM orders""")
def _(s, d):
    stamp = F.when(F.col("o_orderkey") % 2 == 0, text(F.to_date("o_orderdate"), "T00:00:00.000Z")).otherwise(
        F.col("o_orderdate").cast("string"))
    return ad.table(s, d, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", clean.date_prefix(stamp).alias("prefix"), F.year(F.to_date(clean.date_prefix(stamp))).alias("year"),
        clean.is_iso_midnight(stamp).alias("iso_midnight"))


@query("parse_clock_time", sql("""
    SELECT season, team_id, game_date::VARCHAR AS game_date, opponent,
           CASE WHEN game_time IS NOT NULL THEN game_date::TIMESTAMP + to_hours(
               CASE WHEN game_time LIKE '11%' THEN 11 WHEN game_time LIKE '12%' THEN 12
                    ELSE substr(game_time, 1, 1)::INTEGER + 12 END) END AS starts_at FROM schedule""", "schedule"))
def _(s, d):
    return ad.schedule(s, d).select("season", "team_id", "game_date", "opponent",
                                    clean.parse_clock_time("game_date", "game_time").alias("starts_at"))


@query("minutes_ago", """
    SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) // 60000000 AS minutes FROM events""")
def _(s, d):
    return ad.table(s, d, "events", "event_id", "ts").select(
        "event_id", clean.minutes_ago("ts", ad.ntz("2024-02-01 00:00:00")).alias("minutes"))


@query("int_prefix", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS parsed FROM part""")
def _(s, d):
    label = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(text(" ", F.col("p_size"), "x"))
    return ad.table(s, d, "part", "p_partkey", "p_size").select("p_partkey", clean.int_prefix(label).alias("parsed"))
