from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scorebook.functions import clean


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    ("W 11-7", ("W", 11, 7, False)), ("L 4-5 OT", ("L", 4, 5, True)), ("w 3-2", ("W", 3, 2, False)),
    ("", (None, None, None, False)), (None, (None, None, None, False)), ("T 5-5", (None, None, None, False)),
    ("not played", (None, None, None, True)), (" W  11-7 ", ("W", 11, 7, False)), ("W11-7", (None, None, None, False)),
])
def test_parse_result(spark, text, expected):
    assert tuple(one(spark, clean.parse_result("x"), text)) == expected


def test_strict_overtime(spark):
    assert one(spark, clean.parse_result("x", strict=True), "not played")["is_ot"] is False
    assert one(spark, clean.parse_result("x", strict=True), "L 4-5 ot")["is_ot"] is True


@pytest.mark.parametrize("text,expected", [("21st", 21), ("3rd", 3), ("TBD", None), ("2/3", 23), ("0", None)])
def test_parse_day_ordinal(spark, text, expected):
    assert one(spark, clean.parse_day_ordinal("x"), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Monday, Mar 16th", date(2026, 3, 16)), ("Thu Apr 17th", date(2026, 4, 17)), ("Mo 16th", None), ("Foo 3", None),
    ("Feb 30", None), (None, None), ("sept. 9", date(2026, 9, 9))])
def test_parse_month_day(spark, text, expected):
    # "Monday, Mar" has no number after "Monday", so the month decides.
    assert one(spark, clean.parse_month_day("x", 2026), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Central Catholic 10 @ Skyview 6", (10, 6)), ("Team A 7:00pm @ Team B", (None, None)), ("A 3 @ 7:00 B 4", (3, None)),
    ("A @ B", (None, None)), ("no game", (None, None)), ("A 1 @ B 2 @ C 3", (1, 2))])
def test_parse_scoreline(spark, text, expected):
    assert tuple(one(spark, clean.parse_scoreline("x"), text)) == expected


@pytest.mark.parametrize("text,expected", [("5-0", (5, 0)), ("x", (0, 0)), ("7", (7, 0)), ("10-2-1", (10, 2)), ("", (0, 0))])
def test_parse_record(spark, text, expected):
    assert tuple(one(spark, clean.parse_record("x"), text)) == expected


@pytest.mark.parametrize("text,expected", [("7x", 7), (" -3", -3), ("x7", None), ("", None)])
def test_int_prefix(spark, text, expected):
    assert one(spark, clean.int_prefix("x"), text) == expected


def test_whitespace_is_more_than_blanks(spark):
    assert one(spark, clean.collapse_whitespace("x"), "\t a  \n b 　") == "a b"
    assert one(spark, clean.normalize_name("x"), "  Mt. View ") == "mt. view"
    assert one(spark, clean.normalize_name("x"), "\tA ") == "\ta"  # keys trim blanks only


@pytest.mark.parametrize("text,expected", [
    ("4:30pm", datetime(2026, 3, 1, 16, 30)), ("12:00am", datetime(2026, 3, 1, 0, 0)), ("12:15pm", datetime(2026, 3, 1, 12, 15)),
    ("TBD", None), ("13:00pm", None), (None, None)])
def test_parse_clock_time(spark, text, expected):
    assert one(spark, clean.parse_clock_time(F.lit("2026-03-01").cast("date"), "x"), text) == expected


def test_pairs_and_differences_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    low, high = clean.ordered_pair("a", "b")
    row = df.select(low.alias("l"), high.alias("h"), clean.cap_abs_diff("a", "b").alias("d")).first()
    assert tuple(row) == (None, None, None)
    df = spark.createDataFrame([(0, 12)], "a int, b int")
    row = df.select(clean.cap_abs_diff("a", "b").alias("u"), clean.cap_abs_diff("a", "b", signed=True).alias("s")).first()
    assert tuple(row) == (10, -10)


def test_completed_needs_both_scores(spark):
    df = spark.createDataFrame([(1, 2), (3, None), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(clean.completed_status("a", "b")).collect()] == ["completed", "scheduled", "scheduled"]
