"""Cleaning expressions: Column in, Column out, all inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: whitespace class of the source texts (ASCII blanks, no-break
# --- and other Unicode spaces), month names, and the text formats read here.
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
MONTH_ABBREVIATIONS = [
    "jan", "feb", "mar", "apr", "may", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec",
]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
MONTH_DAY = r"([A-Za-z]{3})[a-z]*\.?\s+(\d+)"
CLOCK = r"\d+:\d+"
TRAILING_NUMBER = r"(\d+)\s*$"
FIRST_NUMBER = r"^.*?(\d+)"
RESULT = r"^([WLwl])\s+(\d+)-(\d+)"
RESULT_ANYWHERE = r"(?i)[WL]\s*(\d+)-(\d+)"
OVERTIME = r"(?i)OT"
AWAY_MARK = r"^@\s*"
# --- End of fixed values.


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _position(col: Column, words: list[str]) -> Column:
    """1-based position of a word in a fixed list, null when absent."""
    pairs = [F.lit(x) for i, word in enumerate(words, start=1) for x in (word, i)]
    return F.element_at(F.create_map(*pairs), col)


def strip_space(col: Column | str) -> Column:
    """Trim every kind of whitespace (plain ``trim`` removes spaces only).

    Characters are looked at from both ends only; a regex would test each one inside.
    """
    return F.btrim(_c(col).cast("string"), F.lit(BLANKS))


def collapse_whitespace(col: Column | str) -> Column:
    # The range in front turns most characters away before the long class is tried.
    return strip_space(F.regexp_replace(_c(col), f"(?:(?![!-~]){WS})+", " "))


def normalize_name(col: Column | str) -> Column:
    """Canonical join key of a name."""
    return F.lower(F.trim(_c(col)))


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(_c(col), F.lit(""))


def default_if_null(col: Column | str, value: object) -> Column:
    return F.coalesce(_c(col), F.lit(value))


def int_prefix(col: Column | str) -> Column:
    """Leading integer of a text (``"7x"`` is 7), null when there is none."""
    return F.regexp_extract(_c(col), rf"^{WS}*([+-]?\d+)", 1).try_cast("int")


def float_prefix(col: Column | str) -> Column:
    """Leading decimal number of a text, null when there is none."""
    pattern = rf"^{WS}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.regexp_extract(_c(col), pattern, 1).try_cast("double")


def month_number(col: Column | str) -> Column:
    """1..12 for a text that is exactly a full month name, else null."""
    # No name holds a blank, so blanks inside need no collapsing.
    return _position(F.lower(strip_space(col)), MONTH_NAMES)


def parse_month_day(col: Column | str, season: Column | int) -> Column:
    """``"Monday, Mar 16th"`` to a date of the season year.

    The first word-of-three-letters-or-more followed by a number decides; an
    unknown month, or a day the month does not have, gives null.
    """
    year = season if isinstance(season, Column) else F.lit(season)
    month = _position(F.lower(F.regexp_extract(_c(col), MONTH_DAY, 1)), MONTH_ABBREVIATIONS)
    day = F.regexp_extract(_c(col), MONTH_DAY, 2).try_cast("int")
    return season_date(year, month, day)


def season_date(year: Column, month: Column, day: Column) -> Column:
    """Date from parts; null when any part is null or the day does not exist."""
    text = F.concat(year.cast("string"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string"))
    return F.try_to_date(text, "y-M-d")


def parse_day_ordinal(col: Column | str) -> Column:
    """``"21st"`` to 21 by dropping every non-digit; none or zero gives null."""
    return F.nullif(F.regexp_replace(_c(col), r"\D", "").try_cast("int"), F.lit(0))


def parse_scoreline(col: Column | str) -> Column:
    """``"Away 10 @ Home 6"`` to ``struct(away_score, home_score)``.

    A clock time before the ``@`` voids both scores, one right after it voids
    the home score.
    """
    text = _c(col)
    at = F.instr(text, "@")
    away_side = strip_space(F.substring(text, F.lit(1), at - 1))
    home_side = strip_space(F.substring(text, at + 1, F.length(text)))
    away_is_clock = away_side.rlike(CLOCK)
    home_is_clock = F.regexp_extract(home_side, r"^(\S*)", 1).rlike(CLOCK)
    away = F.regexp_extract(away_side, TRAILING_NUMBER, 1).try_cast("int")
    home = F.regexp_extract(home_side, FIRST_NUMBER, 1).try_cast("int")
    usable = (at > 0) & ~away_is_clock
    return F.struct(
        F.when(usable, away).alias("away_score"),
        F.when(usable & ~home_is_clock, home).alias("home_score"),
    )


def parse_result(col: Column | str, strict: bool = False) -> Column:
    """``"L 4-5 OT"`` to ``struct(result, team_score, opp_score, is_ot)``.

    ``is_ot`` is the letters OT anywhere in the text; ``strict`` asks for the
    word OT.
    """
    text = strip_space(col)
    overtime = text.rlike(r"(?i)\bOT\b" if strict else OVERTIME)
    return F.struct(
        F.upper(blank_to_null(F.regexp_extract(text, RESULT, 1))).alias("result"),
        F.regexp_extract(text, RESULT, 2).try_cast("int").alias("team_score"),
        F.regexp_extract(text, RESULT, 3).try_cast("int").alias("opp_score"),
        F.coalesce(overtime, F.lit(False)).alias("is_ot"),
    )


def parse_result_loose(col: Column | str) -> Column:
    """Scores of the first ``W10-6`` / ``l 2-18`` anywhere in the text."""
    return F.struct(
        F.regexp_extract(_c(col), RESULT_ANYWHERE, 1).try_cast("int").alias("team_score"),
        F.regexp_extract(_c(col), RESULT_ANYWHERE, 2).try_cast("int").alias("opp_score"),
    )


def parse_record(col: Column | str) -> Column:
    """``"5-0"`` to ``struct(wins, losses)``; anything unreadable counts 0."""
    parts = F.split(_c(col), "-")
    number = lambda i: F.coalesce(strip_space(F.get(parts, i)).try_cast("int"), F.lit(0))
    return F.struct(number(0).alias("wins"), number(1).alias("losses"))


def format_record(wins: Column | str, losses: Column | str) -> Column:
    return F.concat_ws("-", _c(wins).cast("string"), _c(losses).cast("string"))


def home_away_prefix(col: Column | str) -> Column:
    """Leading ``@`` marks an away game: ``struct(is_home, opponent)``."""
    text = _c(col)
    return F.struct(
        (~F.startswith(text, F.lit("@"))).alias("is_home"),
        strip_space(F.regexp_replace(text, AWAY_MARK, "")).alias("opponent"),
    )


def round4(col: Column | str) -> Column:
    return F.round(_c(col), 4)


def store_decimal(col: Column | str, scale: int = 2) -> Column:
    """Stored precision of ratings: ``decimal(8, scale)``. A value that does not fit is an error, not a null."""
    value = _c(col)
    stored = value.try_cast(f"decimal(8,{scale})")
    misfit = F.raise_error(F.concat(value.cast("string"), F.lit(f" does not fit decimal(8,{scale})"))).cast(f"decimal(8,{scale})")
    return F.when(stored.isNotNull() | value.isNull(), stored).otherwise(misfit)


def cap_abs_diff(a: Column | str, b: Column | str, cap: int = 10, signed: bool = False) -> Column:
    """Score difference limited to ``cap``; unsigned unless asked otherwise."""
    diff = _c(a) - _c(b)
    known = diff.isNotNull()
    if signed:
        return F.when(known, F.greatest(F.lit(-cap), F.least(diff, F.lit(cap))))
    return F.when(known, F.least(F.abs(diff), F.lit(cap)))


def date_prefix(col: Column | str) -> Column:
    return F.substring(_c(col).cast("string"), 1, 10)


def is_iso_midnight(col: Column | str) -> Column:
    return _c(col).cast("string").like("%T00:00:00%")


def parse_clock_time(date: Column | str, text: Column | str) -> Column:
    """Date plus ``"4:30pm"`` as a zone-free timestamp, null when unreadable."""
    pattern = r"^(1[0-2]|0?[1-9]):([0-5]\d)\s*([ap])m$"
    clean = F.lower(strip_space(text))
    hour = F.regexp_extract(clean, pattern, 1).try_cast("int") % 12
    minute = F.regexp_extract(clean, pattern, 2).try_cast("int")
    noon = F.when(F.regexp_extract(clean, pattern, 3) == "p", 12).otherwise(0)
    return _c(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour + noon, minute)


def minutes_ago(ts: Column | str, as_of: Column) -> Column:
    return F.timestamp_diff("MINUTE", _c(ts), as_of)


def completed_status(a: Column | str, b: Column | str) -> Column:
    """Completed only when both scores are known."""
    both = _c(a).isNotNull() & _c(b).isNotNull()
    return F.when(both, F.lit("completed")).otherwise(F.lit("scheduled"))


def ordered_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Smaller and larger of two keys; both null when either is null."""
    known = _c(a).isNotNull() & _c(b).isNotNull()
    return (
        F.when(known, F.least(_c(a), _c(b))),
        F.when(known, F.greatest(_c(a), _c(b))),
    )
