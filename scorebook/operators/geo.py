"""Matching reports to venues by distance and to games by time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_194.9  # of latitude, on the same sphere


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _grid(radius_m: float, radii: int = 1) -> tuple[Callable[..., Column], ...]:
    """Cells at least ``radii`` times ``radius_m`` wide: the row of a latitude, the column of a longitude within a row, the number of a
    row's columns, and how many degrees of longitude ``radius_m`` is at most for a point of the row."""
    step = radius_m * 1.001 / METERS_PER_DEGREE
    high = step * radii
    row_of = lambda lat: F.floor(lat / high).cast("long")
    # Longitude step of a latitude row, from its edge nearer to the pole.
    edge = lambda row: F.greatest(F.abs(row * high), F.abs((row + 1) * high))
    # How far apart in longitude two points of the row can be, and so how many cells it has.
    reach = lambda row: F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(step))) / F.cos(F.radians(edge(row))), F.lit(1.0))))
    count = lambda row: F.when(edge(row) + step > 89, F.lit(1)).otherwise(F.greatest(F.floor(360 / (reach(row) * radii)), F.lit(1))).cast("long")
    col_of = lambda lon, row: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * count(row)).cast("long"), count(row) - 1)
    return row_of, col_of, count, reach


def cell(lat: str, lon: str, radius_m: float = 500.0) -> Column:
    """The wide cell of a point, as ``_row`` and ``_col``: one of ``cells_near`` of every point within ``radius_m``."""
    row_of, col_of, _, _ = _grid(radius_m, 2)
    row = row_of(F.col(lat))
    return F.named_struct(F.lit("_row"), row, F.lit("_col"), col_of(F.col(lon), row))


def cells_near(lat: str, lon: str, radius_m: float = 500.0) -> Column:
    """The wide cells, four at most, that hold all points within ``radius_m`` of a point."""
    row_of, col_of, _, reach = _grid(radius_m, 2)
    step = F.lit(radius_m * 1.001 / METERS_PER_DEGREE)
    rows = F.array_distinct(F.array(row_of(F.col(lat) - step), row_of(F.col(lat) + step)))
    return F.flatten(F.transform(rows, lambda row: F.transform(
        F.array_distinct(F.array(col_of(F.col(lon) - reach(row), row), col_of(F.col(lon) + reach(row), row))),
        lambda col: F.named_struct(F.lit("_row"), row, F.lit("_col"), col))))


def geofence(reports: DataFrame, venues: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """Report-venue pairs within ``radius_m``, with ``distance_m``.

    Both sides get a grid cell at least ``radius_m`` wide; each venue is listed
    in its cell and the neighbours (the small side is copied, not the reports),
    so the join is on equal cells and tests only nearby pairs. Longitude cells
    are counted within the latitude row, around the whole circle: their number
    falls towards the poles, where a row is one cell, and the last one
    neighbours the first.
    """
    row_of, col_of, count, _ = _grid(radius_m)
    r = reports.withColumn("_row", row_of(F.col("lat"))).withColumn("_col", col_of(F.col("lon"), F.col("_row")))
    v = (
        venues.select("venue_id", F.col("lat").alias("_vlat"), F.col("lon").alias("_vlon"))
        .select("*", F.explode(F.sequence(row_of(F.col("_vlat")) - 1, row_of(F.col("_vlat")) + 1)).alias("_row"))
        .select("*", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(
            col_of(F.col("_vlon"), F.col("_row")) + i, count(F.col("_row")))))).alias("_col")))
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("_vlat"), F.col("_vlon"))
    return (
        r.join(v, ["_row", "_col"]).withColumn("distance_m", distance)
        .filter(F.col("distance_m") <= radius_m)
        .drop("_row", "_col", "_vlat", "_vlon"))


def game_window(reports: DataFrame, games: DataFrame, before_minutes: int = 30,
                after_minutes: int = 180, ts: str = "ts", start_ts: str = "start_ts") -> DataFrame:
    """Reports at a venue while one of its games may be running.

    ``games`` holds ``game_id, venue_id, start_ts``. Time is cut into buckets of
    the window's length; a game is listed in the two or so buckets its window
    touches and reports join on equal venue and bucket. Two streams are joined
    by their event times, ``ts`` and ``start_ts``, which then have watermarks.
    """
    span = (before_minutes + after_minutes) * 60
    seconds = lambda ts: F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000)
    bucket = lambda s: F.floor(s / span).cast("long")
    start = seconds(start_ts)
    g = games.select(
        F.col("game_id").alias("matched_game_id"), "venue_id", *dict.fromkeys(["start_ts", start_ts]),
        F.explode(F.sequence(bucket(start - before_minutes * 60), bucket(start + after_minutes * 60))).alias("_b"))
    opens = F.col(start_ts) - F.make_dt_interval(mins=F.lit(before_minutes))
    closes = F.col(start_ts) + F.make_dt_interval(mins=F.lit(after_minutes))
    return (
        reports.withColumn("_b", bucket(seconds(ts))).join(g, ["venue_id", "_b"])
        .filter(F.col(ts).between(opens, closes)).drop("_b"))
