"""Live score reports: batch forms and their streaming twins.

Event time is the report's ``ts``; "last" means the greatest ``(ts, event_id)``,
so results do not depend on arrival order. The streaming forms write through ``foreachBatch`` with the batch id in the path or
key, so a replayed micro-batch changes nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from scorebook.functions.ordered import null_safe_join, previous_value
from scorebook.operators.geo import cell, cells_near, game_window, geofence, haversine_m
from scorebook.operators.resolve import active_only
from scorebook.session import durable, ship_package
from scorebook.sources.sinks import dual_write

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Whole numbers and flags keep their nulls in pandas.
_NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
             pa.bool_(): pd.BooleanDtype()}


def _latest() -> Column:
    row = F.struct("home_score", "away_score", "game_state", "reporter_id", F.col("ts").alias("last_updated_at"),
                   "event_id")
    return F.max_by(row, F.struct("ts", "event_id")).alias("_l")


def live_upsert(reports: DataFrame) -> DataFrame:
    """Latest report per game: last write wins. Works on streams in update mode."""
    return reports.groupBy("game_id").agg(_latest()).select("game_id", "_l.*")


def merge_live(live: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold a micro-batch into the stored live rows; older reports change nothing."""
    return (
        live.unionByName(live_upsert(batch))
        .groupBy("game_id").agg(F.max_by(F.struct(*[c for c in live.columns if c != "game_id"]),
                                         F.struct("last_updated_at", "event_id")).alias("_l"))
        .select("game_id", "_l.*").select(*live.columns))


# --- rate limit ------------------------------------------------------------------

def _chain_ends(ts: np.ndarray, gap: int) -> np.ndarray:
    """Where a chain that accepts row i of a sorted chunk ends (pointer jumping)."""
    own = np.arange(len(ts))
    nxt = np.searchsorted(ts, ts + gap, side="left")
    ends = np.where(nxt < len(ts), nxt, own)
    while not np.array_equal(further := ends[ends], ends):
        ends = further
    return ends


def _first_in_gap(keys: list[str], gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Accepted rows of batches that are sorted by key and ``_us``; a key may go on in the next batch."""
    def same(left: pa.RecordBatch, right: pa.RecordBatch) -> np.ndarray:
        out = np.ones(left.num_rows, dtype=bool)
        for a, b in zip(left.columns, right.columns):
            out &= pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (
                pc.is_null(a, nan_is_null=True).to_numpy(zero_copy_only=False) & pc.is_null(b, nan_is_null=True).to_numpy(zero_copy_only=False))
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None  # the key of the last row, and the time last accepted of it
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            key, us = batch.select(keys), batch.column("_us").to_pylist()
            ends = [*(np.flatnonzero(~same(key.slice(1), key.slice(0, rows - 1))) + 1).tolist(), rows]
            at = bisect_left(us, last + gap, 0, ends[0]) if before is not None and same(before, key.slice(0, 1))[0] else 0
            taken = []
            for end in ends:
                while at < end:
                    taken.append(at)
                    last = us[at]
                    at = bisect_left(us, last + gap, at + 1, end)
            before = key.slice(rows - 1)
            yield batch.take(pa.array(taken, pa.int64())).select([*keys, "event_id"])

    return walk


def rate_limit(reports: DataFrame, seconds: int = 30, keys: tuple[str, ...] = ("reporter_id", "game_id"),
               rows_per_chunk: int = 500_000) -> DataFrame:
    """Reports accepted at most once per key and ``seconds``.

    The distance is measured from the last *accepted* report, which makes each
    key a sequence. Sorted by key and time, keys are walked through many at once.
    A key with more than about ``rows_per_chunk`` reports is cut into time chunks
    instead: every chunk finds on its own where a chain entering at any point would end; per key only those few end points are chained; then every
    chunk marks its accepted rows. So a key with most of the reports is still
    worked on in parallel, and the result is exact. A null key is a key of its own;
    reports without a time have no place in the order and are left out.
    """
    ship_package(reports.sparkSession)
    keys = list(keys)
    gap = seconds * 1_000_000
    lean = reports.select(*keys, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    lean = lean.filter("_us IS NOT NULL")
    id_schema = T.StructType([*[lean.schema[k] for k in keys], lean.schema["event_id"]])
    # Chunk length per large key: its time span over the number of chunks it needs. There are at most rows / rows_per_chunk such keys.
    size = durable(lean.groupBy(*keys).agg(
        F.min("_us").alias("_lo"),
        F.ceil((F.max("_us") - F.min("_us") + 1) / F.ceil(F.count("*") / rows_per_chunk)).alias("_len"),
        F.count("*").alias("_n")).filter(F.col("_n") > rows_per_chunk).drop("_n"))
    large = not size.isEmpty()
    rest = null_safe_join(lean, F.broadcast(size.select(*keys)), keys, "left_anti") if large else lean
    walked = rest.repartition(*keys).sortWithinPartitions(*keys, "_us", "event_id").mapInArrow(_first_in_gap(keys, gap), id_schema)
    if not large:
        return null_safe_join(reports, walked, [*keys, "event_id"], "left_semi")
    lean = null_safe_join(lean, F.broadcast(size), keys).select(
        *keys, "event_id", "_us", F.floor((F.col("_us") - F.col("_lo")) / F.greatest("_len", F.lit(gap))).alias("_chunk"))
    key_fields = [lean.schema[k] for k in keys]
    part = [*keys, "_chunk"]

    def chain_map(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.unique(pdf["_us"].to_numpy())
        ends = _chain_ends(ts, gap)
        # Entering at or before `enter` leads to `leave`; equal ends are merged,
        # and only entries an outside chain can reach are kept.
        reach = min(len(ts), int(np.searchsorted(ts, ts[0] + gap, side="right")) + 1)
        leave = ts[ends[:reach]]
        last_of_run = np.append(leave[1:] != leave[:-1], True)
        out = pd.DataFrame({"_enter": ts[:reach][last_of_run], "_leave": leave[last_of_run]})
        for c in reversed(part):
            out.insert(0, c, pdf[c].iloc[0])
        out["_first"], out["_end"] = ts[0], ts[-1]
        return out

    long = T.LongType()
    map_schema = T.StructType([*key_fields, *[T.StructField(c, long) for c in
                                              ("_chunk", "_enter", "_leave", "_first", "_end")]])
    maps = lean.groupBy(*part).applyInPandas(chain_map, map_schema)

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], None
        for number, group in pdf.sort_values(["_chunk", "_enter"]).groupby("_chunk", sort=True):
            entry = None if last is None else last + gap
            rows.append((number, entry))
            enter, leave = group["_enter"].to_numpy(), group["_leave"].to_numpy()
            if entry is None or entry <= group["_first"].iloc[0]:
                last = int(leave[0])
            elif entry <= group["_end"].iloc[0]:
                last = int(leave[np.searchsorted(enter, entry, side="left")])
        out = pd.DataFrame(rows, columns=["_chunk", "_entry"]).astype({"_entry": "Int64"})
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    entry_schema = T.StructType([*key_fields, T.StructField("_chunk", long), T.StructField("_entry", long)])
    entries = maps.groupBy(*keys).applyInPandas(connect, entry_schema)

    def accept(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf = left.sort_values(["_us", "event_id"])
        ts = pdf["_us"].to_numpy()
        entry = right["_entry"].iloc[0]
        i = 0 if pd.isna(entry) else int(np.searchsorted(ts, int(entry), side="left"))
        taken = []
        while i < len(ts):
            taken.append(i)
            i = int(np.searchsorted(ts, ts[i] + gap, side="left"))
        return pdf.iloc[taken][[*keys, "event_id"]]

    accepted = lean.groupBy(*part).cogroup(entries.groupBy(*part)).applyInPandas(accept, id_schema)
    return null_safe_join(reports, walked.unionByName(accepted), [*keys, "event_id"], "left_semi")


def state_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep state in RocksDB, which timers and map state need; ``spark`` stays as it is."""
    beside = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        beside.conf.set(name, spark.conf.get(name))
    beside.conf.set(STATE_STORE, ROCKSDB)
    return beside


class _InOrder(StatefulProcessor):
    """Reports of one key wait in slots of time; a timer at a slot's end hands them on in order.

    A micro-batch adds one Arrow piece for each slot that it brings rows of and reads none of the rows that wait, so its cost is that
    of its own rows however many wait. A slot is read once, when the watermark has passed its end, and removed.
    """

    def __init__(self, reports: T.StructType, out: T.StructType, memory: T.StructType, slot_ms: int, decide: Callable, needed_until: Callable):
        self.reports, self.out, self.memory_schema, self.slot_ms = reports, out, memory, slot_ms
        self.decide, self.needed_until = decide, needed_until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", self.memory_schema)
        self.pieces = handle.getMapState("pieces", "slot long", "n long")
        self.waiting = handle.getMapState("waiting", "slot long, piece long", "data binary")
        self.arrow = to_arrow_schema(self.reports)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            slots = pdf["ts"].to_numpy().astype("datetime64[ms]").astype("int64") // self.slot_ms
            for slot, part in pdf[self.reports.names].groupby(slots, sort=False):
                slot = int(slot)
                there = self.pieces.getValue((slot,))
                n = there[0] if there else 0
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, self.arrow) as writer:
                    writer.write_table(pa.Table.from_pandas(part, self.arrow, preserve_index=False))
                self.waiting.updateValue((slot, n), (sink.getvalue().to_pybytes(),))
                self.pieces.updateValue((slot,), (n + 1,))
                if not n:
                    self.handle.registerTimer((slot + 1) * self.slot_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers of a key fire in order of time; all are set at ends of slots.
        end = expiredTimerInfo.getExpiryTimeInMs()
        slot = end // self.slot_ms - 1
        kept, there = self.memory.get(), self.pieces.getValue((slot,))
        kept = None if kept is None else tuple(kept)
        if there:
            ready = []
            for piece in range(there[0]):
                table = pa.ipc.open_stream(self.waiting.getValue((slot, piece))[0]).read_all()
                ready += zip(*(table.column(c).to_pylist() for c in self.reports.names))
                self.waiting.removeKey((slot, piece))
            self.pieces.removeKey((slot,))
            at, ident = self.reports.names.index("ts"), self.reports.names.index("event_id")
            ready.sort(key=lambda row: (row[at], row[ident]))
            until = None if kept is None else self.needed_until(kept)
            if until is not None and until <= ready[0][at]:
                kept = None
            rows, kept = self.decide(ready, kept)
            if kept is not None:
                self.memory.update(kept)
                until = self.needed_until(kept)
                if until is not None:
                    self.handle.registerTimer(self._slot_end(until))
            if rows:
                yield pa.Table.from_pylist([dict(zip(self.out.names, row)) for row in rows], to_arrow_schema(self.out)).to_pandas(
                    types_mapper=_NULLABLE.get)
        until = None if kept is None else self.needed_until(kept)
        if until is not None and self._slot_end(until) <= end:
            self.memory.clear()

    def _slot_end(self, moment: datetime) -> int:
        ms = int((moment - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
        return (ms // self.slot_ms + 1) * self.slot_ms

    def close(self) -> None:
        pass


def _decided_in_order(reports: DataFrame, keys: list[str], lateness: str, slot: str, out: T.StructType, memory: T.StructType,
                      decide: Callable[[list[tuple], tuple | None], tuple[list[tuple], tuple | None]],
                      needed_until: Callable[[tuple], datetime | None]) -> DataFrame:
    """Decide each key's reports in ``(ts, event_id)`` order on a stream.

    Reports wait in state until the watermark passes the end of their ``slot`` of time, so the order of arrival within ``lateness``
    is irrelevant. ``decide`` gets the reports that are ready and what the key remembers, and gives rows and the new memory, which
    later reports no longer see once they reach ``needed_until`` (None: never); it leaves the state when the watermark gets there.
    Reports without a time have no place in any order and are left out.
    """
    spark = reports.sparkSession
    if spark.conf.get(STATE_STORE) != ROCKSDB:
        raise RuntimeError(f"set {STATE_STORE} to {ROCKSDB}, or read the stream in state_session(spark)")
    ship_package(spark)
    slot_ms = int(pd.Timedelta(slot) / pd.Timedelta(milliseconds=1))
    if slot_ms < 1:
        raise ValueError("a slot lasts at least one millisecond")
    # Watermarks need a zoned timestamp; the values stay as they are.
    zoned = reports.filter("ts IS NOT NULL").withColumn("_et", F.col("ts").cast("timestamp")).withWatermark("_et", lateness)
    processor = _InOrder(reports.schema, out, memory, slot_ms, decide, needed_until)
    return zoned.groupBy(*keys).transformWithStateInPandas(processor, out, "append", "eventTime")


def rate_limit_stream(reports: DataFrame, seconds: int = 30, keys: tuple[str, ...] = ("reporter_id", "game_id"),
                      lateness: str = "3 hours", slot: str = "1 minute") -> DataFrame:
    """The same rule on a stream. A key is forgotten when a new report would be accepted anyway."""
    gap = timedelta(seconds=seconds)
    at = reports.columns.index("ts")

    def decide(ready: list[tuple], kept: tuple | None) -> tuple[list[tuple], tuple | None]:
        last = None if kept is None else kept[0]
        taken = []
        for row in ready:
            if last is None or row[at] >= last + gap:
                taken.append(row)
                last = row[at]
        return taken, (last,)

    memory = T.StructType([T.StructField("last", T.TimestampNTZType())])
    return _decided_in_order(reports, list(keys), lateness, slot, T.StructType(reports.schema.fields), memory, decide,
                             lambda kept: kept[0] + gap)


# --- finalization, transitions, notifications -------------------------------------

def finished(games: DataFrame, live: DataFrame) -> DataFrame:
    """The games that a final live row completes, with its scores; no other games."""
    done = live.filter(F.col("game_state") == "final").select("game_id", F.col("home_score").alias("_h"), F.col("away_score").alias("_a"))
    return (games.join(done, "game_id")
            .withColumns({"home_score": F.col("_h"), "away_score": F.col("_a"), "status": F.lit("completed")})
            .select(*games.columns))


def finalize(games: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games with the scores of finished live rows, and the live rows that remain."""
    done = live.filter(F.col("game_state") == "final").select(
        "game_id", F.col("home_score").alias("_h"), F.col("away_score").alias("_a"), F.lit(True).alias("_done"))
    over = F.col("_done").isNotNull()
    merged = (
        games.join(done, "game_id", "left")
        .withColumns({
            "home_score": F.when(over, F.col("_h")).otherwise(F.col("home_score")),
            "away_score": F.when(over, F.col("_a")).otherwise(F.col("away_score")),
            "status": F.when(over, F.lit("completed")).otherwise(F.col("status"))})
        .select(*games.columns))
    return merged, live.filter(F.col("game_state") != "final")


def transitions(reports: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Reports that change their game's state, or say final."""
    chunk = F.date_trunc("hour", F.col("ts")) if chunk is None else chunk
    seen = previous_value(reports, F.col("game_state"), ["game_id"], ["ts", "event_id"], chunk, "previous_state")
    changed = F.col("previous_state").isNull() | (F.col("previous_state") != F.col("game_state"))
    return seen.filter(changed | (F.col("game_state") == "final"))


def transitions_stream(reports: DataFrame, lateness: str = "3 hours", after_final: str = "1 day", slot: str = "1 minute") -> DataFrame:
    """State changes on a stream, the same rows as ``transitions`` whatever the order of arrival within ``lateness``.

    A game is forgotten ``after_final`` its last report, if that was a final one: later reports begin anew. The rule is applied at the
    start of each ``slot``, the shorter of the two.
    """
    at, state_at = reports.columns.index("ts"), reports.columns.index("game_state")
    rest = pd.Timedelta(after_final).to_pytimedelta()

    def decide(ready: list[tuple], kept: tuple | None) -> tuple[list[tuple], tuple | None]:
        before = None if kept is None else kept[1]
        rows = []
        for row in ready:
            # As in SQL, a report without a state is no change from a known one.
            if before is None or row[state_at] is not None and (row[state_at] != before or row[state_at] == "final"):
                rows.append((*row, before))
            before = row[state_at]
        return rows, (ready[-1][at], before)

    memory = T.StructType([T.StructField("last", T.TimestampNTZType()), T.StructField("game_state", T.StringType())])
    out = T.StructType([*reports.schema.fields, T.StructField("previous_state", T.StringType())])
    return _decided_in_order(reports, ["game_id"], lateness, slot, out, memory, decide,
                             lambda kept: kept[0] + rest if kept[1] == "final" else None)


def notifications(changes: DataFrame, games: DataFrame, followers: DataFrame) -> DataFrame:
    """One line per state change and user following either team.

    A user who follows both teams is told once: recipients are settled per game,
    which is far fewer rows than per state change.
    """
    active = games.join(changes.select("game_id").distinct(), "game_id", "left_semi")
    recipients = (
        active.select("game_id", F.explode(F.array_distinct(F.array("home_team_id", "away_team_id"))).alias("team_id"))
        .join(followers.select("team_id", "user_id"), "team_id").select("game_id", "user_id").distinct())
    return changes.select("event_id", "game_id", "ts", "game_state").join(recipients, "game_id")


def eligible(reports: DataFrame, venues: DataFrame, games: DataFrame, reporters: DataFrame) -> DataFrame:
    """Reports by an active reporter, at a venue, during one of its games.

    All three sides are static tables, so the same plan runs on a stream. A
    report near two venues or games is kept once per match.
    """
    return game_window(geofence(active_only(reports, reporters), venues), games)


def eligible_stream(reports: DataFrame, venues: DataFrame, games: DataFrame, reporters: DataFrame, lateness: str = "3 hours",
                    games_lateness: str | None = None) -> DataFrame:
    """``eligible`` where games are a stream as well: a game may arrive before or after the reports on it.

    Both sides wait in state under a cell of the map and a time bucket, so a place with most of the reports is spread over its buckets. A
    report is listed in the few cells that its surroundings touch, a game in the cell of its venue, and rows that a micro-batch brings for
    one cell and bucket wait as one list: the state grows with the rows that arrive, not with pairs of reports and venues. Reports wait
    until the games' watermark says that no game around their time can still come, games until the reports' watermark has passed their
    windows; both then leave the state. ``lateness`` is how far behind the newest row of its stream a row may arrive (``games_lateness``
    for games, if it differs): rows beyond it may be dropped. Reports without a time or place and games without a start match nothing.
    """
    ship_package(reports.sparkSession)
    before, after = 30, 180
    # Buckets are twice as long as a game's window, so that every second game is in one bucket only.
    span = 2 * (before + after)
    bucket = lambda us: F.floor(us / F.lit(span * 60_000_000)).cast("long")
    minutes = lambda n: F.make_dt_interval(mins=F.lit(n))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    seen = active_only(reports.filter("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL"), reporters)
    near = seen.select(
        F.explode(cells_near("lat", "lon")).alias("_c"), bucket(micros("ts")).alias("_b"), micros("ts").alias("_us"), F.struct(*seen.columns).alias("_row_"))
    known = games.filter("start_ts IS NOT NULL").select("game_id", "venue_id", "start_ts").join(
        venues.select("venue_id", F.col("lat").alias("_vlat"), F.col("lon").alias("_vlon")), "venue_id")
    start, minute = micros("start_ts"), 60_000_000
    known = known.select(
        cell("_vlat", "_vlon").alias("_c"), F.explode(F.sequence(bucket(start - before * minute), bucket(start + after * minute))).alias("_b"),
        start.alias("_us"), F.struct("venue_id", "game_id", "start_ts", "_vlat", "_vlon").alias("_row_"))

    def listed(rows: DataFrame, event_time: str, last: bool, late: str) -> DataFrame:
        """Lists of rows with one cell and bucket; their event time is that of the first or last of them."""
        rows = rows.filter("_c._row IS NOT NULL AND _c._col IS NOT NULL").select("_c.*", "_b", "_us", "_row_").repartition("_row", "_col", "_b")
        key = [rows.schema[c] for c in ("_row", "_col", "_b")]
        schema = T.StructType([*key, T.StructField("_us", T.LongType()), T.StructField("_rows", T.ArrayType(rows.schema["_row_"].dataType))])
        lists = rows.mapInArrow(_lists_by_key([f.name for f in key], last), schema)
        # A list's other rows are less than a bucket away. Watermarks need a zoned timestamp.
        return lists.select(*[F.col(f.name).alias(f"{event_time}{f.name}") for f in key], F.timestamp_micros("_us").alias(event_time),
                            F.col("_rows").alias(f"{event_time}_rows")).withWatermark(event_time, f"{late} {span} minutes")

    left, right = listed(near, "_rt", True, lateness), listed(known, "_gt", False, games_lateness or lateness)
    same = [F.col(f"_rt{c}") == F.col(f"_gt{c}") for c in ("_row", "_col", "_b")]
    close = (F.col("_rt") >= F.col("_gt") - minutes(before)) & (F.col("_rt") <= F.col("_gt") + minutes(after + 2 * span))
    met = left.join(right, [*same, close]).select(F.explode("_rt_rows").alias("_r"), "_gt_rows").select("_r", F.explode("_gt_rows").alias("_g"))
    at, starts = F.col("_r.ts").cast("timestamp"), F.col("_g.start_ts").cast("timestamp")
    distance = haversine_m(F.col("_r.lat"), F.col("_r.lon"), F.col("_g._vlat"), F.col("_g._vlon"))
    return (
        met.filter(at.between(starts - minutes(before), starts + minutes(after)))
        .select("_r", "_g", distance.alias("distance_m")).filter(F.col("distance_m") <= 500.0)
        .select("_g.venue_id", *[F.col("_r")[c].alias(c) for c in seen.columns], "distance_m", F.col("_g.game_id").alias("matched_game_id"), "_g.start_ts"))


#: Rows of one list, and rows of a task that are sorted into lists at a time.
ROWS_PER_LIST, ROWS_PER_SORT = 1_000, 1_000_000


def _lists_by_key(keys: list[str], last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, ``_us``, ``_row_``) to lists of rows with one key, with the first or last ``_us``."""
    def pack(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(pieces)
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (*keys, "_us")])).combine_chunks()
        n = table.num_rows
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for c in keys:
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        first = np.flatnonzero(new)
        # Long lists are cut.
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        first = np.flatnonzero(place % ROWS_PER_LIST == 0)
        ends = np.append(first[1:], n)
        head = table.take(pa.array(first))
        us = table.column("_us").take(pa.array(ends - 1 if last else first))
        items = table.column("_row_").combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), items.chunk(0) if isinstance(items, pa.ChunkedArray) else items)
        out = pa.table([*[head.column(c) for c in keys], us, lists], names=[*keys, "_us", "_rows"])
        yield from out.to_batches(max_chunksize=256)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                pieces.append(batch)
                rows += batch.num_rows
            if rows >= ROWS_PER_SORT:
                yield from pack(pieces)
                pieces, rows = [], 0
        if pieces:
            yield from pack(pieces)

    return walk


def live_at(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Live rows as the ``live_upsert`` stream with this checkpoint held them after ``batch_id`` (None: the last one).

    Read from the stream's own state, while it runs or later, so no second copy is kept. Spark keeps the state of the last
    ``spark.sql.streaming.minBatchesToRetain`` batches; an older one raises.
    """
    reader = spark.read.format("statestore")
    stored = (reader if batch_id is None else reader.option("batchId", batch_id)).load(checkpoint)
    # The state's first value is the latest report; its second is the order it was chosen by.
    latest = stored.schema["value"].dataType.fieldNames()[0]
    return stored.select("key.game_id", F.col("value")[latest].alias("_l")).select("game_id", "_l.*")


# --- stream writers ----------------------------------------------------------------

def finalize_stream(reports: DataFrame, load_games: Callable[[], DataFrame], load_live: Callable[[], DataFrame],
                    save: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Per micro-batch: fold reports into the live rows, move finished games over.

    ``save(completed, live, batch_id)`` gets the games that the batch completes, and no
    others, to be upserted by game, and the live rows that remain. It must replace what the
    same ``batch_id`` wrote before; ``load_live`` must read the state before that batch.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        merged = merge_live(load_live(), batch)
        save(finished(load_games(), merged), merged.filter(F.col("game_state") != "final"), batch_id)

    return (reports.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dual_write_stream(reports: DataFrame, writers: Iterable[Callable[[DataFrame, int], None]], checkpoint: str):
    """Give every micro-batch to all writers; the batch counts only if all succeed.

    A batch that failed half way runs again with the same ``batch_id``, so
    writers must be idempotent per id.
    """
    writers = list(writers)

    def apply(batch: DataFrame, batch_id: int) -> None:
        dual_write(batch, [lambda df, write=write: write(df, batch_id) for write in writers])

    return (reports.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def batch_folder_writer(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Writer that owns one folder per batch id and overwrites it on replay."""
    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write
