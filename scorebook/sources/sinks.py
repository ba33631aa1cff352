"""Key-based merges as DataFrame functions, and the thin writers around them.

A merge returns the new content of the target, so it works with any storage;
where the target is a table format with MERGE support, ``df.mergeInto`` can run
the same rule in place.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorebook.functions.ordered import null_safe_join
from scorebook.schemas import KEYS, TABLES, UPDATE_COLUMNS
from scorebook.session import remove, scratch_path


#: Files of one partition at most, so a partition with most of the rows is written by several tasks.
PARTITION_FILES = 16
#: How often, half a second apart, the jobs of a source that ran out of time are cancelled while its thread still lives.
CANCEL_TRIES = 10


def one_per_key(df: DataFrame, keys: list[str], order: Iterable[Column]) -> DataFrame:
    """First row per key in ``order``.

    Spark limits each group before the shuffle (one row per key and map task),
    so a key with most of the rows does not land in one task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _reverse(order: list[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def _forward(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def _no_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update_cols: list[str],
           order: list[str], null_safe: bool = True,
           merge: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Insert or update by key; returns the new target.

    Later rows of the batch (by ``order``) win. On a match only ``update_cols``
    take the batch value, or ``merge[col](old, new)`` when given. With
    ``null_safe=False`` a row with a null key column never matches and is
    inserted again, as unique keys of SQL databases treat nulls.
    """
    merge = merge or {}
    columns = target.columns
    lone_target = lone_batch = None
    if not null_safe:
        lone_target, target = target.filter(~_no_null(keys)), target.filter(_no_null(keys))
        lone_batch, batch = batch.filter(~_no_null(keys)), batch.filter(_no_null(keys))
    new = one_per_key(batch, keys, _reverse(order)).select(
        *[F.col(c).alias(f"_n_{c}") for c in columns])
    def same(k: str, other: str) -> Column:
        return F.col(k).eqNullSafe(F.col(other)) if null_safe else F.col(k) == F.col(other)

    def pick(c: str) -> Column:
        hit = F.col("_hit").isNotNull()
        if c in merge:
            return F.when(hit, merge[c](F.col(c), F.col(f"_n_{c}"))).otherwise(F.col(c)).alias(c)
        return (F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) if c in update_cols else F.col(c)).alias(c)

    # The target's rows stay where they are while the batch is small enough to broadcast; of the second meeting it gives keys only.
    met = target.join(new.withColumn("_hit", F.lit(True)), [same(k, f"_n_{k}") for k in keys], "left")
    known = target.select(*[F.col(k).alias(f"_m_{k}") for k in keys])
    added = new.join(known, [same(f"_n_{k}", f"_m_{k}") for k in keys], "left_anti")
    result = met.select(*[pick(c) for c in columns]).unionByName(added.select(*[F.col(f"_n_{c}").alias(c) for c in columns]))
    if not null_safe:
        result = result.unionByName(lone_target).unionByName(lone_batch.select(*columns))
    return result


def upsert_table(name: str, target: DataFrame, batch: DataFrame, order: list[str],
                 null_safe: bool = True) -> DataFrame:
    """``upsert`` with the declared key and update list of a table."""
    return upsert(target, batch, KEYS[name], UPDATE_COLUMNS[name], order, null_safe)


def upsert_schedule(target: DataFrame, batch: DataFrame, order: list[str], null_safe: bool = True) -> DataFrame:
    """Schedule rows by team, date, opponent and time (``season`` is not updated)."""
    return upsert_table("schedule", target, batch, order, null_safe)


def upsert_partitions(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], update_cols: list[str], order: list[str],
                      partition_by: list[str], null_safe: bool = True,
                      merge: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> list[tuple]:
    """``upsert`` into the Parquet table at ``path``, which is partitioned by key columns; returns the partitions it rewrote.

    Only partitions that the batch brings are read and written again, all others keep their files. The merged rows are written
    to the shared folder first, so a failure before the last step, Spark's dynamic partition overwrite, leaves the table as it was.
    Partition values are collected: they are folders, not rows. A table that is not there yet is made.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("a row must not change its partition: partition by key columns")
    touched = [tuple(r) for r in batch.select(*partition_by).distinct().collect()]
    if not touched:
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        stored = spark.read.schema(batch.schema).parquet(path)
        # Literal partition values prune folders when the query is planned.
        here = reduce(lambda a, b: a | b, [
            reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in zip(partition_by, values)])
            for values in touched])
        target = stored.select(*batch.columns).filter(here)
    else:
        target = batch.limit(0)
    staged = scratch_path(spark, "upsert-partitions")
    upsert(target, batch, keys, update_cols, order, null_safe, merge).write.parquet(staged)
    try:
        (spark.read.schema(batch.schema).parquet(staged).repartition(*partition_by, F.pmod(F.xxhash64(*keys), F.lit(PARTITION_FILES)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
    finally:
        remove(spark, staged)
    return sorted(touched, key=str)


def replace_partition(target: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """Drop the target's rows of every partition value the batch brings, add the batch."""
    touched = batch.select(column).distinct()
    return target.join(touched, column, "left_anti").unionByName(batch.select(*target.columns))


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], target_once: bool = False) -> DataFrame:
    """Insert rows whose key is absent; the first batch row per key wins.

    Null key columns never match, so such rows are all inserted. With ``target_once`` target and batch are read once each and go through the
    join with all their columns, for those that are costly to compute and have few rows per key; otherwise the target's rows stay where
    they are and only its keys are joined.
    """
    columns = target.columns
    if target_once:
        # A filter for null keys, pushed down to where the batch comes from, would keep Spark from computing once what it shares with the target.
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*_forward(order)))
        new = batch.withColumn("_rn", place).filter((F.col("_rn") == 1) | ~_no_null(keys)).select(*[F.col(c).alias(f"_n_{c}") for c in columns])
        met = target.withColumn("_old", F.lit(True)).join(new, [F.col(k) == F.col(f"_n_{k}") for k in keys], "full")
        return met.select(*[F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c) for c in columns])
    keyed = one_per_key(batch.filter(_no_null(keys)), keys, _forward(order))
    fresh = keyed.join(target.select(*keys), keys, "left_anti")
    lone = batch.filter(~_no_null(keys))
    return target.unionByName(fresh.select(*columns)).unionByName(lone.select(*columns))


def run_counts(rows: DataFrame, source_col: str, as_of: Column, failed: Column | None = None) -> DataFrame:
    """Run-log rows from loaded rows: one per source with its row count."""
    bad = F.lit(False) if failed is None else failed
    counted = rows.groupBy(F.col(source_col).alias("source")).agg(
        F.count_if(~bad).alias("teams_scraped"), F.count_if(bad).alias("_bad"))
    return counted.select(
        "source", "teams_scraped",
        F.when(F.col("_bad") > 0, "error").otherwise("success").alias("status"),
        F.when(F.col("_bad") > 0, F.concat(F.col("_bad").cast("string"), F.lit(" unreadable rows")))
        .alias("error_message"),
        as_of.alias("scraped_at"))


def append_log(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Append-only run log."""
    return log.unionByName(entries.select(*log.columns))


def log_entry(spark: SparkSession, source: str, count: int, status: str, error: str | None,
              as_of: Column) -> DataFrame:
    return spark.range(1).select(
        F.lit(source).alias("source"), F.lit(count).cast("long").alias("teams_scraped"),
        F.lit(status).alias("status"), F.lit(error).cast("string").alias("error_message"),
        as_of.alias("scraped_at"))


def isolated_load(spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]],
                  writer: Callable[[str, DataFrame], None], as_of: Column) -> DataFrame:
    """Load each source on its own and return the run log.

    One failing source is logged with count 0 and its error; the others go on.
    The row count is observed during the write, not by a second pass.
    """
    log = spark.createDataFrame([], TABLES["run_log"])
    for source, load in loaders.items():
        try:
            seen = Observation()
            writer(source, load().observe(seen, F.count(F.lit(1)).alias("rows")))
            entry = log_entry(spark, source, seen.get["rows"], "success", None, as_of)
        except Exception as failure:  # noqa: BLE001 - any failure of a source is logged, not raised
            entry = log_entry(spark, source, 0, "error", (str(failure).splitlines() or [type(failure).__name__])[0], as_of)
        log = append_log(log, entry)
    return log


def concurrent_load(spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]], writer: Callable[[str, DataFrame], None],
                    as_of: Column, seconds: float | Mapping[str, float] | None = None) -> DataFrame:
    """``isolated_load`` with all sources under way at the same time; returns the run log in the order of ``loaders``.

    ``seconds`` limits each source, or those it names, from the common start. A source that is not done by then is logged as an
    error, its jobs are cancelled by their tag and their tasks interrupted; the other sources' jobs go on. A loader that hangs outside Spark cannot be
    stopped, but what it returns too late is not written. How the jobs share the cluster is the scheduler's (``spark.scheduler.mode``).
    A source whose write is cut off has written what its writer had committed: Spark's file writers commit at the end.
    """
    context = spark.sparkContext
    runs = {source: _Run(f"load-{uuid.uuid4().hex}") for source in loaders}

    def work(source: str, load: Callable[[], DataFrame], run: _Run) -> None:
        context.addJobTag(run.tag)
        context.setInterruptOnCancel(True)
        try:
            seen = Observation()
            df = load().observe(seen, F.count(F.lit(1)).alias("rows"))
            if not run.late.is_set():
                writer(source, df)
                run.rows = seen.get["rows"]
        except Exception as failure:  # noqa: BLE001 - any failure of a source is logged, not raised
            run.error = (str(failure).splitlines() or [type(failure).__name__])[0]
        finally:
            run.done.set()

    began = time.monotonic()
    for source, load in loaders.items():
        # Job tags belong to a thread; the target keeps the caller's own properties.
        threading.Thread(target=inheritable_thread_target(spark)(work), args=(source, load, runs[source]), daemon=True).start()
    limits = {source: seconds.get(source) if isinstance(seconds, Mapping) else seconds for source in loaders}
    entries = {}
    # The nearest limit is awaited first, so that no source outlasts its own behind another's.
    for source in sorted(loaders, key=lambda name: math.inf if limits[name] is None else limits[name]):
        run, limit = runs[source], limits[source]
        if run.done.wait(None if limit is None else max(0.0, began + limit - time.monotonic())):
            count, error = (0, run.error) if run.rows is None else (run.rows, None)
        else:
            run.late.set()
            # A job may start just as its source runs out of time.
            for _ in range(CANCEL_TRIES):
                context.cancelJobsWithTag(run.tag)
                if run.done.wait(0.5):
                    break
            count, error = 0, f"no end after {limit:g} seconds"
        entries[source] = log_entry(spark, source, count, "success" if error is None else "error", error, as_of)
    return reduce(append_log, [entries[source] for source in loaders], spark.createDataFrame([], TABLES["run_log"]))


class _Run:
    """What the thread of one source leaves for the log."""

    def __init__(self, tag: str):
        self.tag, self.rows, self.error = tag, None, None
        self.done, self.late = threading.Event(), threading.Event()


def write_log(entries: DataFrame, path: str) -> bool:
    """Append to the stored log; a failing log never fails the run."""
    try:
        entries.write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001
        return False


def split_readable(df: DataFrame, readable: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed and rows to quarantine, so one bad page skips only itself."""
    ok = F.coalesce(readable, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def snapshot_copy(df: DataFrame, name: str) -> DataFrame:
    """Keep the content of a table under a new versioned path; returns the copy."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}_v1")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def snapshot_table(spark: SparkSession, table: str, suffix: str = "_v1") -> str:
    """The same for catalog tables."""
    copy = f"{table}{suffix}"
    spark.table(table).write.mode("errorifexists").saveAsTable(copy)
    return copy


def cascade_delete(children: DataFrame, deleted: DataFrame, column: str, parent_key: str, rule: str) -> DataFrame:
    """Children after their parents in ``deleted`` are removed.

    ``cascade`` drops them, ``set_null`` clears the reference, ``restrict``
    returns the children that forbid the delete (empty means allowed).
    """
    gone = deleted.select(F.col(parent_key).alias("_gone")).distinct()
    match = F.col(column) == F.col("_gone")
    if rule == "cascade":
        return children.join(gone, match, "left_anti")
    if rule == "restrict":
        return children.join(gone, match, "left_semi")
    if rule == "set_null":
        return (children.join(gone, match, "left")
                .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone"))
    raise ValueError(f"unknown delete rule {rule!r}")


@dataclass
class Deleted:
    """What ``delete_rows`` leaves: the tables, and each request that was refused with the child that forbids it."""

    tables: dict[str, DataFrame]
    refused: DataFrame


def delete_rows(tables: Mapping[str, DataFrame], requests: Mapping[str, tuple[str, DataFrame]], references: Iterable[tuple]) -> Deleted:
    """Delete parents by key, deciding over all references between the given tables together.

    ``requests`` maps a table to the key column its references use and the requested keys; each key is a request of its own. A request takes the row,
    the children of CASCADE references, their children, and so on. It is refused as a whole if a RESTRICT reference leads from a row that
    stays to one that it takes; a child that another granted request takes does not forbid. As a refusal keeps rows that may forbid
    another request, requests are weighed in rounds until none is refused any more; only then the granted ones take effect and SET NULL
    references to rows that go are cleared. Null keys and null references match nothing. A key that is not there is granted.

    Rows are told apart by their key and reference columns only, so no table is copied: tables and requests are read again wherever they
    are used and must give the same rows each time. What is written are the rows taken from tables whose requests may be refused, or
    that decide whether a child stays, and per request counts of the children that forbid it. A table stored by the key of its requests
    and references (``layout.deal_bucketed``) is not shuffled for them.
    """
    spark = next(iter(tables.values())).sparkSession
    links = [r for r in references if r[0] in tables and r[2] in tables]
    cascades, restricts = [r for r in links if r[4] == "cascade"], [r for r in links if r[4] == "restrict"]
    cut = lambda text: text.split(",")
    listed = _listed(cascades, restricts)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def named(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
        return df.select(*more, *[F.col(c).alias(f"_p{i}") for i, c in enumerate(columns)]).distinct()

    def same(columns: list[str]) -> list[Column]:
        return [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]

    # The key columns of a listed table, under which its taken rows are listed.
    columns = {t: list(dict.fromkeys(c for r in links if r[2] == t for c in cut(r[3]))) for t in listed}
    wanted = {t: named(asked, asked.columns[:1]).filter("_p0 IS NOT NULL") for t, (_, asked) in requests.items()}
    label = lambda t: F.concat(F.lit(f"{t}:"), F.col(requests[t][0]).cast("string")).alias("_request")
    asked: dict[str, DataFrame] = {}  # request and its key
    taken: dict[str, DataFrame] = {}  # request and key columns of the rows it takes
    fresh: dict[str, DataFrame] = {}
    for t in sorted(listed & requests.keys()):
        key = requests[t][0]
        found = tables[t].join(wanted[t], same([key]), "left_semi")
        both = keep(found.select(label(t), *dict.fromkeys([key, *columns[t]])).distinct(), "delete-taken")
        asked[t], fresh[t] = named(both, [key], "_request"), both.select("_request", *columns[t])

    while fresh:
        for t, more in fresh.items():
            taken[t] = taken[t].union(more) if t in taken else more
        found: dict[str, DataFrame] = {}
        for child, column, parent, key in (r[:4] for r in cascades if r[2] in fresh and r[0] in listed):
            gone = named(fresh[parent], cut(key), "_request")
            some = tables[child].join(gone, same(cut(column))).select("_request", *columns[child])
            found[child] = found[child].union(some) if child in found else some
        fresh = {}
        for t, some in found.items():
            some = some.distinct()
            some = keep(null_safe_join(some, taken[t].distinct(), some.columns, "left_anti") if t in taken else some, "delete-taken")
            if not some.isEmpty():
                fresh[t] = some

    # Children that forbid a request, counted by the columns that tell whether another request takes them.
    forbidding = []
    for child, column, parent, key in (r[:4] for r in restricts if r[2] in taken):
        held = tables[child].join(named(taken[parent], cut(key), "_request"), same(cut(column))).select("_request", *tables[child].columns)
        ways = [(cut(r[1]), r[2], cut(r[3])) for r in cascades if r[0] == child and r[2] in taken]
        if child in asked:
            ways.append(([requests[child][0]], None, None))
        elif child in requests:
            # Such a request is never refused.
            held = held.join(wanted[child], same([requests[child][0]]), "left_anti")
        by = dict.fromkeys(c for way in ways for c in way[0])
        forbidding.append((child, column, ways, keep(held.groupBy("_request", *by).agg(F.count("*").alias("n_rows")), "delete-forbid")))

    none = {"_request": "string", "child": "string", "column": "string", "n_rows": "long"}
    refused = keep(spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in none.items()]), "delete-refused")
    while True:
        off = refused.select("_request").distinct()
        granted = {t: df.join(off, "_request", "left_anti") for t, df in taken.items()}
        allowed = {t: df.join(off, "_request", "left_anti").select("_p0").distinct() for t, df in asked.items()}
        against = []
        for child, column, ways, held in forbidding:
            held = held.join(off, "_request", "left_anti")
            for here, parent, key in ways:
                held = held.join(named(granted[parent], key) if parent else allowed[child], same(here), "left_anti")
            against.append(held.groupBy("_request").agg(F.sum("n_rows").alias("n_rows")).select(
                "_request", F.lit(child).alias("child"), F.lit(column).alias("column"), "n_rows"))
        more = keep(reduce(DataFrame.union, against, refused.limit(0)), "delete-refused")
        if more.isEmpty():
            break
        refused = keep(refused.union(more), "delete-refused")
    allowed = {**wanted, **allowed}

    def ways_out(t: str) -> list[tuple[list[str], DataFrame]]:
        """Columns of a table and the values under which its rows go."""
        direct = [([requests[t][0]], allowed[t])] if t in requests else []
        return direct + [(cut(r[1]), gone) for r in cascades if r[0] == t and (gone := going(r[2], cut(r[3]))) is not None]

    def going(t: str, key: list[str]) -> DataFrame | None:
        """The key of the rows of a table that go."""
        if t in listed:
            return named(granted[t], key) if t in granted else None
        parts = [tables[t].join(gone, same(here), "left_semi").select(*key) for here, gone in ways_out(t)]
        return named(reduce(DataFrame.union, parts), key) if parts else None

    left = {}
    for t, df in tables.items():
        stays = df
        for here, gone in ways_out(t):
            stays = stays.join(gone, same(here), "left_anti")
        for here, gone in [(cut(r[1]), going(r[2], cut(r[3]))) for r in links if r[0] == t and r[4] == "set_null"]:
            if gone is not None:
                stays = stays.join(gone.withColumn("_gone", F.lit(True)), same(here), "left")
                cleared = {c: F.when(F.col("_gone").isNull(), F.col(c)) for c in here}
                stays = stays.withColumns(cleared).drop("_gone", *[f"_p{i}" for i in range(len(here))])
        left[t] = stays
    parts = F.split("_request", ":", 2)
    return Deleted(left, refused.select(parts[0].alias("tbl"), parts[1].alias("key"), "child", "column", "n_rows"))


def _listed(cascades: list[tuple], restricts: list[tuple]) -> set[str]:
    """Tables whose taken rows ``delete_rows`` must know by request: those a RESTRICT reference names, those whose CASCADE references
    reach them or a table that may forbid, and those in a circle of CASCADE references. Requests on other tables are never refused."""
    parents: dict[str, set[str]] = {}
    for r in cascades:
        parents.setdefault(r[0], set()).add(r[2])

    def above(tables: set[str]) -> set[str]:
        seen, todo = set(), set(tables)
        while todo:
            todo = set().union(*[parents.get(t, set()) for t in todo]) - seen
            seen |= todo
        return seen

    circles = {t for t in parents if t in above({t})}
    start = {r[2] for r in restricts} | circles
    return start | above(start | {r[0] for r in restricts})


def dual_write(batch: DataFrame, writers: Iterable[Callable[[DataFrame], None]]) -> None:
    """Give one load to several writers; succeeds only if all of them do.

    The load is written once to the shared folder and read back for each writer,
    so all see the same rows; the copy goes when they are done.
    """
    spark = batch.sparkSession
    path = scratch_path(spark, "dual-write")
    batch.write.parquet(path)
    try:
        for write in writers:
            write(spark.read.schema(batch.schema).parquet(path))
    finally:
        remove(spark, path)
