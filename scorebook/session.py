"""Session settings and the one place that materialises intermediate results."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs whatever the cluster size. Partition counts are left to
# AQE: it coalesces small shuffles, splits skewed join partitions and switches
# a join to broadcast only after measuring the side.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "scorebook", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A local master has one machine only, so a temporary folder is as shared as
    it gets; on a cluster a missing setting is an error, not a silent fallback.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="scorebook-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``scratch_path``, wherever the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from the copy."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def durable_by(df: DataFrame, slots: int, *keys: str, then: Callable[[DataFrame], DataFrame] = lambda laid: laid) -> DataFrame:
    """``durable`` hash-partitioned by ``keys``, so that later joins on them need no
    exchange of this side. ``then`` may group the rows by ``keys`` before they are
    written, which moves nothing more. Spark records the layout of a checkpoint only for a
    plan without adaptive execution, which therefore pauses for this one job.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    laid_out = then(df.repartition(slots, *keys))
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return durable(laid_out)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


@contextmanager
def shuffle_slots(spark: SparkSession, slots: int) -> Iterator[None]:
    """At least ``slots`` shuffle partitions for the jobs that run inside, so that a task's share of a group or sort stays small however
    large the tables are. Adaptive execution joins what turns out small. A plan that runs later does not see it."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), slots)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def joins_by_layout(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside join two sides laid out alike by some of their join keys as they lie, instead of dealing both anew by all keys.
    For layouts of which no part is much larger than the others, as skewed parts are not split. A plan that runs later does not see it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session.

    Operators with a Python step call this themselves; it sends a small zip once
    per application, and does no harm where the package is installed already.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='scorebook-')}/scorebook", "zip",
                                      package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
