"""Session defaults and staged tables.

A staged table is a Parquet copy of an intermediate result in the shared folder
named by ``spark.checkpoint.dir``. It cuts the lineage (a lost executor re-reads
files instead of replaying the whole plan) and, unlike an RDD checkpoint, keeps
column pruning and filter pushdown for its readers.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", app: str = "eddyline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on: dates and wall clocks are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


ADVISORY_KEY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
BROADCAST_KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
HASH_KEY = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
SCAN_KEY = "spark.sql.files.maxPartitionBytes"
TASK_BYTES = 8 << 20
TASK_ROWS = 50_000
BROADCAST_BYTES = 1 << 20
SCAN_BYTES = 16 << 20
_UNITS = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def _bytes(size: str) -> int:
    """A size as the settings write it: 8m, 64MB, 67108864b."""
    number = size.rstrip("bBkKmMgGtTpP")
    return int(number) << _UNITS.get(size[len(number) :].lower()[:1], 0)


def spread(spark: SparkSession, rows: int) -> None:
    """Let shuffles start from as many partitions as ``rows`` ask for and merge small ones
    only up to ``TASK_BYTES``. A task then works on a bounded part of the log however long
    that grows, and its sorts and windows hold a bounded amount. Smaller settings stay.

    Scans are cut at ``SCAN_BYTES`` for the same reason. The engine judges a broadcast by
    compressed bytes, of which a sorted log has one in forty; each task and the driver hold
    the whole, so more than ``BROADCAST_BYTES`` is shuffled instead. A shuffled side of which
    no task reads more than ``TASK_BYTES`` is hashed: the other side keeps its order and is
    not sorted for the join."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL_KEY, str(max(least, -(-rows // TASK_ROWS))))
    _at_most(spark, ADVISORY_KEY, TASK_BYTES)
    _at_most(spark, SCAN_KEY, SCAN_BYTES)
    spark.conf.set(HASH_KEY, f"{TASK_BYTES}b")
    for key in BROADCAST_KEYS:
        _at_most(spark, key, BROADCAST_BYTES)


def shuffle_tasks(spark: SparkSession) -> int:
    """How many partitions shuffles start from, before small ones are merged."""
    return int(spark.conf.get(INITIAL_KEY, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def _at_most(spark: SparkSession, key: str, limit: int) -> None:
    present = spark.conf.get(key, None)
    if present is None or _bytes(present) > limit:
        spark.conf.set(key, f"{limit}b")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session without one gets a temporary
    folder that goes with the process; any other session must name a shared one."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    return _local_folder(spark.sparkContext.master, spark.sparkContext.applicationId)


def _local_folder(master: str, application: str) -> str:
    if not master.split("[")[0] == "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors of {master} share")
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="eddyline-")
        atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
    return _LOCAL[application]


@contextmanager
def reuse_layout(spark: SparkSession):
    """Let joins whose keys include the present partitioning keep it.

    Only for plans laid out by (key, block): there the layout is never skewed, so
    a join on (key, block, …) need not move the rows again.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_STAGED: dict[str, list[str]] = {}


def drop_staged(spark: SparkSession) -> int:
    """Remove the tables this application has staged; returns how many there were.

    Frames read from them are of no use afterwards: call it at the end of a session.
    """
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return a reader over the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
