"""Session helpers: a tuned local session for tests/bench, and scratch folders.

Scratch data (round-trip files, materialised tables) always lives under the
folder the cluster names in ``spark.checkpoint.dir``. A local folder is only
created when that setting is unset and the master is local (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    # broadcast only what AQE has measured to be small
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "vecshift",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app)
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    settings["spark.driver.memory"] = os.environ.get("VECSHIFT_DRIVER_MEMORY", "16g")
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Read from the session; set a local one only when unset on a local master.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        configured = tempfile.mkdtemp(prefix="vecshift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of the file system that its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is one file, not a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for Python-side file access on local paths."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return path


def materialize(df, name: str = "table", order: str | None = None):
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Cuts the lineage (later jobs and lost executors restart from the files,
    not from the upstream shuffles) while keeping column pruning and filter
    pushdown for every later reader. ``order`` sorts the files' rows, so that
    filters on it skip row groups. :func:`remove_scratch` deletes all of a
    session's scratch tables.
    """
    path = scratch_path(df.sparkSession, name)
    if order:
        df = df.orderBy(order)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_table(df) -> None:
    """Delete the files of a table that :func:`materialize` gave, once nothing that was read from it is needed any more."""
    for folder in {unquote(f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
        remove_path(df.sparkSession, folder)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends.

    Else they stay until the driver happens to collect garbage, so those of many jobs in a row lie on the disks at once.
    A frame that is run again shuffles again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def remove_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this session, once nothing that was read from them is needed any more."""
    remove_path(spark, f"{checkpoint_dir(spark).rstrip('/')}/scratch")


def input_bytes(df) -> int | None:
    """Bytes the plan of ``df`` reads: Catalyst's size of its leaf relations; no job runs.

    Leaf sizes come from file sizes (or cached sizes), unlike the estimate of
    the root, which joins inflate by orders of magnitude. (Asking
    ``df.rdd.getNumPartitions()`` instead would run every shuffle stage under
    AQE once just to count partitions, and the real action would run them again.)
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001 - no estimate: leave the plan alone
        return None


SMALL_INPUT_BYTES = 256 * 1024 * 1024


def ensure_parallelism(df, factor: int = 2, small_bytes: int = SMALL_INPUT_BYTES):
    """Spread a small input over ``factor`` × task slots before a CPU-heavy Python stage.

    Small inputs (≤ ``small_bytes`` read) often come from one file or one row
    group, so one task would do all the work: they get a round-robin
    repartition, which is cheap at that size and stays deterministic on retry.
    Large inputs keep the partitioning of their scan or shuffle (no extra
    shuffle of the full data).
    """
    if df.isStreaming:
        return df
    size = input_bytes(df)
    if size is None or size > small_bytes:
        return df
    return df.repartition(factor * df.sparkSession.sparkContext.defaultParallelism)
