"""Spark session helpers.

Settings follow what a cluster job needs: UTC session time zone (timestamps agree
with the DuckDB oracle), ANSI mode, adaptive execution with skew-join handling, and
Arrow for the few pandas-backed steps.  Nothing here overrides a value the cluster
already set; ``checkpoint_dir`` only invents a local folder when the session has
no ``spark.checkpoint.dir`` (tests, laptops).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "leadlens",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return the active session, or build one with the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local") and "spark_driver_memory" not in conf:
            # local mode runs every task in the driver JVM; only effective when
            # this call starts the JVM
            builder = builder.config("spark.driver.memory", "12g")
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: Python stages pickle their
    functions by module name, and a worker may start where the package is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="leadlens-pkg-"), "leadlens.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and sink tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one.  Where it is unset, a local
    session (laptop, tests) gets a fresh temporary folder; on any other master that folder
    could not be shared, so it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="leadlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []
_shipped: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for one written table; it is
    removed by :func:`cleanup_scratch` (also run when the interpreter exits)."""
    base = checkpoint_dir(spark)
    path = f"{base}/{name}-{next(_counter)}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cleanup_scratch(spark: SparkSession | None = None) -> int:
    """Delete the scratch tables this process wrote (through the Hadoop file
    system, so shared storage works too).  Call it once results are consumed."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return 0
    removed = 0
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while _written:
            path = jvm.org.apache.hadoop.fs.Path(_written.pop())
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                fs.delete(path, True)
                removed += 1
    except Exception:  # pragma: no cover - best effort (JVM may already be gone)
        return removed
    return removed


def remove_scratch(df) -> None:
    """Delete the written table that ``df`` (a result of :func:`materialize`) reads, once a later
    one has taken its place."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        known = [p for p in _written if path.endswith(p.split("://")[-1].lstrip("/"))]
        for p in known:
            _written.remove(p)
            fs, at = _fs_path(spark, p)
            fs.delete(at, True)


atexit.register(cleanup_scratch)


def _count():
    n = 0
    while True:
        n += 1
        yield n


_counter = _count()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it
    back: cuts lineage, survives executor loss, and later filters prune row
    groups by Parquet statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done: its cleaner follows the driver's garbage
    collector, which may not run for half an hour while a chain of rounds fills the executors' disks."""
    spark.sparkContext._jvm.System.gc()


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on any Hadoop file system (local, HDFS, object stores)."""
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())
