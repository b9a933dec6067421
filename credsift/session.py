"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Merging keeps one record per key in an object aggregate; the default limit of 128 keys would turn
# every such aggregate into a sort. The limit counts keys, and values may be whole lines.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # a batch may hold several chunks of reports, each of many megabytes
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs rely on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship(spark)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package's code to the Python workers, wherever the driver found it.

    Spark hands the archive to the executors itself; once per application.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="credsift-code-"), "credsift-code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("credsift")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: on a cluster the
    executors would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    global _local_dir
    if _local_dir is None:
        _local_dir = os.path.join(tempfile.mkdtemp(prefix="credsift-"), "work")
    return _local_dir


_local_dir: str | None = None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small table one partition per core; tables with more partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


_workspaces: list[str] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of this block go to a folder that is removed at its end.

    Results must be written or collected inside the block, as their plans read those tables.
    """
    path = fresh_path(spark, "workspace")
    _workspaces.append(path)
    try:
        yield path
    finally:
        _workspaces.remove(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    base = _workspaces[-1] if _workspaces else shared_dir(spark)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives lost executors, is computed once however often it is used, and later
    reads prune columns and skip row groups.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
