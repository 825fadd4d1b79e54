"""Session helpers: local session for tests, durable checkpoints, scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS_CONF = "spark.oddledger.groupRows"
DEFAULT_GROUP_ROWS = 1_000_000


def local_session(cores: str = "8", name: str = "oddledger", memory: str = "8g") -> SparkSession:
    """A local session as used by the tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def group_rows(spark: SparkSession) -> int:
    """Rows that one task may always hold for one key."""
    return int(spark.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one in local runs."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="oddledger-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Folders made by ``scratch`` inside the block are removed at its end.

    For jobs that write their result inside the block; what is read later must not
    depend on copies that are gone.
    """
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that row ids stay fixed."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name next to the checkpoints, for tables a job hands on."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Store once as Parquet and read back, so that later passes prune columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


SMALL_ROWS = 10_000_000


def spread_small(df: DataFrame, rows: int) -> DataFrame:
    """Use all cores for Python work on a table too small to have many splits."""
    if rows > SMALL_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
