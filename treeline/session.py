"""Session helper, table loading and durable cut points of long lineages."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Whether a checkpoint's files go when nothing refers to it any more.
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def get_spark(app: str = "treeline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TREELINE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CLEAN, "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``; a local session without one gets its own.

    Unless the session says otherwise, what is cut is deleted once no DataFrame needs it, so that the folder does not only grow.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().conf().contains(CLEAN):
        sc._jsc.sc().conf().set(CLEAN, "true")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written or cut here leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch(spark: SparkSession) -> str:
    """The shared folder for files that a query writes and reads again: where checkpoints go."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder of the shared folder that a query has read to its end, or when the session ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(p) if at_exit else fs.delete(p, True)
