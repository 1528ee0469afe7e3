"""Session helpers: shared folders and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, if the cluster names one.

    Only where the setting is absent (a local test session) a folder of the machine is used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="latticeflow-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that its path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Tasks of a step that computes far more than it reads: those of a shuffle, and no fewer than there are cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitions by keys for costly work per row; a fixed number, since by their bytes AQE would join small partitions into one task.

    It is one more than `width`: Spark drops a repartition that equals the shuffle below it (of a `distinct`, say), which AQE may join.
    A later aggregate or join on the same keys reuses the partitioning.
    """
    return df.repartition(width(df.sparkSession) + 1, *keys)


def wide_scan(df: DataFrame) -> DataFrame:
    """A scanned table, spread only if it has fewer partitions than there are cores; larger tables aren't moved."""
    return df.repartition(n) if df.rdd.getNumPartitions() < (n := df.sparkSession.sparkContext.defaultParallelism) else df
