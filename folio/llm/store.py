"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..cluster import shipped

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in a local session where that is unset a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table made by materialize() that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Spark removes a query's shuffle files when the query ends, not when the driver's garbage is collected.

    The setting is the session's: a query that another thread plans meanwhile has it as well.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_at(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def bucketed(df: DataFrame, key: str, name: str = "table", path: str | None = None) -> DataFrame:
    """df written in the shared folder as a table bucketed by key: joins and groups by key find it dealt."""
    spark, n = df.sparkSession, partitions(df)
    path = path or new_path(spark, name)
    table = _table_at(path)
    with shuffles_removed(spark):
        df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table made by bucketed() that no later step reads."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_at(path)}")
    drop_path(spark, path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def ship(df: DataFrame) -> DataFrame:
    """df, for Python workers: they have this package, and get batches of texts by bytes, not by ten thousand rows.

    The size of batches is a setting of the session and stays; df is planned only when it is run.
    """
    for key, value in BATCHES.items():
        df.sparkSession.conf.set(key, value)
    return shipped(df)
