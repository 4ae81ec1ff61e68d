"""Session settings that the operators rely on, and tables kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Rows of a small table that a task writes at least.
ROWS = 20_000


def configured(spark: SparkSession) -> SparkSession:
    """Of repeated map keys the last one wins; times are in UTC."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds by the rows and the bytes of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4000000")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; an own one only in local mode without that setting.

    A cluster without the setting has no folder that outlives an executor, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
    return _own[context.applicationId]


def with_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder for checkpoints, unless the session has a checkpoint folder already."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch(spark: SparkSession) -> str:
    """A fresh folder path that all executors share."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


class Tables:
    """Intermediate tables, written as Parquet in the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top = spark, ""
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write a table and read it again. If it has ``rows`` at most, few rows are written by few tasks."""
        self.top = self.top or scratch(self.spark)
        path = f"{self.top}/{uuid.uuid4().hex}"
        (df if rows is None else df.coalesce(1 + rows // ROWS)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def bucketed(self, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        """Write a table in hash buckets of ``keys``: tables of as many buckets are joined by these without a shuffle."""
        self.top = self.top or scratch(self.spark)
        name = f"bucketed_{uuid.uuid4().hex}"
        path = f"{self.top}/{name}"
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that no result reads any more."""
        for df in tables:
            at = self.paths.pop(id(df))
            if at.split("/")[-1].startswith("bucketed_"):
                self.spark.sql(f"drop table if exists {at.split('/')[-1]}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
