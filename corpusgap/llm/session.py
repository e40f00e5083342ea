"""Session helpers: checkpoints in the shared folder, table paths, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.runtime import share_package


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset (tests) make a folder."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, i = stem, 0
    while name.lower() in taken:
        i += 1
        name = f"{stem}_{i}"
    return name


#: Spark's setting by which a query's shuffle files go when the query ends.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run in a folder of the shared checkpoint folder.

    ``settle`` writes a frame there as Parquet and reads it back, which cuts its lineage;
    the shuffle files behind it go when it is written, and ``drop`` deletes a table that
    isn't needed any more.
    """

    def __init__(self, spark: SparkSession, stem: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
        self.count = 0

    def settle(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        before = self.spark.conf.get(_CLEAN_SHUFFLES, "false")
        self.spark.conf.set(_CLEAN_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_SHUFFLES, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
