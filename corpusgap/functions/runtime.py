"""What jobs need of their Spark application: the package on its executors, and the folder that all of them share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def share_package(spark: SparkSession) -> None:
    """Ship the package to the executors once per Spark application.

    Functions of a module travel by name, so workers must be able to import the
    module; on a cluster they don't see the driver's folders.
    """
    context = spark.sparkContext
    mark = f"_shared_{_PACKAGE.name}"
    if getattr(context, mark, False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive.resolve()))
    setattr(context, mark, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset (tests) a folder is made."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the shared checkpoint folder, with its lineage cut; nothing stays in memory."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
