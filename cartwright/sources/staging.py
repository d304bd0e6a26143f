"""Tables written to the shared folder of the cluster, to be read back by later steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must reach."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    return folder.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path for one staged table; never reused, so a rerun cannot mix results."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def application_folder(spark: SparkSession) -> str:
    """The folder of everything this application has staged."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def remove_staged(spark: SparkSession) -> bool:
    """Remove all staged tables of this application; no result built on them can be read after."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the stored copy.

    Lost executors then cost a re-read, not a rerun of the whole lineage, and
    iterative jobs scan columnar files instead of repeating their inputs.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
