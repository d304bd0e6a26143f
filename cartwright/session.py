"""Session settings the reports rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from cartwright.sources.staging import CHECKPOINT_CONF


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event days and hours are UTC; make the session agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_local_folder(spark: SparkSession) -> SparkSession:
    """Name a temporary folder for staged tables, in a local session that names none."""
    unset = not spark.conf.get(CHECKPOINT_CONF, None)
    if unset and spark.sparkContext.master.split("[")[0] == "local":
        spark.conf.set(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="cartwright-"))
    return spark


def local_session(cores: str = "8", app: str = "cartwright") -> SparkSession:
    """Session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return use_local_folder(spark)
