"""Inputs of the registered queries: canonical events, feature table, fitted models."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.config import DRIVER_CONFIG
from cartwright.ml.models import FittedModel, fit_forest, fit_logistic
from cartwright.ml.scoring import forest_nodes
from cartwright.ml.split import stratified_split
from cartwright.operators.sessions import session_table
from cartwright.operators.shape import shape_events
from cartwright.plans.repeat import ml_feature_table
from cartwright.session import pin_utc, use_local_folder
from cartwright.sources.driver_events import canonical_events
from cartwright.sources.staging import stage, staging_path
from cartwright.sources.tables import (
    read_events,
    read_feature_table,
    write_events,
    write_feature_table,
)

LABEL = DRIVER_CONFIG.label_column
KEY = "user_pseudo_id"


# The flat driver table is turned into stored canonical events once per session,
# the form in which an event export arrives. Finding the sessions costs a join over
# all events; no report should repeat it, and only stored events let a report skip
# days, event types and columns. The feature table, the split and the models follow
# in the same way. They are kept for the session by folder: the tables of a folder must
# not change while a session runs.


@lru_cache(maxsize=None)
def event_path(spark: SparkSession, sf_dir: str, split: int, gap_hours: int) -> str:
    path = staging_path(use_local_folder(spark), f"events-{split}-{gap_hours}")
    write_events(canonical_events(pin_utc(spark), sf_dir, split, gap_hours), path)
    return path


@lru_cache(maxsize=None)
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole users and sessions after 12 idle hours."""
    return read_events(spark, event_path(spark, sf_dir, 1, 12))


@lru_cache(maxsize=None)
def customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight sub-users per user and sessions after 72 idle hours, for customer reports."""
    return read_events(spark, event_path(spark, sf_dir, 8, 72))


@lru_cache(maxsize=None)
def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(events(spark, sf_dir))


@lru_cache(maxsize=None)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session, found once for all session reports."""
    return stage(session_table(shaped(spark, sf_dir)), "sessions")


@lru_cache(maxsize=None)
def shaped_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(customer_events(spark, sf_dir))


@lru_cache(maxsize=None)
def feature_path(spark: SparkSession, sf_dir: str) -> str:
    path = staging_path(use_local_folder(spark), "features")
    rows = ml_feature_table(customer_events(spark, sf_dir), DRIVER_CONFIG)
    write_feature_table(rows, path, LABEL)
    return path


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_feature_table(pin_utc(spark), feature_path(spark, sf_dir), LABEL)


@lru_cache(maxsize=None)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(stratified_split(features(spark, sf_dir), LABEL, KEY), "split")


def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return split(spark, sf_dir).where(F.col("split") == name).drop("split")


@lru_cache(maxsize=None)
def model(spark: SparkSession, sf_dir: str, kind: str) -> FittedModel:
    fit = {"logistic": fit_logistic, "forest": fit_forest}[kind]
    return fit(part(spark, sf_dir, "train"), LABEL)


@lru_cache(maxsize=None)
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of the fitted forest."""
    return forest_nodes(model(spark, sf_dir, "forest"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed label and score, to check the quality measures against SQL."""
    use_local_folder(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("quality").alias("label"),
        F.col("n_chars").alias("score"),
        (F.col("n_chars") >= 500).cast("int").alias("predicted"),
    )
