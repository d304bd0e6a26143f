"""The corpus pipeline: language, repeated lines, near duplicates, secrets, packing.

Each stage takes all documents that the one before kept. All but the last return the
columns of ``documents``; where a stage changes a text, ``n_chars`` follows. Null and
empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm.language import UNKNOWN, fit_language_model, predict_language
from cartwright.llm.line_dedup import dedup_lines
from cartwright.llm.near_duplicates import one_of_each
from cartwright.llm.packing import pack
from cartwright.llm.secret_scan import fit_formats, redact_secrets
from cartwright.llm.tables import table
from cartwright.session import use_local_folder
from cartwright.sources.staging import stage

#: Documents whose language has a smaller posterior are rejected.
LEAST_SCORE = 0.5


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``; a length column follows its text."""
    if "n_chars" not in docs.columns:
        return changed.select(*docs.columns)
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return changed.withColumn("n_chars", length).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells with some confidence.

    Null, empty and letterless texts have no language and go; repeated rows are judged alike
    and stay; null ids stay; an empty table stays empty.
    """
    use_local_folder(spark)
    found = predict_language(docs, fit_language_model(docs), keep=True)
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document of nothing else goes.

    Null and empty texts stay as they are; rows that share an id and a text lose the same
    lines; null ids come last; an empty table stays empty.
    """
    use_local_folder(spark)
    found = dedup_lines(docs).where("lines_removed = 0 OR text <> ''")
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    kept = found.select(*columns)
    return _with_text(docs, kept)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Null and empty texts are one group; of repeated rows one stays; a null id is the least
    only where all are null; an empty table stays empty.
    """
    use_local_folder(spark)
    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret masked.

    Null and empty texts stay as they are, repeated rows are masked alike, null ids stay, and
    an empty table stays empty.
    """
    use_local_folder(spark)
    return _with_text(docs, redact_secrets(docs, fit_formats(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences.

    A null or empty text is the end id alone; repeated rows are packed each; null ids stay;
    an empty table gives no rows.
    """
    use_local_folder(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The language model, the fingerprints and the packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
