"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright.llm.tables import pieces

SPACE = 32
ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: Fixed-point scale of the log probabilities: sums are exact in any order.
SCALE = 1 << 16
#: About this many labelled rows per language are learned from, chosen by a hash.
ROWS_PER_LANGUAGE = 4000
#: More label values than this are an error, which bounds the broadcast matrix.
MAX_LANGUAGES = 512
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case code of every letter; a blank for every other character."""
    table = np.full(sys.maxunicode + 1, SPACE, np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


@dataclass(frozen=True)
class Grams:
    """Hash buckets of the n-grams of several texts, one array per order."""

    buckets: list[np.ndarray]
    #: Per order, first and last-plus-one position of each text.
    spans: list[tuple[np.ndarray, np.ndarray]]
    has_letter: np.ndarray


def grams(texts: list[str | None]) -> Grams:
    """N-grams of letters, where every run of other characters is one blank.

    Each text is read with a blank before and after it; no n-gram spans two texts.
    """
    texts = [t or "" for t in texts]
    raw = "".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass")
    codes = letter_table()[np.frombuffer(raw, np.uint32)]
    starts = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    keep[starts[:-1]] = True
    codes = codes[keep]
    moved = np.concatenate(([0], np.cumsum(keep)))[starts]
    first, last = moved[:-1], moved[1:]
    buckets, spans = [], []
    value = codes
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            value = value[:-1] * np.uint32(0x01000193) + codes[order - 1 :]
        if order in ORDERS:
            mixed = (value + np.uint32(order)) * np.uint32(0x9E3779B1)
            buckets.append(mixed >> np.uint32(32 - BUCKET_BITS))
            spans.append((first, np.maximum(first, last + 1 - order)))
    letters = np.concatenate(([0], np.cumsum(codes != SPACE)))
    return Grams(buckets, spans, letters[moved[1:]] > letters[moved[:-1]])


@dataclass(frozen=True)
class LanguageModel:
    """``log_p[language, bucket]`` in fixed point, and the log share of each language."""

    languages: list[str]
    log_p: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior; ``und`` and 0 for a text without letters."""
        found = grams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.repeat(self.prior[:, None], len(texts), axis=1)
        for buckets, (first, last) in zip(found.buckets, found.spans):
            for row, log_p in zip(total, self.log_p):
                sums = np.concatenate(([0], np.cumsum(log_p[buckets], dtype=np.int64)))
                row += sums[np.minimum(last, len(buckets))] - sums[np.minimum(first, len(buckets))]
        best = total.argmax(axis=0)
        score = 1 / np.exp((total - total.max(axis=0)) / SCALE).sum(axis=0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, found.has_letter)]
        return names, np.where(found.has_letter, score, 0.0)


def held_out(id_column: str) -> Column:
    """Rows never learned from: crc32 of the id as text divides by 5 (a null id counts as '')."""
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(5)) == 0


def fit_language_model(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from rows with a text and a label that are not held out.

    At most about ``rows_per_language`` rows of a label are learned from: those whose
    hashed id falls under a share that follows from the label's number of rows. Their
    whole texts are counted. Ties between languages go to the first by name.
    """
    known = docs.where(
        F.col(text_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column)
    ).select(
        F.col(label_column).cast("string").alias("lang"),
        F.col(text_column).alias("text"),
        F.pmod(F.xxhash64(F.lit("language"), F.col(id_column)), F.lit(1 << 30)).alias("draw"),
    )
    sizes = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in {label_column}")
    if not sizes:
        return LanguageModel([], np.zeros((0, 1 << BUCKET_BITS), np.int32), np.zeros(0, np.int64))
    bounds = F.create_map(
        *(F.lit(x) for r in sizes for x in (r["lang"], int(min(1, rows_per_language / r["count"]) * (1 << 30))))
    )
    drawn = known.where(F.col("draw") < bounds[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, np.int64))
        for batch in pieces(batches):
            langs, texts = (c.to_pylist() for c in batch.columns)
            for lang in set(langs):
                found = grams([t for x, t in zip(langs, texts) if x == lang])
                for buckets, (first, last) in zip(found.buckets, found.spans):
                    inside = np.zeros(len(buckets) + 1, np.int64)
                    np.add.at(inside, np.minimum(first, len(buckets)), 1)
                    np.add.at(inside, np.minimum(last, len(buckets)), -1)
                    used = buckets[np.cumsum(inside[:-1]) > 0]
                    seen[lang] += np.bincount(used, minlength=1 << BUCKET_BITS)
        for lang, counts in seen.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])],
                names=["lang", "bucket", "n"],
            )

    counted = drawn.mapInArrow(count, "lang string, bucket long, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = [r["lang"] for r in sizes]
    counts = np.ones((len(languages), 1 << BUCKET_BITS))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[sums["lang"].map(place).to_numpy(int), sums["bucket"].to_numpy(int)] += sums["n"]
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    rows = np.array([r["count"] for r in sizes], float)
    return LanguageModel(
        languages,
        np.round(log_p * SCALE).astype(np.int32),
        np.round(np.log(rows / rows.sum()) * SCALE).astype(np.int64),
    )


def predict_language(
    docs: DataFrame,
    model: LanguageModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: bool = False,
) -> DataFrame:
    """One row per row: ``doc_id, lang_pred, score``; with ``keep`` also the row as ``row``.

    A text that is null, empty or without letters is ``und`` with score 0, as is every
    text under a model that learned nothing. Repeated rows get equal results; null ids
    stay null; an empty table gives no rows. No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(scores), *batch.columns[2:]],
                names=["doc_id", "lang_pred", "score", *(["row"] if keep else [])],
            )

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        *([F.struct("*").alias("row")] if keep else []),
    )
    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double")
    if keep:
        schema = schema.add("row", docs.schema)
    return slim.mapInArrow(of, schema)
