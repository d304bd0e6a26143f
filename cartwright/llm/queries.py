"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm import hamming, hard_negatives, line_dedup, url_filter
from cartwright.llm.alignment import align_tokens
from cartwright.llm.html_text import extract_text, fit_tag_weights
from cartwright.llm.language import fit_language_model, held_out, predict_language
from cartwright.llm.near_duplicates import near_duplicates
from cartwright.llm.neighbours import nearest_vectors
from cartwright.llm.packing import pack
from cartwright.llm.quality import judge_quality
from cartwright.llm.secret_scan import fit_formats, scan_secrets
from cartwright.llm.sentence_pieces import decode_pieces, encode_pieces
from cartwright.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "text", "lines_removed")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_codes(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents")))
    text_crc32 = F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    return decoded.select("doc_id", "n_ids", "ids_crc32", text_crc32)


def _joined(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, fit_formats(docs))
    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    digest = F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _joined("spans").alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, fit_language_model(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_tag_weights(pages))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return groups.select("doc_id", fingerprint, "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_secret_scans": op4_secret_scans,
        "op5_language_id": op5_language_id,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_html_extraction": op8_html_extraction,
        "op9_url_filters": op9_url_filters,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_quality_rules": op11_quality_rules,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_token_alignment": op13_token_alignment,
    }


def all_statements() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.statement(),
        "op2_exact_top_k": hamming.statement(),
        "op9_url_filters": url_filter.statement(),
        "op12_hard_negatives": hard_negatives.statement(),
    }
