"""The registered queries: their columns, and their rows against SQL or a plain version."""

import hashlib
import re
import zlib
from binascii import crc32

import numpy as np
import pytest
import sentencepiece

from cartwright.llm.queries import all_queries, all_statements
from cartwright.llm.secret_scan import KINDS
from cartwright.llm.sentence_pieces import default_model
from cartwright.llm.tables import table
from check_oracles import compare, duck
from tests.llm.test_near_duplicates import brute_force
from tests.llm.test_secret_scan import plain

COLUMNS = {
    "op1_line_dedup": "doc_id bigint, text string, lines_removed bigint",
    "op2_exact_top_k": "query_id bigint, rank int, vec_id bigint, distance bigint",
    "op3_sentencepiece": "doc_id bigint, n_ids bigint, ids_crc32 bigint, text_crc32 bigint",
    "op4_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint,"
    " base_sha256 string, spans string",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint,"
    " ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op9_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint,"
    " n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint,"
    " positive_score bigint, negative_score bigint",
    "op13_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint,"
    " n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    frame = all_queries()[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in frame.dtypes) == COLUMNS[name]


def test_every_query_is_listed():
    assert set(all_queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(all_statements()))
def test_equals_sql(spark, sf, name):
    frame = all_queries()[name](spark, sf)
    assert compare(frame, frame.collect(), duck(sf), all_statements()[name]) == ""


def texts(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}


def test_pieces_equal_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    found = {r.doc_id: r for r in all_queries()["op3_sentencepiece"](spark, sf).collect()}
    for doc, text in texts(spark, sf).items():
        ids = np.array(library.encode(text), "<i4")
        row = found[doc]
        assert (row.n_ids, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert row.text_crc32 == zlib.crc32(text.encode())


def test_secret_digests(spark, sf):
    sf = sf.replace("0.001", "0.01")
    found = {r.doc_id: r for r in all_queries()["op4_secret_scans"](spark, sf).collect()}
    for doc, text in texts(spark, sf).items():
        spans = plain(text)
        row = found[doc]
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [
            sum(s[2] == k for s in spans) for k in KINDS[:3]
        ]
        assert not joined or set(joined.split(",")) <= set(row.spans.split(","))


def test_language_rows(spark, sf):
    for row in all_queries()["op5_language_id"](spark, sf).collect():
        assert row.held_out == (crc32(str(row.doc_id).encode()) % 5 == 0)
        assert row.lang_pred in ("de", "en", "es", "fr") and 0 <= row.score <= 1


def test_groups_equal_all_pairs(spark, sf):
    found = all_queries()["op10_simhash_near_dedup"](spark, sf).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in found)
    rows = sorted((repr(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in found)
    assert rows == brute_force(list(texts(spark, sf).items()))
