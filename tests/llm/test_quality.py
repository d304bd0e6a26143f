import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm import quality
from cartwright.llm.tables import table

WORD = re.compile("[^\x20\x09-\x0d]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if windows[window] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(repeated)
    chars = sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, chars, symbols, len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def plain_vector(text):
    n, chars, symbols, dup, repeated, _ = plain_counts(text)
    lines = sum(1 for x in text.split("\n") if WORD.search(x))
    raw = [np.log(n), np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dup / lines), np.sqrt(repeated / n)]
    return [round(x / s * quality.UNIT) for x, s in zip(raw, quality.TRAITS.values())]


def fitted(x, rows, factor):
    """Centre and covariance of some rows, with the ridge."""
    own = x[rows]
    mean = own.mean(axis=0)
    cov = (own.T @ own / len(own) - np.outer(mean, mean)) * factor
    return mean, cov + np.eye(x.shape[1]) * quality.UNIT**2


def squared(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def plain_distances(x):
    """Concentration steps of one group on plain matrices."""
    middle = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - middle), axis=0)
    found = []
    for start in (np.zeros(x.shape[1]), spread):
        mean, cov = middle, np.diag(quality.UNIT**2 + start**2)
        for _ in range(quality.STEPS):
            bins = np.floor(np.log2(np.maximum(squared(x, mean, cov), 2.0**-10)) * quality.BINS)
            last = np.sort(bins)[int(np.ceil(len(x) * quality.HALF)) - 1]
            mean, cov = fitted(x, bins <= last, quality.consistency(quality.HALF))
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: round(f[0], 9))
    near = squared(x, mean, cov) <= quality.chi2_quantile(1 - quality.REWEIGHT_TAIL)
    return squared(x, *fitted(x, near, quality.consistency(1 - quality.REWEIGHT_TAIL)))


def judged(docs, **settings):
    return quality.judge_quality(docs, **settings).collect()


def test_counts_and_verdicts_equal_the_plain_ones(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in judged(docs)}
    texts = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() == texts.keys()
    groups = {}
    for doc, row in texts.items():
        counts = plain_counts(row.text)
        assert tuple(rows[doc][c] for c in COUNTS) == counts
        if counts[-1]:
            assert rows[doc].distance is None and not rows[doc].kept
        else:
            groups.setdefault((row.lang, row.source), []).append(doc)
    limit = quality.chi2_quantile(1 - quality.REJECT_TAIL)
    for members in groups.values():
        want = plain_distances(np.array([plain_vector(texts[d].text) for d in members], float))
        got = np.array([rows[d].distance for d in members])
        assert np.allclose(got, want, rtol=1e-6, atol=1e-9)
        assert [rows[d].kept for d in members] == (want <= limit).tolist()


def prose(rng, words, symbol=""):
    return "\n".join(
        " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) + symbol for _ in range(12))
        for _ in range(words // 12)
    )


@pytest.fixture(scope="module")
def two_sources(spark):
    """Prose, a tenth of it spoiled, one source three times as large; lengths differ widely."""
    rng = random.Random(2)
    rows = []
    for i in range(240):
        bad = i % 10 == 0
        text = prose(rng, 60 * 2 ** rng.randrange(0, 7), "$$" if bad else "")
        rows.append((i, text, "en", "big" if i % 4 else "small", bad))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")


def test_spoiled_documents_go_and_clean_ones_stay(two_sources):
    bad = {r.doc_id for r in two_sources.where("bad").collect()}
    found = judged(two_sources)
    assert {r.doc_id for r in found if not r.kept} == bad


def test_result_does_not_depend_on_the_partitioning(two_sources):
    a = {r.doc_id: r.distance for r in judged(two_sources.repartition(1))}
    b = {r.doc_id: r.distance for r in judged(two_sources.repartition(9, "text"))}
    assert a == b


def test_windows_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.length(columns[0]).cast("long"))
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "d"]) for _ in range(n)) for n in (3, 4, 9, 40, 90)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = quality.text_statistics(docs, "text", [F.col("doc_id")]).collect()
    assert {r.doc_id: r.n_repeat_words for r in found} == {i: plain_counts(t)[4] for i, t in enumerate(texts)}


def test_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.withColumns({c: F.lit("x") for c in ("z0", "mu0", "kept", "start", "bin", "n", "n_words")})
    found = judged(docs)
    texts = [r.text for r in docs.collect()]
    assert Counter(tuple(r[c] for c in COUNTS) for r in found) == Counter(map(plain_counts, texts))
    assert [r for r in found if r.kept] == []  # the long text repeats its windows
    assert judged(no_docs) == []


def test_small_and_null_groups_keep_their_rows(spark):
    rng = random.Random(7)
    rows = [(1, prose(rng, 60), None, None), (2, prose(rng, 600), "en", None), (2, prose(rng, 600), "en", None)]
    rows += [(None, rows[0][1], None, None)]
    found = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert len(found) == 4 and all(r.kept and r.distance is not None for r in found)


def test_consistency_and_quantiles():
    assert quality.chi2_quantile(0.5) == pytest.approx(4.35146, abs=1e-5)
    assert quality.chi2_quantile(0.975) == pytest.approx(12.8325, abs=1e-4)
    x = np.random.default_rng(0).normal(size=(200_000, quality.D))
    d = (x**2).sum(axis=1)
    near = x[d <= np.median(d)]
    assert near.var() * quality.consistency(0.5) == pytest.approx(1, abs=0.01)
