from binascii import crc32

import numpy as np

from cartwright.llm.language import fit_language_model, grams, held_out, predict_language
from cartwright.llm.tables import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    found = predict_language(docs, fit_language_model(docs), keep=True)
    found = found.select("row.lang", "lang_pred", "score", "doc_id", held_out("doc_id").alias("out"))
    rows = found.collect()
    assert all(r.out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.out]
    assert len(tested) > 100
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_and_labels_do_not_matter(make_docs):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(40)]
    rows += [(100 + i, "le chat et le chien " * 3, "fr") for i in range(40)]
    changed = [
        (i, t, "xx" if crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows
    ]
    one, two = (fit_language_model(make_docs(r)) for r in (rows, changed))
    assert one.languages == two.languages == ["en", "fr"]
    assert np.array_equal(one.log_p, two.log_p) and np.array_equal(one.prior, two.prior)


def test_result_does_not_depend_on_the_batch():
    texts = ["the cat", "", None, "!!", "été", "x" * 5000, " the  cat "]
    whole = grams(texts)
    for i, text in enumerate(texts):
        alone = grams([text])
        for order in range(len(whole.buckets)):
            first, last = (int(s[i]) for s in whole.spans[order])
            a, b = (int(s[0]) for s in alone.spans[order])
            assert whole.buckets[order][first:last].tolist() == alone.buckets[order][a:b].tolist()
        assert whole.has_letter[i] == alone.has_letter[0]


def test_odd_documents(odd_docs, no_docs):
    model = fit_language_model(odd_docs)
    rows = predict_language(odd_docs, model, keep=True).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r.row.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    assert predict_language(no_docs, model).count() == 0
    nothing = fit_language_model(no_docs)
    assert nothing.languages == []
    assert {r.lang_pred for r in predict_language(odd_docs, nothing).collect()} == {"und"}
