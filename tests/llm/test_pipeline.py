import corpus_pipeline
from cartwright.llm.near_duplicates import near_duplicates
from cartwright.llm.packing import WordIds, default_vocabulary
from cartwright.llm.secret_scan import base_spans
from cartwright.llm.simhash import fingerprint
from cartwright.llm.tables import table
from cartwright.sources.staging import stage


def steps(spark, docs, sf):
    """Result of every stage, each written and read again."""
    out = {}
    for name, function in corpus_pipeline.STAGES:
        docs = out[name] = stage(function(spark, docs, sf), name)
    return out


def by_id(frame):
    rows = frame.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_each_stage_on_its_input(spark, sf):
    docs = table(spark, sf, "documents")
    out = steps(spark, docs, sf)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == docs.columns
        assert [f.dataType for f in out[name].schema] == [f.dataType for f in docs.schema]
        assert out[name].where("n_chars <> length(text)").count() == 0
    first, told, lines, single, clean = (by_id(d) for d in (docs, *list(out.values())[:4]))
    # Every document of this table is in a language.
    assert told == first
    # Lines only go where they repeat; nothing else changes.
    for doc, row in lines.items():
        kept = iter(told[doc].text.split("\n"))
        assert all(any(line == x for x in kept) for line in row.text.split("\n"))
    assert all(lines[d].source == told[d].source for d in lines)
    seen = {line for r in lines.values() for line in r.text.split("\n")}
    gone = [told[d].text for d in told if d not in lines]
    assert all(set(text.split("\n")) <= seen for text in gone)
    # One document of each group, the one with the least id.
    groups = {r.doc_id: r.component_id for r in near_duplicates(out["line_dedup"]).collect()}
    assert set(single) == set(groups.values())
    assert all(single[d] == lines[d] for d in single)
    for a in single.values():
        own = fingerprint(a.text.encode())
        assert all(
            bin(own ^ fingerprint(b.text.encode())).count("1") > 3
            for b in single.values()
            if b.doc_id < a.doc_id
        )
    # No fixed format is left, and texts without one are as they were.
    for doc, row in clean.items():
        assert base_spans(row.text) == []
        if not base_spans(single[doc].text) and "[SECRET]" not in row.text:
            assert row == single[doc]
    assert set(clean) == set(single)
    # Every id of the remaining texts is packed once.
    words = WordIds(default_vocabulary())
    packed = out["best_fit_packing"].groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {
        d: len(words.of(r.text)) // 4 + 1 for d, r in clean.items()
    }


def test_run_applies_the_stages(spark, sf):
    docs = table(spark, sf, "documents")
    want = steps(spark, docs, sf)["best_fit_packing"]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == want.columns
    assert sorted(found.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_odd_documents(spark, sf, odd_docs, no_docs):
    out = steps(spark, odd_docs, sf)
    assert sorted(r.doc_id or 0 for r in out["language_id"].collect()) == [0, 3, 4, 4, 6]
    assert sorted(r.doc_id for r in out["simhash_near_dedup"].collect()) == [3, 4, 6]
    assert out["secret_scans"].columns == odd_docs.columns
    assert {r.doc_id for r in out["best_fit_packing"].collect()} == {3, 4, 6}
    for frame in steps(spark, no_docs, sf).values():
        assert frame.count() == 0
