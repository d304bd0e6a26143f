import numpy as np
import xxhash

from cartwright.llm.components import components
from cartwright.llm.near_duplicates import links, near_duplicates, one_of_each
from cartwright.llm.simhash import fingerprint
from cartwright.llm.tables import table


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_counts_bits():
    for text in (None, "", " \t\n", "One", "one two", "a b c", "A  b\tc d\ve", "é ß ж " * 50):
        assert fingerprint(text.encode() if text else None) == plain_fingerprint(text)


def brute_force(rows):
    """Least id reachable for each row."""
    fp = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((repr(rows[i][0]), fp[i], least.get(find(i))) for i in range(len(rows)))


def as_rows(frame):
    return sorted((repr(r.doc_id), r.fp % (1 << 64), r.component_id) for r in frame.collect())


def test_equals_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_rows(near_duplicates(docs)) == brute_force(rows)


def test_links_at_every_distance(spark):
    """Random fingerprints with neighbours at 1 to 4 changed bits; only 3 or fewer link."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    points = set(base.tolist()) | {0, -1}
    for value in base:
        for n in (1, 2, 3, 4):
            flips = rng.choice(64, n, replace=False)
            points.add(int(value ^ np.bitwise_xor.reduce(np.int64(1) << flips.astype(np.int64))))
    points = sorted(points)
    for distance in (1, 2, 3, 5):
        want = {
            (a, b)
            for i, a in enumerate(points)
            for b in points[i + 1 :]
            if bin((a ^ b) % (1 << 64)).count("1") <= distance
        }
        frame = spark.createDataFrame([(p,) for p in points], "fp long")
        found = {tuple(sorted(r)) for r in links(frame, distance).collect()}
        assert found == want, distance


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    found = components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()
    assert {tuple(r) for r in found} == {(i, 1) for i in range(2, 61)} | {(101, 100)}


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_rows(near_duplicates(odd_docs)) == brute_force(rows)
    assert near_duplicates(no_docs).count() == 0
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert one_of_each(no_docs).count() == 0


def test_null_ids_alone_keep_one(make_docs):
    kept = one_of_each(make_docs([(None, "a b c d", "en"), (None, "a b c d", "en")])).collect()
    assert len(kept) == 1 and kept[0].doc_id is None


def test_rows_of_other_groups_never_matter(make_docs):
    """Null and repeated ids on unrelated texts: each group keeps exactly one row, its own."""
    rng = np.random.default_rng(9)

    def text():
        return " ".join(f"w{n}" for n in rng.integers(0, 10**6, 60))

    rows = [(None, text(), "en") for _ in range(20)] + [(7, text(), "en") for _ in range(20)]
    rows += [(7, rows[0][1], "en"), (3, rows[1][1], "en"), (3, rows[25][1], "fr"), (3, rows[25][1], "en")]
    rows += [(None, rows[2][1], "en"), (7, rows[30][1], "en"), (9, rows[30][1], "en")]
    want = {}
    for doc, words, lang in rows:
        rank = (doc is None, doc or 0, lang)
        want[words] = min(want.get(words, rank), rank)
    kept = one_of_each(make_docs(rows)).collect()
    found = {r.text: (r.doc_id is None, r.doc_id or 0, r.lang) for r in kept}
    assert len(kept) == 40 and found == want


def test_least_text_of_a_shared_id(make_docs):
    """Equal words with other white space are one group; the least text stays."""
    rows = [(None, "a b  c d", "en"), (None, "a b c d", "en"), (None, "a  b c d", "en"), (None, None, "en")]
    kept = sorted(repr(r.text) for r in one_of_each(make_docs(rows)).collect())
    assert kept == ["'a  b c d'", "None"]
