import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm import alignment as A
from cartwright.llm.tables import table

NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
ODD = [
    "a  b", " x", "y ", "z\n\n b \n c", "\t q", "▁ k", "a▁b", "<s> hi <|endoftext|> </s> <unk>",
    "日本語 テスト 🙂 x", "a" * 3000, "", None, "x  y   z", "it's 'S 1234 5,6 $$ \r\n  \r é", "ﬁ Å Ａ",
    " x  y z", "w " * 5000 + "end", "<0x41> ▁", "\x00 b", "é é",
]


@pytest.fixture(scope="module")
def known():
    return A.tokenizers_of(*A.default_paths())


def plain(known, text):
    """Counts, digest and links of one text by plain loops over the library's tokens."""
    none = (0, 0, 0, 0, ""), Counter()
    if not text:
        return none
    a, b = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    raw = (" " + text).encode()
    if any(b"".join(spelled[i] for i in ids) != raw for spelled, ids in ((known.bytes_a, a), (known.bytes_b, b))):
        return none
    ends_a, ends_b = (np.cumsum([len(s[i]) for i in ids]).tolist() for s, ids in ((known.bytes_a, a), (known.bytes_b, b)))
    starts_a, starts_b = [0, *ends_a], [0, *ends_b]
    links, first = Counter(), 0
    for i in range(len(a)):
        while ends_b[first] <= starts_a[i]:
            first += 1
        j = first
        while j < len(b) and starts_b[j] < ends_a[i]:
            links[a[i], b[j]] += 1
            j += 1
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        upto = (sum(e <= cut for e in ends_a[i:]), sum(e <= cut for e in ends_b[j:])) if len(a) < 500 else None
        if upto is None:
            upto = (int(np.searchsorted(ends_a, cut, "right")) - i, int(np.searchsorted(ends_b, cut, "right")) - j)
        groups.append(",".join(map(str, a[i : i + upto[0]])) + "|" + ",".join(map(str, b[j : j + upto[1]])))
        i, j = i + upto[0], j + upto[1]
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return (len(a), len(b), len(groups), links.total(), digest), links


def whole(known, rows):
    """All columns of all rows, counts over the corpus included."""
    found = [(doc, *plain(known, text)) for doc, text in rows]
    count, highest = Counter(), defaultdict(int)
    for _, _, links in found:
        count.update(set(links))
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for doc, own, links in found:
        best = sum(n for pair, n in links.items() if count[pair] == highest[pair[0]])
        out.append((doc, *own[:4], best, sum(n * count[pair] for pair, n in links.items()), own[4]))
    return sorted(out, key=repr)


def result(docs):
    found = A.align_tokens(docs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_plain_loops_on_documents(spark, sf, known):
    docs = table(spark, sf, "documents")
    assert result(docs) == whole(known, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts_and_repeats(make_docs, no_docs, known, monkeypatch):
    monkeypatch.setattr(A, "BATCH_ROWS", 7)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[8]), (None, None), (3, "other")]
    docs = make_docs([(i, t, "en") for i, t in rows]).withColumns({c: F.lit("x") for c in ("chunk", "at", "code", "n_a")})
    assert result(docs) == whole(known, rows)
    assert result(no_docs) == []


def test_words_are_encoded_as_whole_texts(known):
    """Remembered words give the ids of the whole text, whatever white space there is."""
    assert known.by_word
    rng = random.Random(9)
    marks = [" ", " ", " ", "\n", "\n\n", " \n", "\n ", "  ", "\t", ", ", ".", "'s ", "é", "日", " ", "1", "$", "\r\n"]
    words = ["the", "Word", "naïve", "ﬁne", "x", "12", "don", "🙂", "ab"]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for text, found in zip(texts, known.encode(texts)):
        a, b = known._ids_a([" " + text])[0], known._ids_b([text])[0]
        want = known._checked([text])[0]
        assert found == want
        assert want is None or (np.frombuffer(want[0], "<i4").tolist(), np.frombuffer(want[1], "<i4").tolist()) == (a, b)


def test_pointers_inside_long_documents_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = [3, 9000, 1, 40, 2500]
    ends_a, ends_b, stops_a, stops_b, start = [], [], [], [], 0
    for size in sizes:
        total = size * 4
        for ends, stops, n in ((ends_a, stops_a, size), (ends_b, stops_b, max(1, size * 4 // 5))):
            cuts = np.sort(rng.choice(np.arange(1, total), n - 1, replace=False)) if n > 1 else np.array([], int)
            ends += (start + np.append(cuts, total)).tolist()
            stops.append(len(ends))
        start += total
    arrays = [np.array(x) for x in (ends_a, ends_b, stops_a, stops_b)]

    def links():
        a, b, last_a, last_b = A.lockstep(*arrays)
        return sorted(zip(a.tolist(), b.tolist())), last_a.tolist(), last_b.tolist()

    several = links()
    assert len(A.lanes(*arrays)[0]) > len(sizes)
    monkeypatch.setattr(A, "LANE", 1 << 30)
    assert links() == several
    starts = [np.concatenate([[0], x[:-1]]) for x in arrays[:2]]
    want = [(i, j) for i in range(300) for j in range(400) if starts[0][i] < ends_b[j] and starts[1][j] < ends_a[i]]
    assert [x for x in several[0] if x[0] < 300] == want


def test_tokens_are_held_for_a_slice_only(known, monkeypatch):
    """Slices change no result; no lockstep sees more tokens than a slice has characters."""
    words = ["alpha", "beta-2", "café", "x", "(see)", "a  b", None, "", "12,5"]
    texts = [
        None if w is None else " ".join([w, "and", words[i % 6]] * (i % 7)) + w
        for i, w in enumerate(words * 40)
    ]
    spelled = [f"{i}{mark}".encode() for i in range(len(known.bytes_a)) for mark in ",|"]
    spelled += [f"{i}{mark}".encode() for i in range(len(known.bytes_b)) for mark in ",;"]
    whole_batch = A._batch(known, spelled, texts)
    seen, merge = [], A.lockstep
    monkeypatch.setattr(A, "SLICE_CHARS", 300)
    monkeypatch.setattr(A, "WORDS_AT_ONCE", 2)
    monkeypatch.setattr(A, "lockstep", lambda *ends: seen.append(len(ends[0])) or merge(*ends))
    sliced = A._batch(known, spelled, texts)
    assert len(seen) > 10 and max(seen) <= 300 + len(texts)
    assert max(seen) < sum(seen) / 10
    for name, values in whole_batch.items():
        assert list(values) == list(sliced[name]), name
    assert A._batch(known, spelled, [])["sha"] == []
    assert A._batch(known, spelled, [None, ""])["sha"] == ["", ""]


def test_new_words_are_encoded_in_groups(known, monkeypatch):
    """The libraries never get all new words of a batch at once."""
    sizes, checked = [], A.Tokenizers._checked
    monkeypatch.setattr(
        A.Tokenizers, "_checked", lambda self, texts: sizes.append(len(texts)) or checked(self, texts)
    )
    monkeypatch.setattr(known, "memory", A.Memory(100_000))
    found = known.encode([" ".join(f"w{i}" for i in range(20_000))])
    assert len(found) == 1 and sum(sizes) == 20_000 and max(sizes) <= 5_000
