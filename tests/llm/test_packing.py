import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cartwright.llm.packing import LocalSearch, WordIds, best_fit, pack, pack_lengths
from cartwright.llm.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=None)
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    rng = random.Random(4)
    texts = [None, "", " ", "a", "It's  we'LL\tthey're\n\n12 x y z", "é ́x ΑΣ ς İ"]
    texts += ["<|endoftext|> a<|startoftext|>b", "x" * 300, "a\x1cb\x85c", "ﬁ Å ½"]
    pool = "aB cé\n\t1'.,-́ 　Σß<|>😀"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    words = WordIds(PATH)
    for text in texts:
        assert np.frombuffer(words.of(text), "<u4").tolist() == ids_of(text), repr(text)


def test_other_vocabularies_are_not_cut_into_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert WordIds(PATH).by_word and not WordIds(path).by_word
    plain, words = Tokenizer.from_file(path), WordIds(path)
    for text in (None, "", "It's  We'll\tgo\n\n12 x", "Ünder the Sea, again!", "ſtop " * 50):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(words.of(text), "<u4").tolist() == ids


def check(docs, rows, capacity):
    """Every id stands exactly once, in gapless sequences within the capacity."""
    want = defaultdict(int)
    for doc, text in docs:
        ids = np.array([*ids_of(text), 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want[repr(doc), piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_packs_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = pack(docs).collect()
    used, total = check([(r.doc_id, r.text) for r in docs.collect()], rows, 2048)
    assert used <= -(-total // 2048) + 1


def test_groups_are_packed_on_their_own(spark, sf):
    docs = table(spark, sf, "documents")
    rows = pack(docs, capacity=512, group_pieces=50).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], rows, 512)


def test_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(docs, pack(odd_docs).collect(), 2048)
    assert pack(no_docs).count() == 0


def test_search_empties_bins():
    """Bins that only exchanges can merge: one-for-one, two-for-one and a move."""
    for bins, lengths, capacity, fewest in (
        ([[0, 1], [2, 3], [4]], [6, 2, 5, 3, 4], 10, 2),
        ([[0, 1], [2, 3, 4], [5, 6]], [5, 3, 4, 3, 2, 2, 1], 10, 2),
        ([[0], [1]], [4, 5], 10, 1),
    ):
        search = LocalSearch(bins, np.array(lengths), capacity)
        before = (search.fill**2).sum()
        packed = search.run()
        assert len(packed) == fewest
        assert sorted(i for b in packed for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= capacity for b in packed)
        assert (search.fill**2).sum() > before


def test_never_worse_than_best_fit():
    rng = np.random.default_rng(6)
    for top in (100, 400, 700, 1000):
        lengths = rng.integers(1, top, 400)
        start = best_fit(lengths, 1000)
        packed = pack_lengths(lengths, 1000)
        assert -(-lengths.sum() // 1000) <= len(packed) <= len(start)
        assert sorted(i for b in packed for i in b) == list(range(400))


def plain_best(search, giver):
    """The largest gain of any move or exchange of one or two, by trying all."""
    room, best = search.capacity - search.fill, 0
    items = search.bins[giver]
    for n, a in enumerate(items):
        for given in [(a,), *((a, b) for b in items[n + 1 :])]:
            size = int(search.lengths[list(given)].sum())
            for taker, others in enumerate(search.bins):
                if taker == giver or search.closed[taker] or search.fill[taker] < search.fill[giver]:
                    continue
                gains = [size - int(search.lengths[o]) for o in others]
                gains += [size] if len(given) == 1 else []
                best = max([best, *(g for g in gains if 0 < g <= room[taker])])
    return best


def test_every_pair_of_the_giving_bin_is_tried():
    """Many short documents in a bin: the exchange found is the best of all."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = np.concatenate([rng.integers(1, 30, 60), rng.integers(20, 90, 30)])
        order = rng.permutation(90)
        bins = [order[at : at + 15].tolist() for at in range(0, 90, 15)]
        search = LocalSearch(bins, lengths, int(max(lengths[b].sum() for b in bins)) + 40)
        giver = int(np.argmin(search.fill))
        want, before = plain_best(search, giver), int(search.fill[giver])
        assert search._give(giver) == (want > 0)
        assert before - int(search.fill[giver]) == want
        assert sorted(i for b in search.bins for i in b) == list(range(90))
        assert (search.fill == [lengths[b].sum() for b in search.bins]).all()
