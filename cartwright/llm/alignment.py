"""Cross-tokenizer alignment: tokens of two vocabularies linked where their bytes overlap.

A task encodes a slice of a batch with both tokenizers and merges the two rows of byte ends of
all its documents in lockstep: one NumPy state vector holds a pointer into A and one into B for
every document (long documents are cut at common ends and have several), each step emits the
links at the pointers and the cuts where both tokens end, advances the token that ends first,
and drops the documents that are done.

How many documents link a pair of ids is counted over the corpus. A batch leaves one row with
its distinct pairs, in how many of its documents each occurs, and per document the places of
its pairs in that list. So a pair, however frequent, is one row a batch in the shuffles that
add up the counts and bring them back to the batches, never one row a document.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.packing import Memory, byte_letters
from cartwright.llm.sentence_pieces import BLANK
from cartwright.llm.tables import pieces
from cartwright.sources.staging import stage

#: Documents and bytes of text that share one list of pairs.
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
#: Characters of text that are encoded and merged in lockstep at once: a task holds some hundred
#: bytes for each.
SLICE_CHARS = 1 << 20
#: Tokens of A after which a document gets another pointer, and where a common end is looked for.
LANE, LANE_WINDOW = 512, 16
#: Blank-separated words whose ids a worker remembers; the half used least lately is dropped.
WORDS_REMEMBERED = 600_000
#: Longer words are encoded each time.
WORD_LENGTH = 64
#: New words that the libraries encode at once: what they return for a word is kilobytes.
WORDS_AT_ONCE = 4096


class Tokenizers:
    """Ids of texts in both vocabularies, and the bytes of each id.

    Where neither vocabulary joins anything across a single blank, the ids of a text are those
    of its words with a blank before each; words are remembered.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        size_a = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [
            bytes([byte_of[c] for c in entry]) if all(c in byte_of for c in entry) else entry.encode()
            for entry in entries
        ]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.lengths_a = np.array([len(b) for b in self.bytes_a])
        self.lengths_b = np.array([len(b) for b in self.bytes_b])
        self.by_word = self._words_apart(path_a)
        self.memory = Memory(WORDS_REMEMBERED)

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BLANK, " ").encode()

    def _words_apart(self, path_a: str) -> bool:
        """Whether both vocabularies cut before every single blank.

        A: no normaliser, and the usual byte-level split, which starts a part at a blank that
        stands before anything but white space. B: no piece goes on after a blank that follows
        another character, texts are not changed, and one blank is put in front.
        """
        with open(path_a, encoding="utf-8") as file:
            rules = json.load(file)
        before = rules.get("pre_tokenizer") or {}
        apart_a = (
            rules.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
        )
        inside = any(
            BLANK in self.b.id_to_piece(i).lstrip(BLANK) for i in range(self.b.get_piece_size())
        )
        probe = "Å Ａ ① é fiﬁ\n\tx"
        unchanged = self.b.normalize(probe) == (BLANK + probe.replace(" ", BLANK))
        return bool(apart_a and not inside and unchanged)

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def _checked(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each text with a blank before it, or None where the bytes differ from it."""
        out: list[tuple[bytes, bytes] | None] = []
        wanted = [" " + t for t in texts]
        for want, a, b in zip(wanted, self._ids_a(wanted), self._ids_b(texts)):
            raw = want.encode("utf-8", "surrogatepass")
            same = (
                b"".join([self.bytes_a[i] for i in a]) == raw
                and b"".join([self.bytes_b[i] for i in b]) == raw
            )
            out.append((np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if same else None)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Ids as little-endian 32-bit bytes in A and in B; None for texts without tokens."""
        split: list[list[str] | None] = []
        new: set[str] = set()
        now, before = self.memory.now, self.memory.before
        for text in texts:
            plain = (
                self.by_word and text and "  " not in text and BLANK not in text
                and text[0] != " " and text[-1] != " "
            )
            split.append(text.split(" ") if plain else None)
            if plain:
                new.update(set(split[-1]).difference(now))
        fresh = []
        for word in new:
            if word in before:
                now[word] = before[word]
            else:
                fresh.append(word)
        for start in range(0, len(fresh), WORDS_AT_ONCE):
            some = fresh[start : start + WORDS_AT_ONCE]
            now.update(zip(some, self._checked(some)))
        out: list[tuple[bytes, bytes] | None] = []
        for text, words in zip(texts, split):
            found = [now[w] for w in words] if words else None
            if not text:
                out.append(None)
            elif found is None or None in found:
                out += self._checked([text])
            else:
                out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        for word in fresh:
            if len(word) > WORD_LENGTH:
                del now[word]
        self.memory.settle()
        return out


@lru_cache(maxsize=1)
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def lanes(
    ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Stops of the pointers in A and in B: ends of documents, and common ends inside long ones.

    ``ends_*`` are byte ends counted through all documents, ``stops_*`` the tokens up to the
    end of each document. Any common end will do; where none is near, a pointer goes further.
    """
    targets = np.arange(LANE, len(ends_a), LANE)
    near = np.minimum(targets[:, None] + np.arange(LANE_WINDOW), len(ends_a) - 1)
    offsets = ends_a[near]
    there = np.minimum(np.searchsorted(ends_b, offsets), len(ends_b) - 1)
    common = ends_b[there] == offsets
    first = common.argmax(axis=1)
    rows = np.nonzero(common.any(axis=1))[0]
    inner_a, inner_b = near[rows, first[rows]] + 1, there[rows, first[rows]] + 1
    all_a, at = np.unique(np.concatenate([stops_a, inner_a]), return_index=True)
    return all_a, np.concatenate([stops_b, inner_b])[at]


def lockstep(
    ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links as token numbers in A and in B, and which tokens of each end a group.

    Every document must have the same bytes, at least one, in A and in B.
    """
    last_a, last_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    stop, stop_b = lanes(ends_a, ends_b, stops_a, stops_b)
    at_a = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    at_b = np.concatenate([[0], stop_b[:-1]]).astype(np.int64)
    links_a, links_b = [], []
    while len(at_a):
        links_a.append(at_a.astype(np.int32))
        links_b.append(at_b.astype(np.int32))
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        done_a, done_b = end_a <= end_b, end_b <= end_a
        cut = done_a & done_b
        last_a[at_a[cut]] = True
        last_b[at_b[cut]] = True
        at_a, at_b = at_a + done_a, at_b + done_b
        going = at_a < stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    return np.concatenate(links_a), np.concatenate(links_b), last_a, last_b


def group_digests(
    ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray,
    stops_a: np.ndarray, stops_b: np.ndarray, spelled: list[bytes], size_a: int,
) -> list[str]:
    """SHA-256 of each document's groups, written ``a1,a2|b1;a3|b2,b3``.

    ``spelled`` holds each id with the mark behind it: at ``2 * id + (ends a group)``, ids of
    B after the ``size_a`` ids of A.
    """
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto_a = np.nonzero(last_a)[0] + 1
    upto_b = np.concatenate([[0], np.nonzero(last_b)[0] + 1])
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + upto_b[group_a]] = 2 * ids_a + last_a
    codes[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * (size_a + ids_b) + last_b
    ends = (stops_a + stops_b).tolist()
    out = []
    for start, end in zip([0, *ends], ends):
        text = b"".join([spelled[c] for c in codes[start:end].tolist()])
        out.append(hashlib.sha256(text[:-1]).hexdigest())
    return out


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " chunk long, pairs binary, times binary, codes array<long>, docs array<int>"
)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``SLICE_CHARS`` characters; a longer one is a slice."""
    start = size = 0
    for i, text in enumerate(texts):
        more = len(text or "")
        if i > start and size + more > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += more
    if start < len(texts):
        yield start, len(texts)


def _slice(known: Tokenizers, spelled: list[bytes], texts: list[str | None]) -> dict:
    """Counts and digests of each text, and its distinct pairs: ``doc, code, times``, in order."""
    n = len(texts)
    zero = np.zeros(n, np.int64)
    out = {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "sha": [""] * n}
    out |= {"doc": zero[:0], "code": zero[:0], "times": np.zeros(0, "<i4")}
    found = known.encode(texts)
    there = np.array([i for i, f in enumerate(found) if f], np.int64)
    if not len(there):
        return out
    sizes_a = np.array([len(found[i][0]) // 4 for i in there])
    sizes_b = np.array([len(found[i][1]) // 4 for i in there])
    stops_a, stops_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ids_a = np.frombuffer(b"".join([found[i][0] for i in there]), "<i4").astype(np.int64)
    ids_b = np.frombuffer(b"".join([found[i][1] for i in there]), "<i4").astype(np.int64)
    del found
    ends_a, ends_b = np.cumsum(known.lengths_a[ids_a]), np.cumsum(known.lengths_b[ids_b])
    link_a, link_b, last_a, last_b = lockstep(ends_a, ends_b, stops_a, stops_b)
    digests = group_digests(
        ids_a, ids_b, last_a, last_b, stops_a, stops_b, spelled, len(known.bytes_a)
    )
    groups = np.diff(np.cumsum(last_a)[stops_a - 1], prepend=0)
    of_token = np.repeat(np.arange(len(there)), sizes_a)
    size_b = len(known.bytes_b)
    every = len(known.bytes_a) * size_b
    keys = of_token[link_a] * every + ids_a[link_a] * size_b + ids_b[link_b]
    links = np.bincount(of_token[link_a], minlength=len(there))
    del link_a, link_b, ids_a, ids_b, ends_a, ends_b, of_token
    keys.sort()
    first = np.nonzero(np.diff(keys, prepend=-1))[0]
    out["times"] = np.diff(first, append=len(keys)).astype("<i4")
    doc, out["code"] = np.divmod(keys[first], every)
    out["doc"] = there[doc]
    for name, values in (
        ("n_a", sizes_a), ("n_b", sizes_b), ("n_groups", groups), ("n_links", links),
    ):
        out[name] = zero.copy()
        out[name][there] = values
    for i, digest in zip(there.tolist(), digests):
        out["sha"][i] = digest
    return out


def _batch(known: Tokenizers, spelled: list[bytes], texts: list[str | None]) -> dict:
    """Counts, digests and pairs of each text, and the list of all pairs of the batch.

    Tokens and links are held for a slice of the texts, distinct pairs only for the batch.
    """
    bounds = list(_slices(texts)) or [(0, 0)]
    parts = [_slice(known, spelled, texts[start:end]) for start, end in bounds]
    out = {
        name: np.concatenate([part[name] for part in parts])
        for name in ("n_a", "n_b", "n_groups", "n_links")
    }
    out["sha"] = [digest for part in parts for digest in part["sha"]]
    doc = np.concatenate([part["doc"] + start for part, (start, _) in zip(parts, bounds)])
    times = np.concatenate([part["times"] for part in parts])
    keys = np.concatenate([part["code"] for part in parts])
    del parts
    codes = np.unique(keys)
    places = np.searchsorted(codes, keys).astype("<i4")
    ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
    spans = list(zip([0, *ends], ends))
    out["pairs"] = [places[start:end].tobytes() for start, end in spans]
    out["times"] = [times[start:end].tobytes() for start, end in spans]
    out["codes"], out["docs"] = codes, np.bincount(places, minlength=len(codes)).astype(np.int32)
    return out


def align_texts(
    docs: DataFrame, id_column: str, text_column: str, paths: tuple[str, str]
) -> DataFrame:
    """One row per text, and one per batch with its pairs (``codes``) and their documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizers_of(*paths)
        spelled = [f"{i}{mark}".encode() for i in range(len(known.bytes_a)) for mark in ",|"]
        spelled += [f"{i}{mark}".encode() for i in range(len(known.bytes_b)) for mark in ",;"]
        chunk = TaskContext.get().partitionId() << 32
        types = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.binary(), pa.binary()]
        types += [pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [f.split()[0] for f in ALIGNED.split(", ")]
        for batch in pieces(batches, BATCH_ROWS, BATCH_BYTES):
            made = _batch(known, spelled, batch.column(1).to_pylist())
            n = batch.num_rows
            none = [None] * n
            rows = [
                batch.column(0), made["n_a"], made["n_b"], made["n_groups"], made["n_links"],
                made["sha"], [chunk] * n, made["pairs"], made["times"], none, none,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
            if len(made["codes"]):
                row = [[None]] * 6 + [[chunk], [None], [None], [made["codes"]], [made["docs"]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names)
            chunk += 1

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    return slim.mapInArrow(of, ALIGNED)


def pair_counts(listed: DataFrame, size_b: int) -> DataFrame:
    """``code, count, best``: documents that link a pair, and whether its A id has no higher."""
    counts = stage(listed.groupBy("code").agg(F.sum("docs").alias("count")), "alignment-counts")
    first = F.expr(f"code div {size_b}").alias("a")
    highest = counts.groupBy(first).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", F.expr(f"code div {size_b}")).join(highest, "a").select(
        "code", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def align_tokens(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no
    tokens: zeros and an empty digest. Each row is a document, so repeated rows count each;
    null ids are carried. Whole texts are encoded. An empty table gives no rows.
    """
    path_a, path_b = paths or default_paths()
    aligned = stage(align_texts(docs, id_column, text_column, (path_a, path_b)), "alignment")
    size_b = tokenizers_of(path_a, path_b).b.get_piece_size()
    texts = aligned.where("codes IS NULL").drop("codes", "docs")
    listed = aligned.where("codes IS NOT NULL").select(
        "chunk", F.posexplode(F.arrays_zip("codes", "docs")).alias("at", "pair")
    )
    listed = listed.select(
        "chunk", "at", F.col("pair.codes").alias("code"), F.col("pair.docs").alias("docs")
    )
    scored = listed.drop("docs").join(pair_counts(listed, size_b), "code")
    scored = scored.select(
        F.col("chunk").alias("of"), "at", (F.col("count") * 2 + F.col("best").cast("long")).alias("scored")
    )

    def sums(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        """Adds each document's counts, from the list of its batch in the order of places."""
        value = np.zeros(pairs.num_rows, np.int64)
        value[pairs["at"].to_numpy()] = pairs["scored"].to_numpy()
        raw = [texts[name].to_pylist() for name in ("pairs", "times")]
        ends = np.cumsum([0, *(len(p) // 4 for p in raw[0])])
        at, times = (np.frombuffer(b"".join(parts), "<i4") for parts in raw)

        def total(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values * times)])[ends])

        n_best, count_sum = total(value[at] & 1), total(value[at] >> 1)
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        columns = [texts[c] for c in kept] + [pa.array(n_best), pa.array(count_sum)]
        return pa.Table.from_arrays(
            [*columns, texts["groups_sha256"]], [*kept, "n_best", "count_sum", "groups_sha256"]
        )

    return texts.groupBy("chunk").cogroup(scored.groupBy("of")).applyInArrow(
        sums,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long,"
        " count_sum long, groups_sha256 string",
    )
