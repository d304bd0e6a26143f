"""Packing token sequences into bins by swap-based local search."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.tables import pieces
from cartwright.sources.staging import stage

CAPACITY = 2048
END_ID = 0
#: Pieces packed together by one task.
GROUP_PIECES = 16_384
#: Distinct words, and distinct stems, whose ids a worker remembers; the half used least
#: lately is dropped.
WORDS_REMEMBERED = 1_000_000
#: Longer runs without a blank are encoded each time.
WORD_LENGTH = 64
#: How a vocabulary prepares and cuts a text whose words can be looked up on their own.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
CUT_AT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of Latin letters with marks behind them. The vocabulary lower-cases the letters and
#: cuts before the marks, so the two parts can be looked up on their own.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others are numbered from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (byte for byte in range(256) if byte not in plain)
    return {byte: chr(byte) for byte in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Memory:
    """Values of keys met lately: at most ``size``, in two halves, the older one dropped."""

    def __init__(self, size: int):
        self.size = size
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def settle(self) -> None:
        if len(self.now) > self.size // 2:
            self.now, self.before = {}, self.now


def cuts_words(tokenizer) -> bool:
    """Whether the vocabulary lower-cases, and cuts at white space and before marks.

    Read from its settings, which must be ``NORMALIZERS`` and ``CUT_AT``.
    """
    settings = json.loads(tokenizer.to_str())
    steps = (settings["normalizer"] or {}).get("normalizers", [])
    cuts = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == NORMALIZERS
        and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"].get("Regex") == CUT_AT
        and not cuts[1]["add_prefix_space"]
        and settings["post_processor"] is None
        and settings["model"]["type"] == "BPE"
    )


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, remembered word by word.

    A vocabulary that splits at white space before it merges gives a text the ids of its
    blank-separated parts in a row. Texts of any other vocabulary are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = cuts_words(self.tokenizer)
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        self.words, self.stems = Memory(WORDS_REMEMBERED), Memory(WORDS_REMEMBERED)
        self.marks: dict[str, bytes] = {"": b""}

    def _encode(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _stem(self, stem: str) -> bytes:
        """Ids of lower-case Latin letters: the merges of the vocabulary on their bytes."""
        if not stem.isascii():
            stem = "".join([self.letters[c] for c in stem.encode().decode("latin-1")])
        ids = [token.id for token in self.model.tokenize(stem)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, word: str) -> bytes:
        parts = PLAIN.fullmatch(word)
        if not parts or len(word) > WORD_LENGTH:
            return self._encode(word)
        stem, marks = parts[1].lower(), parts[2]
        stems = self.stems
        ids = stems.now.get(stem)
        if ids is None:
            ids = stems.before.get(stem)
            stems.now[stem] = ids = self._stem(stem) if ids is None else ids
        tail = self.marks.get(marks)
        if tail is None:
            tail = self._encode(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = tail
        return ids + tail

    def of(self, text: str | None) -> bytes:
        if not self.by_word:
            return self._encode(text or "")
        words = text.replace("\n", " ").split(" ") if text else []
        now, before = self.words.now, self.words.before
        long = []
        for word in set(words).difference(now):
            ids = before.get(word)
            now[word] = self._new(word) if ids is None else ids
            if len(word) > WORD_LENGTH:
                long.append(word)
        out = b"".join([now[w] for w in words])
        for word in long:
            del now[word]
        self.words.settle()
        self.stems.settle()
        return out


def token_pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece of a document's ids, with its place in the input (``part, at``)."""
    path = vocabulary or default_vocabulary()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        end = np.array([END_ID], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = words.of(text) + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, piece, start, len(own) // 4, zlib.crc32(own), part, at))
                    at += 1
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"],
            )

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    return slim.mapInArrow(of, f"{PIECE}, part long, at long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            to = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[to].append(item)
        else:
            room, to = capacity, len(bins)
            bins.append([item])
        left = room - size
        with_room[left].append(to)
        rooms |= 1 << left
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills.

    The emptiest bin gives: a document moves to a bin with room, or a document or two
    change places with one shorter document of another bin. Every exchange shifts
    tokens from the emptier to the fuller bin, so the squared fills grow and the search
    ends. The exchange that leaves the other bin fullest is taken. A bin that can give
    no more and is not empty is settled, and the next emptiest gives.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([lengths[b].sum() for b in bins], np.int64)
        self.bin_of = np.empty(len(lengths), np.int64)
        for number, items in enumerate(self.bins):
            self.bin_of[items] = number
        self.closed = self.fill >= capacity

    def run(self) -> list[list[int]]:
        fewest = -(-int(self.lengths.sum()) // self.capacity)
        used = int((self.fill > 0).sum())
        while used > fewest:
            open_bins = np.nonzero(~self.closed & (self.fill > 0))[0]
            if len(open_bins) < 2:
                break
            giver = int(open_bins[np.argmin(self.fill[open_bins])])
            while self.fill[giver] and self._give(giver):
                pass
            used -= not self.fill[giver]
            self.closed[giver] = True
        return [b for b in self.bins if b]

    def _give(self, giver: int) -> bool:
        room = self.capacity - self.fill
        takers = ~self.closed & (self.fill >= self.fill[giver]) & (room > 0)
        takers[giver] = False
        if not takers.any():
            return False
        sizes = self._sizes(giver)
        given = np.array(list(sizes), np.int64)
        best = (0, None)
        fitting = [size for size, items in sizes.items() if len(items) == 1 and size <= room[takers].max()]
        if fitting:
            size = max(fitting)
            left = np.where(takers & (room >= size), room - size, self.capacity)
            best = (size, (sizes[size], None, int(left.argmin())))
        others = np.nonzero(takers[self.bin_of])[0]
        lengths = self.lengths[others]
        # for each length the largest size that can take its place, then over all shorter ones
        reach = np.zeros(self.capacity + 1, np.int64)
        np.maximum.at(reach, lengths, lengths + room[self.bin_of[others]])
        upto = np.maximum.accumulate(reach)
        shortest = np.searchsorted(upto, given)
        gain = np.where(shortest < given, given - shortest, 0)
        if gain.max() > best[0]:
            at = int(gain.argmax())
            enough = lengths + room[self.bin_of[others]] >= given[at]
            other = int(others[np.nonzero((lengths == shortest[at]) & enough)[0][0]])
            best = (int(gain[at]), (sizes[int(given[at])], other, int(self.bin_of[other])))
        if best[1] is None:
            return False
        self._exchange(giver, *best[1])
        return True

    def _sizes(self, giver: int) -> dict[int, tuple]:
        """Every size that a document or two of the bin have together, one choice for each.

        Equal lengths are alike, and a bin holds at most 63 lengths, so all pairs are covered.
        """
        by_length: dict[int, list[int]] = {}
        for item in self.bins[giver]:
            by_length.setdefault(int(self.lengths[item]), []).append(item)
        sizes: dict[int, tuple] = {size: (items[0],) for size, items in by_length.items()}
        ordered = sorted(by_length)
        for n, small in enumerate(ordered):
            for large in ordered[n:]:
                two = (by_length[small] + by_length[large])[:1] + by_length[large][-1:]
                if two[0] != two[1]:
                    sizes.setdefault(small + large, tuple(two))
        return sizes

    def _exchange(self, giver: int, given: tuple, other: int | None, taker: int) -> None:
        for item in given:
            self.bins[giver].remove(item)
            self.bins[taker].append(item)
            self.bin_of[item] = taker
        moved = int(self.lengths[list(given)].sum())
        if other is not None:
            self.bins[taker].remove(other)
            self.bins[giver].append(other)
            self.bin_of[other] = giver
            moved -= int(self.lengths[other])
        self.fill[giver] -= moved
        self.fill[taker] += moved
        self.closed[taker] = self.fill[taker] >= self.capacity


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: a best fit, improved by local search."""
    return LocalSearch(best_fit(lengths, capacity), lengths, capacity).run()


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is the ids of its text and the end id; null and empty texts are the end
    id alone. Only a document of more than ``capacity`` ids is cut, into pieces of
    ``capacity`` and a shorter last one. Repeated rows are packed as documents of their
    own; null ids stay null; an empty table gives no rows. The pieces are written once
    and dealt by a hash of their place in that table to groups of about
    ``group_pieces``, each packed by one task; a group wastes less than one sequence
    beyond what its search leaves.
    """
    cut = stage(token_pieces(docs, id_column, text_column, vocabulary, capacity), "pieces")
    groups = max(1, round(cut.count() / group_pieces))

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "at"], ignore_index=True)
        bins = pack_lengths(rows["length"].to_numpy(), capacity)
        order = np.concatenate([np.array(b) for b in bins])
        sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = rows.iloc[order].drop(columns=["part", "at", "deal"])
        out["sequence_id"] = int(key[0]) * (1 << 32) + sequence
        before = out["length"].cumsum() - out["length"]
        out["offset"] = before - before.groupby(out["sequence_id"]).transform("min")
        return out

    dealt = cut.withColumn("deal", F.pmod(F.xxhash64("part", "at"), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(of, f"{PIECE}, sequence_id long, offset long")
