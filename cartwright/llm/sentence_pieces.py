"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Words of equal length advance together, character by character. At each end position
the substrings that end there are looked up by a rolling hash in the sorted hashes of
all pieces, and a vectorised maximum over them stores the last piece and where it began.

A unigram vocabulary asks for the largest sum of scores. A merge (BPE) vocabulary asks
for the one segmentation that its merges make; that is the only path on which every two
adjacent pieces are left apart by the merges of those two alone, so steps to a piece
that would merge with the one before it are closed. The pair rule is remembered.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.tables import pieces

BLANK = "▁"
#: Model kinds and piece kinds of the file format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: An unknown character scores this much less than the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words whose ids a worker remembers; the half used least lately is dropped.
WORDS_REMEMBERED = 900_000
#: Slots of the table of remembered pairs; a pair that needs a taken slot replaces the other.
PAIR_SLOT_BITS = 21
#: Bits of a hash that tell whether any piece may have it.
FILTER_BITS = 20
#: With more characters that pieces join to a mark, words keep their marks in every text.
ODD_CHARACTERS = 8
#: Longer words are encoded each time.
WORD_LENGTH = 64
#: Words advanced together.
TOGETHER = 20_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Vocabulary of a model file, with the tables for encoding and decoding."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        self.kind = model.trainer_spec.model_type
        normal = model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("only models without normalisation are supported")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.prefix = " " if normal.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes_of = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.spelled = [self._spelled(p) for p in model.pieces]
        texts = list(self.ids)
        self.longest = max(map(len, texts))
        codes = np.zeros((len(texts), self.longest), np.uint32)
        for row, text in zip(codes, texts):
            row[: len(text)] = [ord(c) for c in text]
        hashes = self._hash(codes, np.array([len(t) for t in texts]))
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], codes[order]
        self.numbers = np.array([self.ids[t] for t in texts], np.int64)[order]
        self.score_of = np.array([p.score for p in model.pieces])
        self.unknown_score = min(self.scores.values()) - UNKNOWN_PENALTY
        self._unit_patterns(texts)
        self.text_of = {i: t for t, i in self.ids.items()}
        self.lengths = (self.codes != 0).sum(axis=1)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True
        self.pair_keys = np.full(1 << PAIR_SLOT_BITS, -1, np.int64)
        self.pair_apart = np.zeros(1 << PAIR_SLOT_BITS, bool)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _spelled(self, piece) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        if piece.type == CONTROL:
            return b""
        return " ⁇ ".encode() if piece.type == UNKNOWN else piece.piece.encode()

    def _unit_patterns(self, texts: list[str]) -> None:
        """Parts of a text that no piece crosses, as patterns over the text with plain blanks.

        ``coarse`` ends a part before a blank and at a line feed, as far as the vocabulary
        allows these cuts. ``fine`` ends it also where a mark follows a letter or digit; a
        text with one of the characters in ``odd``, which pieces join to a mark, is cut by
        ``coarse``.
        """
        if any(BLANK in t.lstrip(BLANK) for t in texts):
            self.coarse, self.fine, self.odd = re.compile(r"(?s:.+)"), None, ()
            return
        feed = "" if any("\n" in t for t in texts if len(t) > 1) else r"\n"
        alone = r"|\n" if feed else ""
        self.coarse = re.compile(rf" +[^ {feed}]*|[^ {feed}]+{alone}")
        self.fine = re.compile(rf" +[^\w {feed}]*\w*|[^\w {feed}]+\w*|\w+{alone}")
        word = re.compile(r"\w")
        self.odd = {
            a
            for t in texts
            for a, b in zip(t, t[1:])
            if word.match(a) and b != BLANK and not word.match(b)
        }
        if len(self.odd) > ODD_CHARACTERS:
            self.fine = None

    @staticmethod
    def _hash(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        value = np.zeros(len(codes), np.uint64)
        for at in range(codes.shape[1]):
            more = value * FACTOR + codes[:, at] + np.uint64(1)
            value = np.where(at < lengths, more, value)
        return value

    def merged(self, text: str) -> list[str]:
        """The symbols that the merges leave of a text: best score first, then leftmost."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges of each two symbols' texts leave just these two.

        Symbols are piece ids, or ``-1 - code`` of a character that is no piece; a left
        of ``len(spelled)`` stands for the start, where the right must be its own merge.
        """
        keys = ((left + (1 << 21)) << 22) + right + (1 << 21)
        slots = (keys.astype(np.uint64) * FACTOR >> np.uint64(64 - PAIR_SLOT_BITS)).astype(np.int64)
        known = self.pair_keys[slots] == keys
        out = self.pair_apart[slots]
        missing: dict[int, bool] = {}
        for at in np.nonzero(~known)[0].tolist():
            key = int(keys[at])
            if key not in missing:
                parts = [
                    self._text(int(s)) for s in (left[at], right[at]) if s != len(self.spelled)
                ]
                missing[key] = self.merged("".join(parts)) == parts
                self.pair_keys[slots[at]], self.pair_apart[slots[at]] = key, missing[key]
            out[at] = missing[key]
        return out

    def _text(self, symbol: int) -> str:
        return chr(-1 - symbol) if symbol < 0 else self.text_of[symbol]

    def _pieces_at(self, hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose substring is a piece, and its id; spellings are compared."""
        rows = np.nonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])[0]
        if not len(rows):
            return rows, rows
        at = np.minimum(np.searchsorted(self.hashes, hashes[rows]), len(self.hashes) - 1)
        hit = (self.hashes[at] == hashes[rows]) & (self.lengths[at] == codes.shape[1])
        rows, at = rows[hit], at[hit]
        same = (self.codes[at, : codes.shape[1]] == codes[rows]).all(axis=1)
        return rows[same], self.numbers[at[same]]

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of one length, word after word, and their number in each.

        Blanks are spelled as the vocabulary does. A word whose end no path reaches has none.
        """
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes.reshape(n, length)
        prefix = np.zeros((length + 1, n), np.uint64)
        powers = [1]
        for at in range(length):
            prefix[at + 1] = prefix[at] * FACTOR + codes[:, at] + np.uint64(1)
            powers.append(powers[-1] * int(FACTOR) & (1 << 64) - 1)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        last = np.full((length + 1, n), len(self.spelled), np.int64)
        back = np.zeros((length + 1, n), np.int64)
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                begin = end - size
                part = codes[:, begin:end]
                rows, symbol = self._pieces_at(
                    prefix[end] - prefix[begin] * np.uint64(powers[size]), part
                )
                gain = self.score_of[symbol]
                if size == 1 and len(rows) < n:
                    lost = np.setdiff1d(np.arange(n), rows, assume_unique=True)
                    rows = np.concatenate([rows, lost])
                    symbol = np.concatenate([symbol, -1 - part[lost, 0].astype(np.int64)])
                    gain = np.concatenate([gain, np.full(len(lost), self.unknown_score)])
                score = best[begin, rows] + gain
                better = score > best[end, rows]
                if self.kind == BPE:
                    better[better] = self._apart(last[begin, rows[better]], symbol[better])
                rows = rows[better]
                best[end, rows] = score[better]
                last[end, rows] = symbol[better]
                back[end, rows] = size
        return self._paths(last, back)

    @staticmethod
    def _paths(last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the backpointers of all words together, from their ends."""
        length, n = len(last) - 1, last.shape[1]
        symbols = np.zeros((n, length), np.int64)
        used = np.zeros((n, length), bool)
        at, rows = np.full(n, length), np.arange(n)
        for slot in range(length - 1, -1, -1):
            rows = rows[back[at[rows], rows] > 0]
            if not len(rows):
                break
            symbols[rows, slot] = last[at[rows], rows]
            used[rows, slot] = True
            at[rows] -= back[at[rows], rows]
        used[at > 0] = False
        return symbols[used], used.sum(axis=1)

    def _ids(self, symbols: list[int]) -> bytes:
        """Ids as little-endian 32-bit bytes; characters that are no piece fall back to bytes."""
        ids = []
        for symbol in symbols:
            if symbol >= 0:
                ids.append(symbol)
            elif self.bytes_of:
                raw = chr(-1 - symbol).encode("utf-8", "replace")
                ids += [self.bytes_of[byte] for byte in raw]
            else:
                ids.append(self.unknown)
        return np.array(ids, "<i4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        by_length = defaultdict(list)
        for word in words:
            by_length[len(word)].append(word)
        out = {}
        for length, same in by_length.items():
            step = max(1, TOGETHER // max(1, length // 16))
            for start in range(0, len(same), step):
                some = same[start : start + step]
                spelled = [w.replace(" ", BLANK) for w in some]
                symbols, sizes = self.viterbi(spelled)
                ends = np.cumsum(sizes)
                raw = symbols.astype("<i4").tobytes()
                spans = zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist())
                out.update(zip(some, [raw[a:b] for a, b in spans]))
                odd = np.unique(np.searchsorted(ends, np.nonzero(symbols < 0)[0], side="right"))
                for at in odd.tolist():
                    out[some[at]] = self._ids(symbols[ends[at] - sizes[at] : ends[at]].tolist())
                for at in np.nonzero(sizes == 0)[0].tolist():  # a piece that no merges make
                    left = self.merged(spelled[at])
                    out[some[at]] = self._ids([self.ids.get(s, -1 - ord(s[0])) for s in left])
        return out

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        fine = self.fine and not any(c in text for c in self.odd)
        return (self.fine if fine else self.coarse).findall(self.prefix + text.replace(BLANK, " "))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes; none for null and empty texts."""
        known, older = self.words, self.older
        split = [self._split(t) for t in texts]
        new: set[str] = set()
        for units in split:
            new.update(set(units).difference(known))
        again = {w: older[w] for w in new if w in older}
        found = self.encode_words(list(new - again.keys()))
        known.update(again)
        known.update(found)
        out = [b"".join([known[w] for w in units]) for units in split]
        for word in found:
            if len(word) > WORD_LENGTH:
                del known[word]
        if len(known) > WORDS_REMEMBERED // 2:
            self.words, self.older = {}, known
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.spelled[i] for i in ids])
        text = raw.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


def encode_pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    model: str | None = None,
) -> DataFrame:
    """One row per row: ``doc_id, ids, ids_crc32`` (of the ids as little-endian 32-bit).

    Null and empty texts have no ids. Whole texts are encoded, however long. Repeated
    rows get equal ids; null ids of documents stay null; an empty table gives no rows.
    """
    path = model or default_model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        vocabulary = model_of(path)
        for batch in pieces(batches, 4096, 8 << 20):
            found = vocabulary.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(ends), ids),
                    pa.array([zlib.crc32(f) for f in found], pa.int64()),
                ],
                names=["doc_id", "ids", "ids_crc32"],
            )

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    return slim.mapInArrow(of, "doc_id long, ids array<int>, ids_crc32 long")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text`` of the rows of ``encode_pieces``; null ids give ''."""
    path = model or default_model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model_of(path)
        for batch in pieces(batches, 1024, 2 << 20):
            texts = [vocabulary.decode(ids or []) for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string())],
                names=["doc_id", "n_ids", "ids_crc32", "text"],
            )

    slim = encoded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "ids_crc32"
    )
    return slim.mapInArrow(of, "doc_id long, n_ids long, ids_crc32 long, text string")
