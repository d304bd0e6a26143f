"""SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm.tables import pieces

SEED = 42
#: The eight bits of each byte value, least significant first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(
    np.int64
)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64 bits set in over half of the shingles' XXH64, as an unsigned integer.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer
    words than a shingle is one shingle; a text without words, or null, gives zero.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate(
        [np.bincount(lanes[:, lane], minlength=256) @ BITS for lane in range(8)]
    )
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little"), "little")


def text_digest(text_column: str) -> Column:
    """SHA-256 of a text, empty for null."""
    return F.coalesce(F.unhex(F.sha2(F.col(text_column).cast("binary"), 256)), F.lit(b""))


def fingerprints(
    docs: DataFrame, id_column: str, text_column: str, shingle: int, digest: bool = False
) -> DataFrame:
    """One row per document: ``doc_id`` and its fingerprint ``fp`` as a signed long.

    With ``digest``, also the text's SHA-256 as ``digest``.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            rest = batch.columns[2:]
            names = ["doc_id", "fp", "digest"][: 2 + len(rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed), *rest], names=names)

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("binary").alias("text"),
        *([text_digest(text_column).alias("digest")] if digest else []),
    )
    return slim.mapInArrow(of, "doc_id long, fp long" + (", digest binary" if digest else ""))
