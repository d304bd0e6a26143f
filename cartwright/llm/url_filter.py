"""URL filters: all glob rules at once, by a bit-parallel automaton over many URLs.

A glob is a sequence of literal bytes with ``*`` (any bytes but ``/``) and ``**`` (any
bytes) between them. Every glob owns one start bit and one bit per literal byte in a
multiword mask. One Shift-And step moves all globs of all URLs of a batch by one byte:
a bit moves on where its literal fits, and stays where a star after it allows the byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.tables import pieces

#: Verdict and place (host and start of path) of each rule; a rule holds on subdomains.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Globs over ``.host/path`` that block a URL which no rule fits.
BLOCKED = (
    "*spam-**",
    "*-pills.**",
    "*casino**",
    "**/ads/**",
    "**/login/**",
    "**.exe",
    "**.zip",
)

#: Bytes of one padded URL matrix, of the states of its URLs, and of the verdicts of all globs on a
#: batch; a single URL may take more.
MATRIX = 8 << 20
#: URLs of a batch, at most.
BATCH = 20_000

SCHEME = re.compile(r"://([^/?#]*)([^?#]*)")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://`` or for null."""
    found = SCHEME.search(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


class GlobAutomaton:
    """Masks of a list of globs, and their simulation on many byte strings at once."""

    def __init__(self, globs: Sequence[str]):
        width = 0
        starts, finals, steps, loops = [], [], [], []
        for glob in globs:
            starts.append(width)
            for part in re.findall(rb"\*+|[^*]", glob.encode()):
                if part.startswith(b"*"):
                    loops.append((width, len(part) > 1))
                else:
                    width += 1
                    steps.append((width, part[0]))
            finals.append(width)
            width += 1
        self.words = max(1, -(-width // 64))
        self.start = self._row(starts)
        self.finals = finals
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for bit, byte in steps:
            self.move[byte, bit // 64] |= np.uint64(1 << bit % 64)
        for bit, crosses in loops:
            self.stay[:, bit // 64] |= np.uint64(1 << bit % 64)
            if not crosses:
                self.stay[ord("/"), bit // 64] &= ~np.uint64(1 << bit % 64)

    def batch(self) -> int:
        """URLs whose verdicts fit in a matrix."""
        return max(1, min(BATCH, MATRIX // max(1, len(self.finals))))

    def _row(self, bits: list[int]) -> np.ndarray:
        row = np.zeros(self.words, np.uint64)
        for bit in bits:
            row[bit // 64] |= np.uint64(1 << bit % 64)
        return row

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """``len(texts)`` x globs: whether the glob fits the whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros((len(texts), len(self.finals)), bool)
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            some = order[at : at + max(1, MATRIX // max(longest, 8 * self.words))]
            out[some] = self._run([texts[i] for i in some], lengths[some])
            at += len(some)
        return out

    def _run(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """``texts`` by falling length."""
        longest = int(lengths[0])
        chars = np.frombuffer(b"".join(t.ljust(longest, b"\0") for t in texts), np.uint8)
        chars = chars.reshape(len(texts), longest)
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        for place in range(longest):
            n = active[place]
            now, byte = state[:n], chars[:n, place]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (shifted & self.move[byte]) | (now & self.stay[byte])
        bits = np.array(self.finals, np.int64)
        ends = state[:, bits // 64] >> (bits % 64).astype(np.uint64)
        return (ends & np.uint64(1)).astype(bool)


def judge_urls(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    blocked: Sequence[str] = BLOCKED,
) -> DataFrame:
    """One row per row: ``page_id, host, path, rule, verdict``.

    The longest fitting rule decides; without one, a URL that a glob of ``blocked``
    fits is blocked and any other allowed. A null, empty or scheme-less URL has empty
    host and path, fits no rule and is allowed. Repeated rows and null ids stay as
    they are; an empty table gives no rows. Other columns are not read.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    automaton = GlobAutomaton([f"*.{place}**" for _, place in ranked] + list(blocked))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, automaton.batch()):
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            fits = automaton.matches([f".{h}{p}".encode() for h, p in parts])
            by_rule, by_glob = fits[:, : len(ranked)], fits[:, len(ranked) :].any(axis=1)
            first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1)
            rule = [ranked[i][1] if i >= 0 else None for i in first]
            verdict = [
                ranked[i][0] if i >= 0 else "block" if bad else "allow"
                for i, bad in zip(first, by_glob)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array(rule, pa.string()),
                    pa.array(verdict, pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    slim = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"))
    return slim.mapInArrow(
        of, "page_id long, host string, path string, rule string, verdict string"
    )


def _pattern(glob: str) -> str:
    """The glob as a regular expression, for the SQL statement."""
    parts = re.findall(r"\*+|[^*]+", glob)
    return "".join(
        "(?s:.*)" if p.startswith("**") else "[^/]*" if p == "*" else re.escape(p) for p in parts
    )


def statement() -> str:
    """DuckDB: one case branch per rule, longest first, then the globs."""
    ranked = sorted(RULES, key=lambda r: -len(r[1]))
    fits = {
        place: f"ends_with('.' || host, '.{place[: place.index('/')]}')"
        f" AND starts_with(path, '{place[place.index('/') :]}')"
        for _, place in ranked
    }
    rule = " ".join(f"WHEN {fits[place]} THEN '{place}'" for _, place in ranked)
    verdict = " ".join(f"WHEN {fits[place]} THEN '{what}'" for what, place in ranked)
    bad = " OR ".join(f"regexp_full_match('.' || host || path, '{_pattern(g)}')" for g in BLOCKED)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH cut AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0
            THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
          SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
        SELECT page_id, host, path, CASE {rule} END AS rule,
          CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict
        FROM parts"""
