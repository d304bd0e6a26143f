"""Secret scans: fixed formats, and formats inferred from the credentials they label."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright.llm.automata import Automaton
from cartwright.llm.tables import pieces
from cartwright.sources.staging import stage

#: The kinds in their order, their patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Every assignment holds one of these, in either case.
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Runs whose format is scored: all of the least labelled length and more.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{ASSIGN_LENGTH},}}={{0,2}}", re.ASCII)
DIGIT = re.compile(r"[0-9]")
#: Ordinary runs are learned in two kinds, since numbers would be lost among the words.
ORDINARY = ("word", "number")
#: Verdicts on formats that a task remembers.
REMEMBERED = 100_000
#: Labelled values of a kind, and ordinary runs of one, that are learned from; all documents are searched for them.
SAMPLE_LABELLED = 400
SAMPLE_OTHER = 1500
#: Fewer labelled values of a kind than this teach nothing.
LEAST_LABELLED = 10
#: Log odds by which a learned format must beat ordinary runs: a million to one.
LOG_ODDS = 13.8
MASK = "[SECRET]"

CLASSES = str.maketrans(
    "0123456789" + "abcdef" + "ghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0" * 10 + "a" * 6 + "g" * 20 + "A" * 26,
)

#: A format's symbols, ``0agA+/_-=`` and the end, each equally likely when nothing was learned of a run.
SYMBOLS = 10

Span = tuple[int, int, str]


def base_spans(text: str | None) -> list[Span]:
    """Spans ``(start, end, kind)`` of the fixed formats, by start and then kind.

    Kinds are searched on their own, so spans of two kinds may overlap.
    """
    if not text:
        return []
    found = []
    if KEYWORDS.search(text):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
                found.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def beside(text: str, taken: list[Span]) -> str:
    """The text with the spans of ``taken`` as blanks; what is left keeps its place."""
    for start, end, _ in taken:
        text = text[:start] + " " * (end - start) + text[end:]
    return text


def format_of(run: str) -> str:
    """The run with digits, a-f, other lower-case and upper-case letters as one symbol each."""
    return run.translate(CLASSES)


@dataclass
class Formats:
    """Automata of the labelled kinds and of ordinary runs."""

    kinds: list[Automaton] = field(default_factory=list)
    ordinary: list[Automaton] = field(default_factory=list)
    verdicts: dict[str, bool] = field(default_factory=dict)

    def odds(self, shape: str) -> float:
        """Log odds of the likeliest labelled kind against the likeliest other account of the run.

        That is an ordinary kind, or any symbols at all: a run that no automaton knows, or
        that is too short to tell, is no secret.
        """
        secret = max(k.log_likelihood(shape) for k in self.kinds)
        anything = -(len(shape) + 1) * math.log(SYMBOLS)
        return secret - max(anything, *(o.log_likelihood(shape) for o in self.ordinary))

    def is_secret(self, run: str) -> bool:
        if not self.kinds:
            return False
        shape = format_of(run)
        known = self.verdicts.get(shape)
        if known is None:
            if len(self.verdicts) >= REMEMBERED:
                self.verdicts.clear()
            known = self.odds(shape) >= LOG_ODDS
            if len(shape) <= 64:
                self.verdicts[shape] = known
        return known


def _labelled(text: str | None) -> Iterator[tuple[str, str]]:
    """Credential values by kind, and the distinct other runs, of one text."""
    if not text:
        return
    spans = base_spans(text)
    for start, end, kind in spans:
        found = text[start:end]
        yield kind, ASSIGN.match(found)[2] if kind == "assign" else found
    for run in set(CANDIDATE.findall(beside(text, spans))):
        yield "number" if DIGIT.search(run) else "word", run


def _draw(run: str) -> bytes:
    return blake2b(run.encode("utf-8", "surrogatepass"), digest_size=8).digest()


class Least:
    """The distinct values with the least hash among all that were added."""

    def __init__(self, limit: int) -> None:
        self.limit, self.found, self.bar = limit, {}, b"\xff" * 9

    def add(self, run: str) -> None:
        draw = _draw(run)
        if draw <= self.bar:
            self.found[run] = draw
            if len(self.found) >= 2 * self.limit:
                self.found = dict(self.least())
                self.bar = max(self.found.values())

    def least(self) -> list[tuple[str, bytes]]:
        return sorted(self.found.items(), key=lambda x: (x[1], x[0]))[: self.limit]


def fit_formats(docs: DataFrame, text_column: str = "text") -> Formats:
    """Learn one automaton per fixed kind, and two of ordinary runs, from the values of all documents.

    Of all distinct values of a kind the ``SAMPLE_LABELLED`` with the least hash are
    learned from, of ordinary runs without and with a digit ``SAMPLE_OTHER`` each; a kind with
    fewer than ``LEAST_LABELLED`` values in all documents teaches nothing. Each task keeps no more
    than twice as many, so neither tasks nor driver grow with the input.
    """
    limits = dict.fromkeys(("assign", "access", "hex"), SAMPLE_LABELLED)
    limits |= dict.fromkeys(ORDINARY, SAMPLE_OTHER)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {kind: Least(limit) for kind, limit in limits.items()}
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                for kind, run in _labelled(text):
                    least[kind].add(run)
        rows = [(kind, run, draw) for kind, kept in least.items() for run, draw in kept.least()]
        kinds, runs, draws = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(runs, pa.string()), pa.array(draws, pa.binary())],
            names=["kind", "run", "draw"],
        )

    found = docs.select(F.col(text_column).alias("text")).mapInArrow(
        of, "kind string, run string, draw binary"
    )
    runs = stage(found.distinct(), "runs")
    learned = {}
    for kind, limit in limits.items():
        rows = runs.where(F.col("kind") == kind).orderBy("draw", "run").limit(limit)
        learned[kind] = [format_of(r["run"]) for r in rows.select("run").collect()]
    ordinary = [Automaton(learned.pop(kind) or [""]).merge() for kind in ORDINARY]
    kinds = [Automaton(v).merge() for v in learned.values() if len(v) >= LEAST_LABELLED]
    return Formats(kinds, ordinary)


def find_spans(text: str | None, formats: Formats) -> tuple[list[Span], list[Span]]:
    """The spans of the fixed formats, and all spans, each by start and then kind."""
    base = base_spans(text)
    rest = beside(text or "", base)
    added = []
    if any(map(formats.is_secret, set(CANDIDATE.findall(rest)))):
        runs = CANDIDATE.finditer(rest)
        added = [(*m.span(), "format") for m in runs if formats.is_secret(m[0])]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


SPANS = "array<struct<kind string, start long, end long>>"


def scan_secrets(
    docs: DataFrame, formats: Formats, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row: ``doc_id, base, spans``, arrays of (kind, start, end) in code points.

    A null or empty text has no spans. Repeated rows get equal spans; null ids stay
    null; an empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        )
        for batch in pieces(batches):
            found = [find_spans(t, shared.value) for t in batch.column(1).to_pylist()]
            columns = [
                pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in side], kind)
                for side in zip(*found)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["doc_id", "base", "spans"]
            )

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    return slim.mapInArrow(of, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every run of overlapping or touching spans as one mask."""
    if not spans:
        return text
    merged: list[list[int]] = []
    for start, end, _ in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    kept = zip([0, *(end for _, end in merged)], [*(start for start, _ in merged), len(text)])
    return MASK.join(text[start:end] for start, end in kept)


def redact_secrets(
    docs: DataFrame, formats: Formats, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with each secret of the text replaced by a mask; all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = batch.column(0)
            place = rows.type.get_field_index(text_column)
            texts = rows.field(place).to_pylist()
            clean = [redact(t, find_spans(t, shared.value)[1]) for t in texts]
            columns = rows.flatten()
            columns[place] = pa.array(clean, rows.type.field(place).type)
            masked = pa.StructArray.from_arrays(columns, fields=list(rows.type))
            yield pa.RecordBatch.from_arrays([masked], names=["row"])

    schema = T.StructType().add("row", docs.schema)
    return docs.select(F.struct("*").alias("row")).mapInArrow(of, schema).select("row.*")
