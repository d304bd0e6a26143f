"""Hard negatives by coordinate pruning in length buckets (after LEMP).

Rows are dealt once to blocks: by length class, then by a hash of the id, at most about
``BLOCK_ROWS`` in one. A block holds its vectors at unit length and, for each coordinate, the
list of its values in order. Anchors are sent to the blocks; a block reads its rows first and
then streams the anchors through. Rows are never copied to anchors.

For an anchor, wanted are the best rows whose score lies in a band. A sample of the block
gives a score that enough rows reach. With the lengths of the class it bounds the angle to
the anchor, and so, for each of the anchor's focus coordinates (its largest), the values a
feasible row can have there. The ranges are looked up in the sorted lists, the shortest
list's rows are the candidates, the others strike out. What is left is verified exactly.

Two searches run: the best rows of the anchor's label, then, for the bands that their scores
open, the best rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.llm.vectors import finite_vectors
from cartwright.sources.staging import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative scores between these hundredths of the positive's score.
BAND = (30, 90)
#: Rows of a block; 64 coordinates of a block take about 70 MB.
BLOCK_ROWS = 65_536
#: Longest to shortest vector of a length class.
CLASS_RATIO = 1.25
#: Focus coordinates of an anchor.
FOCUS = 6
#: Rows of a block that are measured first, for a score that is reached.
SEEDS = 256
#: What rounding may shift a unit vector's value by, many times over.
SLACK = 1e-6


def integer_vectors(
    rows: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = SCALE
) -> DataFrame:
    """``id, label, vector`` (longs) and ``square``, the squared length: one row an id.

    Left out are null ids and labels, vectors as in ``finite_vectors`` (zero vectors take
    part), and vectors whose squared length passes 2^62, as their scores fit no long. Of
    several rows with one id the least by label and vector counts.
    """
    label = F.col(label_column).cast("long").alias("label")
    usable = rows.where(label.isNotNull())
    vectors = finite_vectors(usable, id_column, vector_column, True, False, keep=(label,))
    small = F.forall("vector", lambda x: F.abs(x * scale) < float(1 << 31))
    scaled = F.transform("vector", lambda x: F.floor(x * scale))
    found = vectors.where(small).select("id", "label", scaled.alias("vector"))
    square = F.aggregate(
        "vector", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x * x).cast("decimal(38,0)")
    )
    found = found.withColumn("square", square).where(F.col("square") <= 1 << 62)
    one = found.groupBy("id").agg(F.min(F.struct("label", "vector", "square")).alias("row"))
    return one.select("id", "row.label", "row.vector", F.col("row.square").cast("long").alias("square"))


def length_class() -> Column:
    """The class of ``square``: lengths in a class differ by less than ``CLASS_RATIO``."""
    octave = F.floor(F.log(F.col("square").cast("double")) / (2 * log(CLASS_RATIO)))
    return F.when(F.col("square") == 0, -1).otherwise(octave).cast("int")


@dataclass
class Classes:
    """Rows of each length class; their number is bounded by the lengths that a long holds."""

    counts: dict[int, int]

    @classmethod
    def of(cls, rows: DataFrame) -> Classes:
        found = rows.groupBy("class").count().collect()
        return cls({r["class"]: r["count"] for r in found})

    def slices(self) -> Column:
        """The number of blocks of each class, by class."""
        pairs = [
            F.lit(x)
            for c, n in sorted(self.counts.items())
            for x in (c, -(-n // BLOCK_ROWS))
        ]
        return F.create_map(*pairs)

    def blocks(self) -> Column:
        """All blocks as ``class, slice``; classes are few, slices are made by Spark."""

        def slices_of(number: int, rows: int) -> Column:
            last = F.lit(-(-rows // BLOCK_ROWS) - 1)
            return F.transform(
                F.sequence(F.lit(0), last),
                lambda s: F.struct(F.lit(number).alias("class"), s.cast("int").alias("slice")),
            )

        return F.concat(*[slices_of(c, n) for c, n in sorted(self.counts.items())])


class Block:
    """Rows of one length class with a sorted list for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.longest = float(lengths.max())
        self.shortest = float(lengths.min())
        self.floats = vectors.astype(float)
        self.unit = self.floats / np.maximum(lengths, 1e-300)[:, None]
        by_coordinate = np.ascontiguousarray(self.unit.T)
        self.order = np.argsort(by_coordinate, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(by_coordinate, self.order, axis=1)
        step = max(1, len(ids) // SEEDS)
        self.seeds = np.arange(0, len(ids), step)

    def scores(self, rows: np.ndarray | None, anchor: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products; doubles are exact up to 2^53, which bounds all partial sums."""
        if self.longest * length < 2.0**52:
            own = self.floats if rows is None else self.floats[rows]
            return (own @ anchor.astype(float)).astype(np.int64)
        own = self.vectors if rows is None else self.vectors[rows]
        return own @ anchor

    def feasible(self, anchor: np.ndarray, length: float, low: float, high: float):
        """Rows that may score in ``low`` to ``high``: None for all of them."""
        if not length or not self.longest:
            return None if low <= 0 <= high else np.zeros(0, np.int64)
        least = low / (length * (self.longest if low >= 0 else self.shortest or 1e-300))
        most = high / (length * (self.shortest if high >= 0 else self.longest)) if self.shortest else 2.0
        if least > 1 + SLACK or most < -1 - SLACK:
            return np.zeros(0, np.int64)
        widest = np.arccos(np.clip(least, -1, 1)) if least > -1 else np.pi
        narrowest = np.arccos(np.clip(most, -1, 1)) if most < 1 else 0.0
        unit = anchor / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle = np.arccos(np.clip(unit[focus], -1, 1))
        # the triangle inequality of angles between row, anchor and coordinate
        near = np.maximum(np.maximum(angle - widest, narrowest - angle), 0)
        far = np.minimum(np.minimum(angle + widest, 2 * np.pi - angle - narrowest), np.pi)
        lows, highs = np.cos(far) - SLACK, np.cos(near) + SLACK
        starts = [np.searchsorted(self.sorted[f], v, "left") for f, v in zip(focus, lows)]
        stops = [np.searchsorted(self.sorted[f], v, "right") for f, v in zip(focus, highs)]
        sizes = np.array(stops) - np.array(starts)
        by_size = np.argsort(sizes, kind="stable")
        if sizes[by_size[0]] == len(self.ids):
            return None
        first = by_size[0]
        rows = self.order[focus[first], starts[first] : stops[first]]
        for k in by_size[1:]:
            if sizes[k] < len(self.ids):
                values = self.unit[rows, focus[k]]
                rows = rows[(values >= lows[k]) & (values <= highs[k])]
        return rows


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.nonzero(scores >= cut)[0]
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def reached(scores: np.ndarray, k: int) -> int | None:
    """A score that ``k`` of these reach."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None


class Probes:
    """What a block looks for: per anchor a number of bands, and ``k`` rows for each."""

    #: Lowest and highest score where there is no band.
    OPEN = (-(1 << 62), 1 << 62)

    def __init__(self, k: int, same_label: bool):
        self.k, self.same_label = k, same_label

    def fits(self, block: Block, rows, anchor_id: int, label: int) -> np.ndarray:
        labels = block.labels if rows is None else block.labels[rows]
        if not self.same_label:
            return labels != label
        ids = block.ids if rows is None else block.ids[rows]
        return (labels == label) & (ids != anchor_id)

    def search(self, block: Block, anchor_id, label, vector, bands) -> Iterator[tuple]:
        """``anchor, band, id, score`` of the best rows of the block in each band."""
        length = float(np.sqrt((vector.astype(float) ** 2).sum()))
        seeded = block.scores(block.seeds, vector, length)
        seeded = seeded[self.fits(block, block.seeds, anchor_id, label)]
        raised = []
        for low, high in bands:
            sure = reached(seeded[(seeded >= low) & (seeded <= high)], self.k)
            raised.append((low if sure is None else sure, high))
        low, high = min(b[0] for b in raised), max(b[1] for b in raised)
        rows = block.feasible(vector, length, low, high)
        scores = block.scores(rows, vector, length)
        ids = block.ids if rows is None else block.ids[rows]
        good = self.fits(block, rows, anchor_id, label)
        scores, ids = scores[good], ids[good]
        for number, (low, high) in enumerate(raised):
            own = np.nonzero((scores >= low) & (scores <= high))[0]
            for at in top(scores[own], ids[own], self.k).tolist():
                yield anchor_id, number, int(ids[own[at]]), int(scores[own[at]])


FOUND = "anchor_id long, band int, id long, score long"


def _vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def search_blocks(rows: DataFrame, anchors: DataFrame, probes: Probes) -> DataFrame:
    """The best rows of each block for each anchor's bands.

    ``rows``: class, slice, id, label, vector; ``anchors``: the same and ``bands``, an array
    of ``low, high``. Both are dealt by block and sorted so that a block's rows come first;
    a task holds one block's rows and one batch of anchors.
    """
    tagged = rows.select(
        "class", "slice", F.lit(0).alias("kind"), "id", "label", "vector",
        F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("bands"),
    ).unionByName(
        anchors.select("class", "slice", F.lit(1).alias("kind"), "id", "label", "vector", "bands")
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["anchor_id", "band", "id", "score"],
            )
            out.clear()
            return made

        for batch in batches:
            classes, slices, kinds = (batch.column(i).to_numpy() for i in range(3))
            change = (np.diff(classes) != 0) | (np.diff(slices) != 0) | (np.diff(kinds) != 0)
            edges = [0, *(np.nonzero(change)[0] + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                own, part = (int(classes[start]), int(slices[start])), batch.slice(start, stop - start)
                if own != key:
                    key, parts, block = own, [], None
                ids = part.column(3).to_numpy()
                labels, vectors = part.column(4).to_numpy(), _vectors_of(part)
                if kinds[start] == 0:
                    parts.append((ids, labels, vectors.astype(np.int64)))
                    continue
                if block is None and parts:
                    block = Block(*(np.concatenate(c) for c in zip(*parts)))
                    parts = []
                if block is None:
                    continue
                bands = part.column(6).to_pylist()
                for at in range(part.num_rows):
                    wanted = [(b["low"], b["high"]) for b in bands[at]]
                    out.extend(
                        probes.search(block, int(ids[at]), int(labels[at]), vectors[at], wanted)
                    )
                    if len(out) >= 50_000:
                        yield flushed()
        if out:
            yield flushed()

    dealt = tagged.repartition("class", "slice").sortWithinPartitions("class", "slice", "kind")
    return dealt.mapInArrow(of, FOUND)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    anchor_every: int = 100,
    relabel_every: int = 7,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the ids divisible by ``anchor_every``; labels of ids divisible by
    ``relabel_every`` are one further of ten. Left out are rows as in ``integer_vectors``,
    where repeated ids are one row. Ties go to the smaller id. A positive whose band holds
    no row, as any with a negative score, gives no rows; nor does an empty table.
    """
    shifted = F.when(
        F.col("id") % relabel_every == 0, (F.col("label") + 1) % 10
    ).otherwise(F.col("label"))
    usable = integer_vectors(rows, id_column, vector_column, label_column)
    index = stage(
        usable.withColumn("label", shifted).withColumn("class", length_class()), "negatives-rows"
    )
    classes = Classes.of(index)
    if not classes.counts:
        return index.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    by_hash = F.pmod(F.xxhash64("id"), classes.slices()[F.col("class")]).cast("int")
    dealt = index.withColumn("slice", by_hash)

    def sent(anchors: DataFrame) -> DataFrame:
        return anchors.drop("class").select("*", F.inline(classes.blocks()))

    low, high = Probes.OPEN
    bounds = "array<struct<low:bigint,high:bigint>>"
    anchors = index.where(F.col("id") % anchor_every == 0).select("id", "label", "vector")
    everything = F.array(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))).cast(bounds)
    near = search_blocks(dealt, sent(anchors.withColumn("bands", everything)), Probes(positives, True))
    firsts = _best(near, ["anchor_id"], positives).select("anchor_id", "id", "score", "rank")
    chosen = stage(
        firsts.groupBy("anchor_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")
        ),
        "negatives-positives",
    )

    def limits(p):
        # 30 p <= 100 n <= 90 p in whole numbers; a negative p leaves nothing between
        wide = p["score"].cast("decimal(24,0)")
        return F.struct(
            F.ceil(wide * band[0] / 100).cast("long").alias("low"),
            F.floor(wide * band[1] / 100).cast("long").alias("high"),
        )

    open_bands = F.filter("positives", lambda p: p["score"] >= 0)
    probing = (
        anchors.join(chosen, F.col("id") == F.col("anchor_id"))
        .select("id", "label", "vector", F.transform(open_bands, limits).cast(bounds).alias("bands"))
        .where(F.size("bands") > 0)
    )
    far = search_blocks(dealt, sent(probing), Probes(negatives, False))
    ranked = _best(far, ["anchor_id", "band"], negatives).withColumnsRenamed(
        {"id": "negative_id", "score": "negative_score"}
    )
    # positives are in order of score, so those that open a band come first
    own = chosen.select(
        F.col("anchor_id").alias("of"), F.posexplode("positives").alias("at", "p")
    ).select("of", "at", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    same = (F.col("anchor_id") == F.col("of")) & (F.col("band") == F.col("at"))
    return ranked.join(own, same).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        "negative_id", "positive_score", "negative_score",
    )


def statement() -> str:
    """The same rows by comparing every anchor with every row."""
    low, high = BAND
    return f"""
WITH usable AS (
  SELECT vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.id % 100 = 0 AND a.id <> b.id
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER w AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {low} * p.positive_score <= 100 * s.score AND 100 * s.score <= {high} * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
