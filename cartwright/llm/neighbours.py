"""Approximate nearest neighbours by learned partitions.

On a sample, the graph of nearest neighbours is divided into parts of equal size that
cut few edges, and a small classifier learns to tell a vector's part. The classifier
then places every row in its most probable part, and routes every query to as many of
its most probable parts as a held-out sample needs for the wanted recall; there the
rows are ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.vectors import best_of, block_count, finite_vectors, matrix, search_blocks
from cartwright.sources.staging import stage

K = 20
#: Vectors fitted on, and held out to choose the number of parts searched, drawn by a hash.
SAMPLE = 4096
HELD_OUT = 512
#: Wanted share of the true neighbours of the held-out sample.
RECALL = 0.95
GRAPH_NEIGHBOURS = 10
ROWS_PER_PART = 4096
PARTS = (8, 512)
#: Rows that one task matches.
BLOCK_ROWS = 32_768
#: Queries ranked together inside a task.
TOGETHER = 128


def neighbour_graph(vectors: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """Numbers of the ``k`` vectors of largest inner product, for each vector."""
    k = min(k, len(vectors) - 1)
    out = np.empty((len(vectors), k), np.int64)
    for start in range(0, len(vectors), 512):
        scores = vectors[start : start + 512] @ vectors.T
        scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -np.inf
        out[start : start + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each vector: equal sizes, moved while that puts more neighbours together.

    The first parts come from halving along the widest direction, again and again. A
    round offers every vector the part with most of its neighbours, largest gain first,
    while that part has room (5 % above equal size) and the old one is not left short.
    """
    own = np.zeros(len(vectors), np.int64)
    waiting = [(np.arange(len(vectors)), 0, parts)]
    while waiting:
        rows, first, n = waiting.pop()
        if n == 1:
            own[rows] = first
            continue
        centred = vectors[rows] - vectors[rows].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = n // 2
        cut = len(order) * left // n
        waiting += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    most = int(np.ceil(1.05 * len(vectors) / parts))
    fewest = int(0.95 * len(vectors) / parts)
    sources = np.repeat(np.arange(len(graph)), graph.shape[1])
    for _ in range(rounds):
        together = np.zeros((len(vectors), parts))
        np.add.at(together, (sources, own[graph.ravel()]), 1)
        np.add.at(together, (graph.ravel(), own[sources]), 1)
        wish = together.argmax(axis=1)
        each = np.arange(len(vectors))
        gain = together[each, wish] - together[each, own]
        sizes = np.bincount(own, minlength=parts)
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            here, there = own[row], wish[row]
            if sizes[there] < most and sizes[here] > fewest:
                own[row] = there
                sizes[here] -= 1
                sizes[there] += 1
                moved += 1
        if not moved:
            break
    return own


@dataclass(frozen=True)
class Router:
    """A linear classifier of parts, and the number of parts that a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    visits: int = 1

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / norms @ self.weights + self.bias

    def parts(self, vectors: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")[:, :n]


def fit_classifier(vectors: np.ndarray, own: np.ndarray, parts: int, steps: int = 200) -> Router:
    """Softmax regression by Adam over all sample rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    wanted = np.eye(parts)[own]
    values = [np.zeros((unit.shape[1], parts)), np.zeros(parts)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, steps + 1):
        logits = unit @ values[0] + values[1]
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (chance / chance.sum(axis=1, keepdims=True) - wanted) / len(unit)
        for value, slope, (mean, square) in zip(
            values, (unit.T @ error + 1e-5 * values[0], error.sum(axis=0)), moments
        ):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            value -= 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Router(*values)


def visits_needed(router: Router, vectors: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """Fewest parts by which held-out queries find that share of their neighbours in the sample."""
    parts = len(router.bias)
    own = router.parts(vectors, 1)[:, 0]
    k = min(k, len(vectors))
    best = np.argpartition(-(queries @ vectors.T), k - 1, axis=1)[:, :k]
    places = np.argsort(router.parts(queries, parts), axis=1)
    found = np.take_along_axis(places, own[best], axis=1)
    shares = [(found < n).mean() for n in range(1, parts + 1)]
    return next(n for n, share in enumerate(shares, 1) if share >= recall)


def fit_router(good: DataFrame, rows: int, k: int = K, recall: float = RECALL) -> Router:
    """Fit on at most ``SAMPLE + HELD_OUT`` of the ``rows`` vectors, drawn by a hash.

    Those with the least hashes of id and vector are taken, repeated rows once.

    The number of parts follows the rows, within ``PARTS`` and an eighth of the sample.
    Vectors without neighbourhoods, as random ones, need most parts visited; grouped
    vectors need few.
    """
    draw = F.xxhash64(F.lit("router"), "id", "vector")
    least = good.select("id", "vector").orderBy(draw, "id", "vector").limit(2 * (SAMPLE + HELD_OUT))
    sample = least.toPandas()
    rows_drawn = pd.Series(list(zip(sample["id"], sample["vector"].map(tuple))), dtype=object)
    sample = sample[~rows_drawn.duplicated().to_numpy()].head(SAMPLE + HELD_OUT)
    vectors = matrix(sample["vector"])
    order = np.random.default_rng(7).permutation(len(vectors))
    held = order[: min(HELD_OUT, len(order) // 8)]
    fitted = vectors[order[len(held) :]]
    parts = int(np.clip(rows // ROWS_PER_PART, *PARTS))
    parts = max(1, min(parts, len(fitted) // 8))
    if parts < 2:
        return Router(np.zeros((vectors.shape[1], 1)), np.zeros(1))
    router = fit_classifier(
        fitted, balanced_parts(fitted, neighbour_graph(fitted), parts), parts
    )
    # Among all rows, the k nearest of a query are as near as this many in the sample.
    nearest = max(2, -(-k * len(fitted) // rows))
    visits = visits_needed(router, fitted, vectors[held], nearest, recall) if len(held) else parts
    return Router(router.weights, router.bias, visits)


def routed(good: DataFrame, router: Router, visits: int) -> DataFrame:
    """``id, vector, part``: each vector once for each of its ``visits`` most probable parts."""
    shared = good.sparkSession.sparkContext.broadcast(router)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            parts = shared.value.parts(flat.reshape(batch.num_rows, -1), visits)
            again = np.repeat(np.arange(batch.num_rows), parts.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(again)) for c in batch.columns), pa.array(parts.ravel())],
                names=["id", "vector", "part"],
            )

    return good.select("id", "vector").mapInArrow(of, "id long, vector array<double>, part long")


class Block:
    """Rows in memory, by id, that rank themselves for queries."""

    def __init__(self, rows: pa.Table):
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.vectors = _vectors(rows["vector"].combine_chunks(), len(ids))[order]
        self.starts = np.nonzero(np.diff(self.ids, prepend=self.ids[0] - 1))[0]
        self.largest = np.abs(self.vectors).max()

    def rank(self, own: np.ndarray, asked: np.ndarray, k: int) -> pa.RecordBatch:
        """``query_id, vec_id, score``: the ``k`` rows of largest inner product of each query.

        Ties go to the smaller id. A matrix product proposes the rows; those as good as
        the k-th are measured again one by one, so that equal vectors get equal scores
        wherever they stand. Rows of one id are one candidate, by the best of them.
        """
        size = self.largest * np.abs(asked).max() * asked.shape[1]
        repeated = len(self.starts) < len(self.ids)
        out = []
        for start in range(0, len(own), TOGETHER):
            scores = asked[start : start + TOGETHER] @ self.vectors.T
            for at, row in enumerate(scores, start):
                row[np.searchsorted(self.ids, own[at]) : np.searchsorted(self.ids, own[at], "right")] = -np.inf
                best = np.maximum.reduceat(row, self.starts) if repeated else row
                kth = np.partition(best, -k)[-k] if len(best) > k else -np.inf
                near = np.nonzero((row >= kth - 1e-12 * size) & (row > -np.inf))[0]
                exact = (self.vectors[near] * asked[at]).sum(axis=1)
                near_ids = self.ids[near]
                order = np.lexsort((near_ids, -exact))
                _, firsts = np.unique(near_ids[order], return_index=True)
                order = order[np.sort(firsts)][:k]
                out.append((np.full(len(order), own[at]), near_ids[order], exact[order]))
        columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def _vectors(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def nearest_vectors(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 20,
    k: int = K,
    recall: float = RECALL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found, nearest first.

    Nearness is the inner product in double precision. Queries are the ids divisible
    by ``every``, against all rows of another id. Vectors that are null, zero, of an
    unusual length or hold a null or non-finite component take no part, nor do null
    ids. Of rows that repeat an id the best counts as a candidate, and the least vector
    as the query. An empty table gives no rows.

    A part that holds many rows, as of one common vector, is cut into blocks of about
    ``block_rows`` at random. Rows are dealt to blocks once; a query is sent to every block
    of the parts it visits, and each returns ``k`` rows for it. All parts are
    searched when the sample is too small to divide or to measure the recall on, and
    when it holds fewer than ``k`` candidates in the visited parts for some query.
    """
    good = finite_vectors(rows, id_column, vector_column, zero=False, infinite=False)
    n = good.count()
    if not n:
        schema = "query_id long, rank int, vec_id long, score double"
        return rows.sparkSession.createDataFrame([], schema)
    router = fit_router(good, n, k, recall)
    # Drawn once and stored, so that repeated rows of one id spread over the blocks of their part.
    draw = (F.rand(7) * (1 << 31)).cast("long").alias("draw")
    placed = stage(routed(good, router, 1).select("*", draw), "placed")
    asked = good.where(F.pmod("id", F.lit(every)) == 0)
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    by_id = placed.groupBy("part", "id").agg(F.count(F.lit(1)).alias("n"))
    counts = by_id.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"))
    held = counts.collect()
    sizes = {r["part"]: r["n"] for r in held}
    visits = router.visits
    if sum(sorted(r["ids"] for r in held)[:visits]) <= k or len(sizes) < visits:
        visits = len(router.bias)
    # A part's blocks are numbered from ``first``; the parts are at most ``PARTS``.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    share = max(1, cores // len(sizes))
    numbers, blocks = {}, 0
    for part, size in sorted(sizes.items()):
        numbers[part] = (blocks, block_count(size, block_rows, share))
        blocks += numbers[part][1]

    def of_part(place: int):
        return F.create_map(*(F.lit(x) for part, own in numbers.items() for x in (part, own[place])))[
            F.col("part")
        ]

    def search(block: Block, queries: pa.RecordBatch) -> pa.RecordBatch:
        asked = _vectors(queries.column("vector"), queries.num_rows)
        return block.rank(queries.column("id").to_numpy(), asked, k)

    index = placed.select(
        "id", "vector", (of_part(0) + F.pmod("draw", of_part(1))).alias("block")
    )
    each = F.sequence(of_part(0), of_part(0) + of_part(1) - 1).cast("array<long>")
    sent = (
        routed(asked, router, visits)
        .where(of_part(0).isNotNull())
        .select("id", "vector", F.explode(each).alias("block"))
    )
    found = search_blocks(
        index, sent, blocks, Block, search, "query_id long, vec_id long, score double"
    )
    return best_of(found, k, "score", largest=True)
