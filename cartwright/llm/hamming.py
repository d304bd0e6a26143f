"""Exact top-k search on binary codes: incremental multi-index hashing.

A code is cut into segments, each with a table from segment value to codes. The search
visits, for radius 0, 1, 2 ..., the table entries at exactly that distance from the
query's segments and measures the codes found there. After radius r every code within
``segments * (r + 1) - 1`` bits has been seen, as one of its segments must be within r;
a query ends when its k-th measured distance is within that bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.llm.vectors import best_of, block_count, finite_vectors, search_blocks
from cartwright.sources.staging import stage

K = 10
#: Codes that one task matches.
BLOCK_ROWS = 131_072
#: Queries advanced together inside a task.
TOGETHER = 64
SEGMENT_BITS = 16


def packed_signs(vectors: DataFrame) -> DataFrame:
    """``id, code``: one bit a component, 1 above zero, zeros up to a whole byte."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            bits = np.packbits(flat.reshape(batch.num_rows, -1) > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary())],
                names=["id", "code"],
            )

    return vectors.select("id", "vector").mapInArrow(of, "id long, code binary")


def unpacked(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of bits per code, as bytes of 0 and 1."""
    whole = b"".join(codes.to_pylist())
    return np.unpackbits(
        np.frombuffer(whole, np.uint8).reshape(len(codes), -1), axis=1, bitorder="little"
    )


def nearest_owners(codes: DataFrame, k: int) -> DataFrame:
    """Of each code the ``k + 1`` smallest distinct ids.

    Others of that code cannot be found: ``k`` smaller ids that are not the query's own stand
    at the same distance. Repeated rows go before the shuffle, and Spark keeps ``k + 1`` ids
    of a code in each task, so one code may hold any share of the rows.
    """
    place = F.row_number().over(W.partitionBy("code").orderBy("id"))
    return codes.distinct().withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


@cache
def flips(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` ones."""
    return np.array([sum(1 << i for i in some) for some in combinations(range(width), radius)], np.int64)


class MultiIndex:
    """Segment tables of a block of codes; each pair of id and code stands in it once."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        self.ids = ids
        #: Codes that one id has at most; so many more hits make sure of k ids.
        self.each = int(np.unique(self.ids, return_counts=True)[1].max())
        self.length = bits.shape[1]
        width = int(np.clip(np.log2(max(2, len(ids))), 1, SEGMENT_BITS))
        count = max(1, -(-self.length // width))
        edges = [self.length * i // count for i in range(count + 1)]
        self.parts = list(zip(edges, edges[1:]))
        self.values = self.segments(bits)
        self.order = [np.argsort(v, kind="stable") for v in self.values]
        self.starts = [
            np.searchsorted(v[o], np.arange((1 << (b - a)) + 1))
            for v, o, (a, b) in zip(self.values, self.order, self.parts)
        ]

    def segments(self, bits: np.ndarray) -> list[np.ndarray]:
        return [
            bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64))
            for a, b in self.parts
        ]

    def _at_radius(self, table: int, queries: np.ndarray, radius: int):
        """Pairs (query number, code number) whose segments differ in ``radius`` bits."""
        a, b = self.parts[table]
        masks = flips(b - a, radius)
        if not len(masks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        probes = queries[:, None] ^ masks[None, :]
        low, high = self.starts[table][probes], self.starts[table][probes + 1]
        sizes = (high - low).ravel()
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(low.ravel(), sizes)
        who = np.repeat(np.arange(len(queries)).repeat(len(masks)), sizes)
        return who, self.order[table][at]

    def search(self, own_ids: np.ndarray, bits: np.ndarray, k: int) -> pd.DataFrame:
        """The ``k`` nearest codes of each query, its own id left out; ties to smaller ids."""
        out = [
            self._search(own_ids[i : i + TOGETHER], bits[i : i + TOGETHER], k)
            for i in range(0, len(own_ids), TOGETHER)
        ]
        return pd.concat(out, ignore_index=True)

    def _search(self, own_ids: np.ndarray, bits: np.ndarray, k: int) -> pd.DataFrame:
        queries = self.segments(bits)
        seen = np.zeros((len(own_ids), self.length + 1), np.int64)
        active = np.arange(len(own_ids))
        hits = []
        widest = max(b - a for a, b in self.parts)
        for radius in range(widest + 1):
            for table in range(len(self.parts)):
                who, code = self._at_radius(table, queries[table][active], radius)
                who = active[who]
                total, first = np.zeros(len(who), np.int64), np.ones(len(who), bool)
                for other in range(len(self.parts)):
                    gap = np.bitwise_count(self.values[other][code] ^ queries[other][who])
                    total += gap
                    # Reached before at a smaller radius, or at this one in an earlier table.
                    first &= gap > radius if other < table else gap >= radius
                first &= self.ids[code] != own_ids[who]
                who, code, total = who[first], code[first], total[first]
                np.add.at(seen, (who, total), 1)
                hits.append((who, code, total))
            covered = min(self.length, len(self.parts) * (radius + 1) - 1)
            active = active[seen[active, : covered + 1].sum(axis=1) < k * self.each]
            if not len(active):
                break
        who, code, total = (np.concatenate(x) for x in zip(*hits))
        frame = pd.DataFrame({"query": who, "vec_id": self.ids[code], "distance": total})
        frame = frame.sort_values(["query", "distance", "vec_id"], kind="stable")
        frame = frame.drop_duplicates(["query", "vec_id"]).groupby("query").head(k)
        frame.insert(0, "query_id", own_ids[frame.pop("query").to_numpy()])
        return frame


def nearest_codes(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 50,
    k: int = K,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the ``k`` nearest codes of each query.

    A code is the signs of a vector (1 above zero). Queries are the ids divisible by
    ``every``, against all rows of another id; fewer rows than ``k`` are all returned.
    Ties go to the smaller id. Vectors that are null, empty, of an unusual length or
    hold null or NaN take no part, nor do null ids. Of rows that repeat an id the
    nearest counts as a candidate, and the least vector as the query. An empty table
    gives no rows.

    Vectors become codes before any shuffle. Codes are dealt to blocks of about ``block_rows``
    once; the queries are sent to every block, which returns ``k`` rows for each.
    """
    good = finite_vectors(rows, id_column, vector_column, zero=True, infinite=True)
    codes = stage(nearest_owners(packed_signs(good), k), "codes")
    asked = good.where(F.pmod("id", F.lit(every)) == 0)
    asked = packed_signs(asked.groupBy("id").agg(F.min("vector").alias("vector")))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = block_count(codes.count(), block_rows, cores)

    def build(block: pa.Table) -> MultiIndex:
        return MultiIndex(block["id"].to_numpy(), unpacked(block["code"]))

    def search(index: MultiIndex, queries: pa.RecordBatch) -> pa.RecordBatch:
        ids, bits = queries.column("id").to_numpy(), unpacked(queries.column("code"))
        return pa.RecordBatch.from_pandas(index.search(ids, bits, k), preserve_index=False)

    found = search_blocks(
        codes.withColumn("block", F.pmod(F.xxhash64("id", "code"), F.lit(blocks))),
        asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))),
        blocks,
        build,
        search,
        "query_id long, vec_id long, distance long",
    )
    return best_of(found, k, "distance", largest=False)


def statement(every: int = 50, k: int = K) -> str:
    """DuckDB: all pairs of a query and another row, bit by bit."""
    return f"""
        WITH bits AS (
          SELECT vec_id, unnest(embedding) > 0 AS bit, generate_subscripts(embedding, 1) AS at
          FROM embeddings),
        pairs AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
            CAST(sum(CASE WHEN q.bit <> c.bit THEN 1 ELSE 0 END) AS BIGINT) AS distance
          FROM bits q JOIN bits c ON q.at = c.at AND q.vec_id <> c.vec_id
          WHERE q.vec_id % {every} = 0 GROUP BY 1, 2),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (
            PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
          FROM pairs)
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {k}"""
