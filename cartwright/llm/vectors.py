"""Vectors of a table, and matching blocks of queries with blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shuffle partitions that blocks are dealt to, at most; further blocks follow one another in a task.
PARTITIONS = 8192
#: Blocks are not made smaller than this to give every core one.
SMALL_BLOCK = 4096
#: Queries matched at once with a block.
QUERY_BATCH = 1024


def finite_vectors(
    rows: DataFrame,
    id_column: str,
    vector_column: str,
    zero: bool,
    infinite: bool,
    keep: tuple[Column, ...] = (),
) -> DataFrame:
    """``id, vector`` (doubles) of the rows that can take part, and ``keep``.

    Left out are null ids, null and empty vectors, those with a null or NaN component,
    with an infinite one unless ``infinite``, with none but zeros unless ``zero``, and
    those of another length than most rows have (the smaller length on a tie).
    """
    vector = F.col(vector_column).cast("array<double>")
    slim = rows.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"), *keep)

    def fits(x):
        ok = x.isNotNull() & ~F.isnan(x)
        return ok if infinite else ok & (F.abs(x) < float("inf"))

    good = F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", fits)
    if not zero:
        good &= F.exists("vector", lambda x: x != 0)
    slim = slim.where(good)
    usual = slim.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return slim.where(F.size("vector") == (usual["n"] if usual else 0))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 0))


def block_count(rows: int, block_rows: int, cores: int, small: int = SMALL_BLOCK) -> int:
    """Blocks of at most about ``block_rows``; as many as cores, unless that makes them small."""
    return max(1, -(-rows // block_rows), min(cores, rows // small))


def search_blocks(
    rows: DataFrame,
    queries: DataFrame,
    blocks: int,
    build: Callable[[pa.Table], object],
    search: Callable[[object, pa.RecordBatch], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """What ``search`` finds in each block for the queries sent to it.

    Both tables hold ``block`` (long, from 0), ``id`` and equal further columns. Every row is
    shuffled once; only queries are repeated. A task gathers the rows of one block, then
    takes the queries batch by batch, so it holds one block and one batch.
    """
    columns = [c for c in rows.columns if c != "block"]
    tagged = rows.select("block", F.lit(0).alias("kind"), *columns).unionByName(
        queries.select("block", F.lit(1).alias("kind"), *columns)
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = (np.diff(numbers) != 0) | (np.diff(kinds) != 0)
            edges = [0, *(np.nonzero(change)[0] + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if numbers[start] != key:
                    key, parts, block = numbers[start], [], None
                part = batch.slice(start, stop - start).select(columns)
                if kinds[start] == 0:
                    parts.append(part)
                    continue
                if parts:
                    block, parts = build(pa.Table.from_batches(parts)), []
                if block is not None:
                    for at in range(0, part.num_rows, QUERY_BATCH):
                        yield search(block, part.slice(at, QUERY_BATCH))

    dealt = tagged.repartitionById(min(blocks, PARTITIONS), F.col("block").cast("int"))
    return dealt.sortWithinPartitions("block", "kind").mapInArrow(of, schema)


def best_of(found: DataFrame, k: int, value: str, largest: bool) -> DataFrame:
    """The ``k`` best rows of each query, ties to the smaller id, with their rank from 1.

    A found id counts once, by its best value. Spark keeps ``k`` rows of a query in each
    task before the shuffle, so the number of blocks searched does not gather in one.
    """
    better = F.max if largest else F.min
    each = found.groupBy("query_id", "vec_id").agg(better(value).alias(value))
    by_value = F.col(value).desc() if largest else F.col(value).asc()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(by_value, "vec_id"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", value)
