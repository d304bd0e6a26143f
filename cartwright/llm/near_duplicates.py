"""SimHash near-duplicates: grid range join on segment bit counts, verified exactly.

A fingerprint is embedded as the bit counts of its two-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints.
The segments are divided into bands so that two fingerprints within ``distance`` bits
have, in some band, embeddings at Manhattan distance 0 or 1. Every fingerprint stands
in its own grid cell of each band and looks into the cells one step up; of two
neighbouring cells the lower one finds the higher, so each link is found. Candidates
are compared on all 64 bits before they leave the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright.llm.components import components
from cartwright.llm.simhash import fingerprints, text_digest
from cartwright.sources.staging import stage

SEGMENTS = 32
LOW_BITS = 0x5555555555555555


def _counts(fp: Column) -> Column:
    """The 32 bit counts, two bits each, packed in one long."""
    even = fp.bitwiseAND(F.lit(LOW_BITS))
    odd = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _bands(distance: int) -> list[tuple[int, int]]:
    """First and last-plus-one segment of each band."""
    n = distance // 2 + 1
    edges = [SEGMENTS * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def grid_cells(points: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """``band, cell, fp`` of each point's own cells, and of the cells one step up."""
    counts = points.select("fp", _counts(F.col("fp")).alias("counts"))
    own, up = [], []
    for band, (first, last) in enumerate(_bands(distance)):
        mask = sum(3 << (2 * s) for s in range(first, last))
        cell = F.col("counts").bitwiseAND(F.lit(_signed(mask)))
        own.append(F.struct(F.lit(band).alias("band"), cell.alias("cell")))
        for segment in range(first, last):
            count = F.shiftrightunsigned("counts", 2 * segment).bitwiseAND(F.lit(3))
            flip = F.when(count == 0, _signed(1 << 2 * segment)).when(
                count == 1, _signed(3 << 2 * segment)
            )
            above = F.struct(F.lit(band).alias("band"), cell.bitwiseXOR(flip).alias("cell"))
            up.append(F.when(count < 2, above))

    def spread(cells: list[Column]) -> DataFrame:
        found = counts.select("fp", F.explode(F.array(*cells)).alias("at"))
        return found.where("at is not null").select("at.band", "at.cell", "fp")

    return spread(own), spread(up)


def links(points: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b``: distinct fingerprints of ``points.fp`` that differ in 1 to ``distance`` bits."""
    own, up = grid_cells(points, distance)
    other = own.withColumn("same", F.lit(True)).unionByName(up.withColumn("same", F.lit(False)))
    left = own.withColumnRenamed("fp", "a")
    right = other.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    return left.join(right, ["band", "cell"]).where(near & once).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    distance: int = 3,
) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    ``component_id`` is the least id reachable over fingerprints that differ in at most
    ``distance`` bits. Null and empty texts have fingerprint zero and link like any
    other. Rows that repeat an id stay rows of their own; a null id stays null and is a
    component's id only if every member's id is null. An empty table gives no rows.
    Equal fingerprints are merged before the join, so the size of a group of copies
    does not matter, and a fingerprint has a bounded number of partners.
    """
    marked = stage(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    return _grouped(marked, distance).select("doc_id", "fp", "component_id")


def _grouped(marked: DataFrame, distance: int = 3) -> DataFrame:
    """``marked`` with the least id of each component, and with its root, a fingerprint."""
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    tree = components(links(nodes.select("fp"), distance), "a", "b")
    rooted = nodes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least id.

    Of several rows of the group with that id, one stays (the least hash of the text, and of
    equal texts the least row). Rows of other groups never matter, whatever their ids. All
    columns are kept. Survivors are chosen on ids and hashes; a text moves once, to meet them.
    """
    marked = stage(fingerprints(docs, id_column, text_column, 3, digest=True), "fingerprints")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    alike = (
        _grouped(marked)
        .where(first)
        .groupBy("root", "digest", _key("doc_id").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    least = alike.groupBy("root").agg(F.min(F.struct("digest", "key", "n")).alias("least"))
    kept = stage(
        least.select(
            F.col("root").alias("_root"), F.col("least.digest").alias("_digest"),
            F.col("least.key").alias("_key"), F.col("least.n").alias("_n"),
        ),
        "survivors",
    )
    rows = docs.select(
        F.struct("*").alias("_row"),
        _key(id_column).alias("_key"),
        text_digest(text_column).alias("_digest"),
    )
    same = ["_key", "_digest"]
    if kept.where("_n > 1").isEmpty():
        return rows.join(kept, same, "left_semi").select("_row.*")
    rank = F.struct(F.col("_row")[text_column], *_orderable(docs))
    alone = rows.join(kept.where("_n = 1"), same, "left_semi").select("_row")
    several = rows.join(kept.where("_n > 1"), same)
    one = several.groupBy("_root").agg(F.min_by("_row", rank).alias("_row")).select("_row")
    return alone.unionByName(one).select("_row.*")


def _orderable(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, in ``_row``, whose values have an order."""
    plain = (T.AtomicType, T.NullType)
    return [F.col("_row")[f.name] for f in docs.schema if isinstance(f.dataType, plain)]


def _key(id_column: str) -> Column:
    """The id as a text that is never null, so null ids join."""
    return F.coalesce(F.col(id_column).cast("long").cast("string"), F.lit("null"))
