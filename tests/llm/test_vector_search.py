import numpy as np
import pytest

from cartwright.llm.hamming import nearest_codes
from cartwright.llm.neighbours import (
    balanced_parts,
    nearest_vectors,
    neighbour_graph,
)
from cartwright.llm.tables import table

NAN, INF = float("nan"), float("inf")


def brute(rows, every, k, measure, largest):
    """Best candidates of each query over all pairs; repeated ids count by their best."""
    queries = {}
    for i, v in rows:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = {}
    for q, own in queries.items():
        best = {}
        for i, v in rows:
            if i != q:
                value = measure(own, v)
                best[i] = (max if largest else min)(best.get(i, value), value)
        ranked = sorted((-s if largest else s, i) for i, s in best.items())[:k]
        out[q] = [(i, -s if largest else s) for s, i in ranked]
    return out


def hamming(a, b):
    return sum((x > 0) != (y > 0) for x, y in zip(a, b))


def inner(a, b):
    return float((np.array(a) * np.array(b)).sum())


def grouped(frame, value):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r[value]))
        assert r.rank == len(out[r.query_id])
    return out


def rows_of(frame):
    return [(r.vec_id, [float(x) for x in r.embedding]) for r in frame.collect()]


def test_codes_equal_all_pairs(spark, sf):
    vectors = table(spark, sf, "embeddings")
    want = brute(rows_of(vectors), 50, 10, hamming, False)
    assert grouped(nearest_codes(vectors), "distance") == want
    assert grouped(nearest_codes(vectors, block_rows=90), "distance") == want


@pytest.mark.parametrize("size", [1, 3, 20, 70])
def test_codes_of_other_lengths(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, rng.choice([-1.0, 0.0, 1.0], size).tolist()) for i in range(120)]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (50, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 10, 5, hamming, False)
    assert grouped(nearest_codes(frame, every=10, k=5, block_rows=40), "distance") == want


def test_one_code_may_hold_most_rows(spark):
    """Two thirds of the rows are one code, many of them repeated; ties go to the smaller ids."""
    rng = np.random.default_rng(3)
    rows = [
        (i, [1.0] * 24 if i % 3 else rng.choice([-1.0, 1.0], 24).tolist()) for i in range(400)
    ]
    rows += rows[:100] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 10, 5, hamming, False)
    assert grouped(nearest_codes(frame, every=10, k=5, block_rows=60), "distance") == want


@pytest.mark.parametrize("search", [nearest_codes, nearest_vectors])
def test_only_queries_are_repeated(spark, sf, search):
    """One generator in the plan, on the side of the queries; codes are shuffled, not vectors."""
    found = search(table(spark, sf, "embeddings"), block_rows=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    rows, queries = plan[plan.index("Union") :].split("Generate explode")
    assert "Relation [id" in rows and "Relation [id" not in queries


def test_recall_of_the_learned_partition(spark, sf):
    vectors = table(spark, sf, "embeddings")
    want = brute(rows_of(vectors), 20, 20, inner, True)
    found = grouped(nearest_vectors(vectors), "score")
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {(q, i): s for q, own in rows_of(vectors) if q in want for i, v in rows_of(vectors) if (s := inner(own, v)) is not None}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q, hits in found.items() for i, s in hits)


def test_common_vector_and_ties(spark):
    """A third of the rows are one vector: equal scores, ties to the smaller id."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, one if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = grouped(nearest_vectors(frame, recall=1.0, block_rows=50), "score")
    same = brute(rows, 20, 20, inner, True)
    for q in same:
        if q % 3 == 0:
            assert [i for i, _ in found[q]] == [i for i, _ in same[q]]
            assert len({s for i, s in found[q] if i % 3 == 0}) == 1


def test_parts_are_balanced_and_keep_neighbours():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 16)) * 4
    vectors = centres[np.repeat(np.arange(8), 50)] + rng.normal(size=(400, 16)) * 0.2
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = neighbour_graph(vectors)
    own = balanced_parts(vectors, graph, 8)
    sizes = np.bincount(own, minlength=8)
    assert sizes.max() <= np.ceil(1.05 * 50) and sizes.min() >= int(0.95 * 50)
    assert (own[graph] == own[:, None]).mean() > 0.9


@pytest.mark.parametrize("search", [nearest_codes, nearest_vectors])
def test_odd_vectors(spark, search):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (100, [1.0, -1.0]), (100, [1.0, -1.0])]
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [NAN, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0])]
    schema = "vec_id long, embedding array<float>, id string, vector string, part string, score string"
    frame = spark.createDataFrame([(i, v, *["x"] * 4) for i, v in rows + odd], schema)
    if search is nearest_codes:
        want = brute(rows, 50, 10, hamming, False)
        assert grouped(search(frame), "distance") == want
    else:
        more = spark.createDataFrame([(6, [0.0, 0.0], *["x"] * 4), (7, [INF, 1.0], *["x"] * 4)], schema)
        assert grouped(search(frame.unionByName(more)), "score") == brute(rows, 20, 20, inner, True)
    assert search(frame.where("false")).count() == 0
    alone = search(frame.where("vec_id = 0"))
    assert alone.count() == 0


@pytest.mark.parametrize("same_vector", [True, False])
def test_one_id_may_hold_all_rows_and_more_than_a_sample(spark, same_vector):
    """6,000 rows of one id: nothing else to find, but for the two other rows."""
    rng = np.random.default_rng(5)
    vectors = np.float32(rng.normal(size=(6000, 4))).tolist()
    rows = [(40, vectors[0] if same_vector else v) for v in vectors] + [(1, vectors[1]), (60, vectors[2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(i, [float(x) for x in v]) for i, v in rows], 20, 20, inner, True)
    found = grouped(nearest_vectors(frame), "score")
    assert {q: [i for i, _ in hits] for q, hits in found.items()} == {
        q: [i for i, _ in hits] for q, hits in want.items()
    }
