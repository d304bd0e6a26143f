import numpy as np
import pytest

from cartwright.llm import hard_negatives as H

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, score long, class int"


def plain(rows):
    """All pairs by plain integers; one row an id."""
    usable = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or not v or not all(x is not None and np.isfinite(x) for x in v):
            continue
        ints = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        usable[i] = min(usable.get(i, (label, ints)), (label, ints))
    size = max((len(v) for _, v in usable.values()), default=0)
    usable = {i: ((l + 1) % 10 if i % 7 == 0 else l, v) for i, (l, v) in usable.items() if len(v) == size}
    out = []
    for a, (label, vector) in usable.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, l) for i, (l, v) in usable.items() if i != a)
        positives = [(i, -s) for s, i, l in scored if l == label][:5]
        for p, ps in positives:
            band = [(i, -s) for s, i, l in scored if l != label and 30 * ps <= -100 * s <= 90 * ps]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(band[:10], 1)]
    return sorted(out)


def result(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    found = H.hard_negatives(df, **settings)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def vectors(seed, n, clusters=6, spread=0.3, size=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, size))
    x = middle[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, size))
    x *= rng.lognormal(sigma=0.6, size=(n, 1))
    return [(i, [float(v) for v in np.float32(row)], int(rng.integers(0, 4))) for i, row in enumerate(x)]


@pytest.mark.parametrize("block_rows", [64, 1 << 16])
def test_equals_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(H, "BLOCK_ROWS", block_rows)
    rows = vectors(1, 900)
    assert result(spark, rows) == plain(rows) != []


def test_ties_repeats_nulls_and_extremes(spark):
    rows = vectors(2, 250)
    same = rows[5][1]
    rows += [(1000 + i, same, 1) for i in range(150)]  # ties at every rank
    rows += [(100, rows[100][1], rows[100][2])] * 3  # repeated rows
    rows += [(200, rows[3][1], 0), (7, rows[4][1], 2)]  # ids with two vectors
    rows += [(300, [0.0] * 8, 1), (301, [0.0] * 8, 2)]  # no length
    rows += [(400, None, 1), (401, [], 1), (402, [1.0] * 7 + [None], 1), (403, [1.0] * 7 + [float("nan")], 1)]
    rows += [(404, [1.0] * 7 + [float("inf")], 1), (405, [1.0] * 3, 1), (None, same, 1), (500, same, None)]
    rows += [(600, [-x for x in same], 1), (601, [1e30] * 8, 1)]
    want = plain([r for r in rows if r[0] != 601])  # 601 scores beyond a long
    assert result(spark, rows) == want


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(100, [1.0, 0.0], 1)]) == []
    assert result(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)]) == []


def test_coordinate_ranges_lose_no_row_and_prune():
    """Feasible rows hold all in the band; with grouped vectors most others are struck out."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 16))
    x = middle[rng.integers(0, 20, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(1, 1.2, (4000, 1))).astype(np.int64)
    block = H.Block(np.arange(4000), np.zeros(4000, np.int64), x)
    struck = 0
    for anchor in x[:60]:
        length = float(np.sqrt((anchor.astype(float) ** 2).sum()))
        scores = x @ anchor
        for low, high in ((0.8, 0.95), (0.9, 2), (-0.5, 0.1), (-2, -0.9), (0.2, 0.4)):
            band = (low * length**2, high * length**2)
            rows = block.feasible(anchor, length, *band)
            rows = np.arange(4000) if rows is None else rows
            assert set(np.nonzero((scores >= band[0]) & (scores <= band[1]))[0]) <= set(rows.tolist())
            if low >= 0.8:
                struck += 4000 - len(rows)
    assert struck > 0.6 * 60 * 2 * 4000


def test_rows_are_not_copied_to_anchors(spark, capsys):
    rows = spark.createDataFrame([r for r in vectors(4, 300)], "vec_id long, embedding array<float>, label int")
    H.hard_negatives(rows).explain("formatted")
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan
