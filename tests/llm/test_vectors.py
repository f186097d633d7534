"""Whitening and hard negatives against numpy and plain Python."""

import numpy as np
import pytest

from docsieve.llm import hard_negatives, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, rank int, vector string, norm string, shard int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, "x", None, 3) for i, v, y in rows], SCHEMA)


def random_rows(n=260, dim=12, seed=5):
    draw = np.random.default_rng(seed)
    points = draw.standard_normal((n, dim)) * draw.uniform(0.2, 1.2, dim)
    points[60:140] = points[3] + 0.02 * draw.standard_normal((80, dim))  # a crowd
    points[150:170] = points[150]  # copies
    return [(i, [float(np.float32(x)) for x in p], int(draw.integers(0, 10))) for i, p in enumerate(points)]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rows = random_rows()
    return rows + [(900, None, 1), (901, [nan] + [0.0] * 11, 1), (700, [inf] * 12, 2), (902, [None] * 12, 1), (903, [], 1), (904, [1.0, 2.0], 3), (800, [0.0] * 12, 0), (905, rows[3][1], None)]


# --- whitening -------------------------------------------------------------------------------------------------------


def check_whitened(out, vectors, wanted):
    x = np.floor(64 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = (x - sums / n).T
    values, directions = np.linalg.eigh(off @ off.T / n)
    values, directions = values[::-1][:wanted], directions[:, ::-1][:, :wanted]
    expected = (x - sums / n) @ directions / np.sqrt(values)
    rows = sorted(out, key=lambda r: (r.vec_id, r.component))
    got = np.array([r.whitened for r in rows]).reshape(n, -1)
    assert got.shape == expected.shape
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * signs - expected).max() < 1e-8
    assert [int(r.deviation) for r in rows[:: got.shape[1]]] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert {r.n for r in rows} == {n}
    assert np.allclose([r.explained for r in rows[: got.shape[1]]], values / np.trace(off @ off.T / n), rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
    exact = np.abs(np.cov(got.T, bias=True) - np.eye(got.shape[1])).max()
    assert rows[0].identity_error < 1e-9 and abs(rows[0].identity_error - exact) < 1e-10


def test_registered_whitening(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    out = queries.QUERIES["op12_whiten"](spark, sf_dir)
    assert dict(out.dtypes)["deviation"] == "bigint"
    check_whitened(out.collect(), vectors, 32)


def test_whitening_of_odd_rows(spark):
    rows = odd_rows()
    usable = [(i, v) for i, v, _ in rows if v and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v)]
    check_whitened(whitening.whiten(table_of(spark, rows).repartition(5), 32).collect(), sorted(usable), 12)


def test_tables_without_spread_give_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3, [(1, None, 0), (2, [], 0)]):
        assert whitening.whiten(table_of(spark, rows)).collect() == []
    line = whitening.whiten(table_of(spark, [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(5)] + [(None, [1.0, 2.0, 5.0], 0)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 6  # one direction only; a null id stays
    assert line[0].explained == pytest.approx(1.0)


def test_sums_are_exact_where_doubles_round(spark):
    rows = [(i, [float(2**23 * (i % 3)), float(i), 1.0], 0) for i in range(9)]
    out = {r.vec_id: int(r.deviation) for r in whitening.whiten(table_of(spark, rows), 2, scale=4096.0).collect()}
    x = [[int(4096 * v) + 1_000_000 for v in p] for _, p, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    assert out == {i: sum((9 * v - s) ** 2 for v, s in zip(p, sums)) for i, p in enumerate(x)}
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(table_of(spark, [(1, [1e30], 0), (2, [0.0], 0)])).collect()


@pytest.mark.parametrize("values", [[3.0] * 40, [5.0, 5, 5, 2, 2, 1, 0, 0], [1.0 + 1e-13 * k for k in range(30)], list(range(1, 65)), [10.0 ** -(k / 4) for k in range(40)], [7.0]])
def test_components_of_clustered_spectra(values):
    d = len(values)
    turn, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    matrix = (turn * np.array(values)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    parts = whitening.intervals(matrix, 32)
    assert sum(count for _, _, count in parts) >= min(32, d)
    solved = [whitening.feast(matrix, *p) for p in parts]
    found, directions = np.concatenate([s[0] for s in solved]), np.concatenate([s[1] for s in solved], axis=1)
    assert np.allclose(found, sorted(values, reverse=True)[: len(found)], atol=1e-12 * max(values))
    assert np.abs(directions.T @ directions - np.eye(len(found))).max() < 1e-7
    assert np.abs(matrix @ directions - directions * found).max() < 1e-12 * max(values)


def test_inertia_counts():
    draw = np.random.default_rng(2).standard_normal((30, 30))
    matrix = draw + draw.T
    values = np.linalg.eigvalsh(matrix)
    diagonal, squares = whitening.tridiagonal(matrix)
    for shift in [-100.0, 0.0, 1.5, values[7] + 1e-9, values[7] - 1e-9, 100.0]:
        assert whitening.above(diagonal, squares, shift) == (values > shift).sum()


# --- hard negatives --------------------------------------------------------------------------------------------------


def mined_by_hand(rows, dim=64, every=100):
    kept = {}
    for i, v, y in rows:
        if i is not None and y is not None and v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            y = (y + 1) % 10 if i % 7 == 0 else y
            kept[i] = min(kept.get(i, (y, v)), (y, v))
    ids = sorted(kept)
    grid = {i: [int(np.floor(256 * x)) for x in kept[i][1]] for i in ids}
    found = []
    for a in ids:
        if a % every:
            continue
        ranked = sorted((-sum(p * q for p, q in zip(grid[a], grid[i])), i) for i in ids if i != a)
        for p, pid in [(-s, i) for s, i in ranked if kept[i][0] == kept[a][0]][:5]:
            negatives = [(-s, i) for s, i in ranked if kept[i][0] != kept[a][0] and 80 * p <= -100 * s <= 100 * p][:5]
            found += [(a, pid, k + 1, i, p, s) for k, (s, i) in enumerate(negatives)]
    return sorted(found)


def mined(vectors, every=100):
    from pyspark.sql import functions as F

    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine_hard_negatives(vectors.withColumn("label", turned), F.col("vec_id") % every == 0).collect()))


def test_registered_negatives(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = queries.QUERIES["op13_hard_negatives"](spark, sf_dir)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = mined_by_hand(rows)
    assert sorted(map(tuple, out.collect())) == expected and expected


@pytest.mark.parametrize("shard, window, block", [(16_384, 64, 2048), (40, 4, 7)])
def test_negatives_of_odd_rows(spark, monkeypatch, shard, window, block):
    for name, value in (("SHARD", shard), ("WINDOW", window), ("BLOCK", block)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = odd_rows()
    rows += [rows[10], (20, [9.0] * 12, rows[20][2]), (None, rows[0][1], 1), (-300, rows[160][1], 4)]
    expected = mined_by_hand(rows, 12, 20)
    assert mined(table_of(spark, rows).repartition(6), 20) == expected and len(expected) > 50
    assert mined(table_of(spark, [])) == []
    assert mined(table_of(spark, [(100, [1.0], 1)])) == []


def test_bounds_hold_and_pass_windows_over():
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((6, 16))
    grid = np.floor(256 * (centres[draw.integers(0, 6, 600)] + 0.1 * draw.standard_normal((600, 16)))).astype(np.int64)
    directions = hard_negatives.references(grid)
    norms = np.sqrt((grid.astype(float) ** 2).sum(axis=1))
    angles = np.arccos(np.clip(grid @ directions.T / norms[:, None], -1, 1)).astype(np.float32)
    rows = hard_negatives.Vectors(np.arange(600), np.zeros(600, int), grid, norms, angles.astype(float))
    parts = hard_negatives.windows(rows, angles.argmin(axis=1))
    assert sorted(np.concatenate([w.ids for w in parts]).tolist()) == list(range(600))
    anchors, passed = rows.take(np.arange(0, 600, 10)), 0
    for w in parts:
        least, most = hard_negatives.bounds(anchors, w)
        exact = anchors.grid @ w.grid.T
        assert (hard_negatives.scores(anchors, w) == exact).all()
        assert (least <= exact.min(axis=1)).all() and (exact.max(axis=1) <= most).all()
        passed += (most < np.sort(anchors.grid @ grid.T, axis=1)[:, -5]).sum()
    assert passed > 0.5 * len(parts) * 60  # where vectors lie in groups, most windows can't hold one of the best


def test_large_numbers_stay_whole():
    big = np.array([[1 << 31, 3], [-(1 << 31), 5]], np.int64)
    rows = hard_negatives.Vectors(np.arange(2), np.zeros(2, int), big, np.sqrt((big.astype(float) ** 2).sum(axis=1)), np.zeros((2, 1)))
    assert hard_negatives.scores(rows, rows).tolist() == [[(1 << 62) + 9, 15 - (1 << 62)], [15 - (1 << 62), (1 << 62) + 25]]
    one = np.array([1 << 60])
    assert hard_negatives._within(80, 100, one[:, None], np.array([[1 << 60, (1 << 60) + 1, 1 << 59]])).tolist() == [[True, False, False]]
