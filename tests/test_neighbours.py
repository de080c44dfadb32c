import numpy as np
import pytest

from cohortlens.operators import neighbours
from cohortlens.operators.neighbours import nearest_neighbours


def brute(ids, vectors, k):
    out = {}
    for i, a in zip(ids, vectors, strict=True):
        near = sorted((round(float(np.sqrt(((a - b) ** 2).sum())), 9), j) for j, b in zip(ids, vectors, strict=True) if j != i)[:k]
        out.update({(i, n): (j, d) for n, (d, j) in enumerate(near, 1)})
    return out


def found(spark, ids, vectors, k):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "id long, vec array<double>")
    return {(r.id, r.place): (r.neighbour, r.distance) for r in nearest_neighbours(df, k).collect()}


def test_many_cells_tiles_and_visitors(spark, monkeypatch):
    for name, value in (("MIN_TILE_ROWS", 1), ("MAX_TILE_ROWS", 12), ("VISITORS", 25)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 4)) * 20
    vectors = np.concatenate([centres[rng.integers(7, size=220)] + rng.normal(size=(220, 4)), np.tile(centres[0], (60, 1)), np.round(rng.normal(size=(60, 4)))])
    ids = rng.permutation(1000)[: len(vectors)].tolist()
    assert found(spark, ids, vectors, 5) == brute(ids, vectors, 5)


def test_few_rows_equal_rows_and_null_vectors(spark):
    assert found(spark, [4], [np.ones(3)], 5) == {}
    ids, vectors = [5, 1, 9, 2], np.array([[0.0, 0], [0, 0], [0, 0], [3, 4]])
    assert found(spark, ids, vectors, 2) == brute(ids, vectors, 2)
    df = spark.createDataFrame([(1, None), (2, [1.0]), (3, [2.0])], "id long, vec array<double>")
    assert {(r.id, r.neighbour) for r in nearest_neighbours(df, 3).collect()} == {(2, 3), (3, 2)}
    assert nearest_neighbours(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        nearest_neighbours(spark.createDataFrame([(2, [1.0]), (3, [2.0, 1.0])], "id long, vec array<double>"), 3)
