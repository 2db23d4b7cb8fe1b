import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import topk


def brute(rows, k=3):
    usable = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, q in usable.items():
        if i % 2 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in usable.items() if j != i and len(c) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def found(spark, rows, k=3):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "low": F.lit("x")})
    return {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 2 == 0, k).collect()}


def test_random_vectors_and_ties(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.25, 0.75, 0.01]) for _ in range(5)]) for i in range(60)] + [(100 + i, [0.5] * 5) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_unusable_and_few(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, []), (6, [1.0, 1.0, 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    assert found(spark, rows) == brute(rows) == {(0, 1, 1, 64 * 32 + 128 * -64)}
    assert found(spark, []) == set()


def test_large_components(spark):
    rows = [(0, [3e6, 1e6]), (1, [2e6, -1e6]), (2, [1e6, 5e5]), (3, [1e-3, 9e5])]
    assert found(spark, rows) == brute(rows)


def test_many_cells(spark, monkeypatch):
    """Several rows and columns of the grid, and more than one tile in a cell."""
    r = random.Random(7)
    rows = [(i, [r.choice([-1.5, -0.5, 0.25, 0.75, 2.0]) for _ in range(4)]) for i in range(240)]
    want = brute(rows, 5)
    for queries, candidates, columns in ((17, 31, 1), (200, 50, 1), (11, 1000, 3)):
        monkeypatch.setattr(topk, "QUERIES_EACH", queries)
        monkeypatch.setattr(topk, "CANDIDATES_EACH", candidates)
        monkeypatch.setattr(topk, "LEAST_COLUMNS", columns)
        assert found(spark, rows, 5) == want


def test_tiles_cover_a_cell(monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_EACH", 7)
    monkeypatch.setattr(topk, "TILE", 20)
    q, c = np.arange(10.0).reshape(5, 2), np.arange(40.0).reshape(20, 2)
    got = np.zeros((5, 20))
    for i, s, j in topk._tiles(q, c):
        assert s.size <= 20
        got[i : i + len(s), j : j + s.shape[1]] += s
    assert (got == q @ c.T).all()
