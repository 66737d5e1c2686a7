"""Operator 11 against a direct search of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import hard_negatives
from tallyspark.llm.hard_negatives import LARGEST, MultiIndex, least_score


def slow(rows, scale=256, take=5):
    """rows: (id, label, vector); every anchor against every row by whole numbers."""
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        usable[i] = min(usable.get(i, row), row)
    out = []
    for a, (label, v) in usable.items():
        if a % 100:
            continue
        scored = [(-max(-LARGEST, min(LARGEST, sum(x * y for x, y in zip(v, w)))), i, other)
                  for i, (other, w) in usable.items() if len(w) == len(v) and i != a]
        scored.sort()
        for ps, p, _ in [s for s in scored if s[2] == label][:take]:
            fit = [(n, s) for s, n, other in scored if other != label and 80 * -ps <= 100 * -s <= 100 * -ps]
            out += [(a, p, r, n, -ps, -s) for r, (n, s) in enumerate(fit[:take], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int, score string, id int, rank int"


def mined(spark, rows):
    table = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, label, v in rows], SCHEMA)
    return hard_negatives.mine(table, is_anchor=F.col("vec_id") % 100 == 0)


def clustered(seed, n, length=12):
    """Few directions, many equal vectors, one label that holds a third of the rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, length))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=length) * rng.choice([0, 0.05, 0.4])
        out.append((int(rng.integers(0, 3000)), int(rng.choice([0, 0, 1, 2])), [float(x) for x in v / np.linalg.norm(v)]))
    return out


def test_equals_a_direct_search(spark):
    rows = clustered(1, 3000)
    rows += [(100 * i, i % 3, rows[5][2]) for i in range(8)] + [(7000 + i, i % 2, rows[5][2]) for i in range(400)]
    got = sorted(tuple(r) for r in mined(spark, rows).collect())
    assert len(got) > 300 and got == slow(rows)


def test_random_vectors_without_structure(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), rng.normal(size=17).tolist()) for i in range(1500)]
    assert sorted(tuple(r) for r in mined(spark, rows).collect()) == slow(rows)


def test_odd_rows_have_defined_results(spark):
    v = [0.5, 0.25, 1.0]
    rows = [(0, 1, v), (0, 1, v), (1, 1, v), (2, 2, v), (2, 2, v), (3, 2, [0.4, 0.25, 1.0]), (4, None, v), (None, 1, v),
            (5, 2, None), (6, 2, []), (7, 2, [1.0, None, 0.0]), (8, 2, [math.inf, 0.0, 0.0]), (9, 2, [math.nan, 1.0, 1.0]),
            (10, 2, [0.5, 0.25]), (100, 1, [0.0, 0.0, 0.0]), (200, 3, v), (300, 1, [-1.0, -1.0, -1.0]), (400, 9, [1e9] * 3),
            (401, 9, [2e9] * 3), (402, 8, [1.9e9] * 3), (500, 5, [1.0]), (501, 5, [0.5]), (502, 6, [0.45])]
    got = sorted(tuple(r) for r in mined(spark, rows).collect())
    assert got == slow(rows)
    assert (0, 1, 1, 2, 21504 * 4, 21504 * 4) in got and any(r[0] == 400 for r in got)
    assert mined(spark, []).collect() == []


def test_a_zero_vector_has_ties_only(spark):
    """All scores are zero, and the smallest ids win."""
    rows = [(100, 1, [0.0, 0.0])] + [(i, i % 2, [float(i), 1.0]) for i in range(1, 40)]
    got = sorted(tuple(r) for r in mined(spark, rows).collect() if r.anchor_id == 100)
    assert got == [r for r in slow(rows) if r[0] == 100] and [r[3] for r in got[:5]] == [2, 4, 6, 8, 10]


def test_cells_come_by_falling_bound_and_bound_their_rows():
    rng = np.random.default_rng(0)
    vectors = np.floor(256 * rng.normal(size=(2000, 11)))
    index = MultiIndex(np.arange(2000), np.zeros(2000, np.int64), vectors)
    query = vectors[3]
    cells = list(index.cells(query))
    assert sorted(c for _, c in cells) == list(range(index.size**2)) and index.size > 5
    assert [b for b, _ in cells] == sorted((b for b, _ in cells), reverse=True)
    for bound, cell in cells:
        inside = index.vectors[index.starts[cell]:index.starts[cell + 1]]
        assert not len(inside) or (inside @ query).max() <= bound


def test_search_stops_early_on_clustered_vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    vectors = np.floor(256 * (centres[rng.integers(40, size=20_000)] + 0.05 * rng.normal(size=(20_000, 16))))
    index = MultiIndex(np.arange(20_000), np.zeros(20_000, np.int64), vectors)
    scored = []
    score = index.scores
    index.scores = lambda rows, query: scored.append(len(rows)) or score(rows, query)
    (ids, scores), = index.top(vectors[7], 5, lambda r: np.ones(len(r), bool))
    exact = vectors @ vectors[7]
    assert scores.tolist() == np.sort(exact)[::-1][:5].tolist() and sum(scored) < 4_000


@pytest.mark.parametrize("high", [-7, -1, 0, 1, 4, 5, 99, 100, 101])
def test_least_score(high):
    low = least_score(high, 80)
    assert 80 * high <= 100 * low and 80 * high > 100 * (low - 1)
