"""Spherical-cap filters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import cap_filters
from tallyspark.llm.entries import REGISTRY, table

SCHEMA = "vec_id long, embedding array<float>, label int, id string, links int"


def brute(rows, cosine=0.93, kind=np.float32):
    parent, links = {}, {}
    good = []
    for i, v, label in rows:
        links[i], parent[i] = 0, i
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, kind).astype(float)
            good.append((i, v / np.linalg.norm(v), label))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x, p) in enumerate(good):
        for b, y, q in good[k + 1:]:
            if p == q and len(x) == len(y) and x @ y >= cosine:
                links[a] += 1
                links[b] += 1
                r, s = root(a), root(b)
                parent[max(r, s)] = min(r, s)
    return {i: (links[i], root(i), root(i) == i) for i in links}


def pairs(n, cosine, length, rng):
    a = rng.normal(size=(n, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, length))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("width", [64, 128, 256])
def test_pairs_at_the_limit_share_a_filter(width):
    a, b = pairs(1500, 0.93, 64, np.random.default_rng(2))
    codes = cap_filters.codes_for(width)(64)
    found = [set() for _ in a]
    both = [np.zeros(0)] * 2
    for side, unit in enumerate((a, b)):
        row, cell = cap_filters.filters_of(unit, codes)
        both[side] = set(zip(row.tolist(), cell.tolist()))
    for row, _ in both[0] & both[1]:
        found[row].add(1)
    assert np.mean([bool(f) for f in found]) >= 0.97
    assert 20 <= len(both[0]) / len(a) <= 55


@pytest.mark.parametrize("width", [512, 1024, 2048, 4096, 8192])
def test_recall_does_not_fall_with_the_width(width):
    a, b = pairs(400, 0.93, 64, np.random.default_rng(2))
    codes = cap_filters.codes_for(width)(64)
    first, second = (set(zip(*(x.tolist() for x in cap_filters.filters_of(unit, codes)))) for unit in (a, b))
    assert len({row for row, _ in first & second}) / len(a) >= 0.97


@pytest.mark.parametrize("chunk", [512, 4])
def test_links_and_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cap_filters, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    rows = []
    for label in (1, 2):
        base = rng.normal(size=(12, 16))
        for b in base:
            for _ in range(rng.integers(1, 14)):
                rows.append((b + rng.normal(scale=0.12, size=16)).tolist() + [label])
    rows = [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    copies = [(1000 + k, rows[k % 5][1], rows[k % 5][2]) for k in range(30)]
    odd = [
        (2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] + [1.0] * 15, 1),
        (2005, [float("inf")] * 16, 1), (2006, rows[0][1], None), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1),
        (2009, [3.0], 1), (2010, [-0.0, 1.0], 2), (2011, [0.0, 1.0], 2), (2012, [1e30] * 16, 3), (2013, [1e-30] * 16, 3),
    ]
    every = rows + copies + odd
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in every], SCHEMA)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_duplicates(frame).collect()}
    assert got == brute(every)


def test_double_vectors_and_labels_of_any_type(spark):
    """Pairs a billionth beside the limit, which single precision does not tell apart, and labels between whole numbers."""
    rng = np.random.default_rng(5)
    rows = []
    for k, limit in enumerate([0.93 - 1e-9, 0.93 + 1e-9] * 12):
        a, b = pairs(1, limit, 16, rng)
        rows += [(10 * k, a[0].tolist(), 1.5 + k), (10 * k + 1, b[0].tolist(), 1.5 + k), (10 * k + 2, a[0].tolist(), 1.25 + k)]
    frame = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<double>, label double")
    want = brute(rows, kind=float)
    assert sum(n for n, _, _ in want.values()) == 24
    for some in (frame, frame.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))):
        got = {r.id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_duplicates(some).collect()}
        assert got == want


def test_null_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(None, [1.0], 1, "x", 1), (5, [1.0], 1, "x", 1)], SCHEMA)
    got = sorted((r.id or 0, r.n_links, r.kept) for r in cap_filters.near_duplicates(frame).collect())
    assert got == [(0, 0, False), (5, 0, True)]
    assert cap_filters.near_duplicates(frame.limit(0)).count() == 0


def test_query_on_the_smallest_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf_dir, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in REGISTRY["op1_cap_filters"](spark, sf_dir).collect()}
    assert got == brute(rows)
