"""Operator 12 against plain TF-IDF cosines, and on the held-out labels of the provided tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import nearest_examples as near
from tallyspark.llm.entries import REGISTRY


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if c.isascii() else c for c in text or ""))


def slow_model(rows, labels):
    """(idf by word, examples as (id, label, vector)) of the teaching rows, none left out."""
    text = dict(rows)
    taught = [(i, y, Counter(words(text[i]))) for i, y in labels if y in (0, 1) and i in text and not out(i)]
    n, ones = len(taught), sum(y for _, y, _ in taught)
    with_word = Counter(w for _, _, c in taught for w in c)
    with_one = Counter(w for _, y, c in taught if y for w in c)

    def chi(w):
        a, m = with_one[w], with_word[w]
        b, c, d = m - a, ones - a, n - ones - (m - a)
        low = m * (c + d) * (a + c) * (b + d)
        return n * (a * d - b * c) ** 2 / low if low else 0.0

    chosen = {w for w in with_word if chi(w) >= near.LEAST_CHI}
    assert 5 < len(chosen) <= near.TERMS
    counts = Counter(w for _, t in rows for w in set(words(t)))
    idf = {w: math.log1p(len(rows) / counts[w]) for w in chosen}
    return idf, [(i, y, vector(c, idf)) for i, y, c in taught]


def vector(counts, idf):
    v = {w: (1 + math.log(k)) * idf[w] for w, k in counts.items() if w in idf}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / size for w, x in v.items()}


def cosine(a, b):
    return sum(x * b[w] for w, x in a.items() if w in b)


def small_tables(seed, n=400):
    rng = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(25)], [f"Bad{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(1, n + 1):
        toxic = rng.random() < 0.3
        some = rng.choices(plain, k=rng.randint(3, 20)) + (rng.choices(bad, k=3) if toxic else rng.choices(bad, k=1) * (i % 9 == 0))
        rows.append((i, " ".join(some)))
        if i % 4:
            labels.append((i, int(toxic)))
    return rows, labels


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in rows], "doc_id long, text string, label string, score double")
    return docs, spark.createDataFrame([(i, y, "x") for i, y in labels], "doc_id long, toxic int, text string")


def test_neighbours_equal_a_direct_search(spark):
    rows, labels = small_tables(1)
    idf, examples = slow_model(rows, labels)
    got = {r.doc_id: r for r in near.score_toxicity(*tables(spark, rows, labels)).collect()}
    assert len(got) == len(rows) and sum(bool(r.evidence) for r in got.values()) > 100
    for i, text in rows:
        mine = vector(Counter(words(text)), idf)
        # Equal vectors of a label are one example, with the smallest id.
        first = {}
        for j, y, v in sorted(examples, key=lambda e: e[0]):
            if v:
                first.setdefault((y, tuple(sorted((w, round(x, 12)) for w, x in v.items()))), (j, v))
        best = sorted((cosine(mine, v) for j, v in first.values() if j != i), reverse=True)[:near.NEAREST]
        best = [c for c in best if c > 0]
        assert np.allclose([e.cosine for e in got[i].evidence], best, atol=1e-12)
        assert all(e.id != i and not out(e.id) for e in got[i].evidence)
        assert got[i].held_out == out(i) and got[i].predicted == (got[i].score >= 0.5)


def test_blocks_left_out_hold_no_neighbour():
    rng = np.random.default_rng(4)
    n, terms = 2_000, 60
    lists = [np.sort(rng.choice(60, rng.integers(0, 9), replace=False)).tolist() for _ in range(n)]
    lists.sort(key=lambda x: x[-1:] or [0])
    kind = pa.list_(pa.int32())
    counts = pa.array([rng.integers(1, 9, len(x)).tolist() for x in lists], kind)
    idf = rng.uniform(0.5, 5, terms)
    index = near.BlockMaxIndex(pa.array(lists, kind), counts, idf)
    queries = near.Vectors(pa.array(lists, kind), counts, idf)
    dense = np.zeros((n, terms))
    dense[queries.row, queries.term] = queries.weight
    scored = []
    score = index._score
    index._score = lambda v, rows, blocks: scored.append(len(rows)) or score(v, rows, blocks)
    example, found = index.nearest(queries, np.arange(n), 5)
    exact = dense @ dense.T
    exact[np.diag_indices(n)] = 0
    assert np.allclose(found, np.sort(exact, 1)[:, ::-1][:, :5])
    assert np.allclose(exact[np.arange(n)[:, None], np.minimum(example, n - 1)][found > 0], found[found > 0])
    assert sum(scored) < 0.6 * n * index.blocks


def test_odd_rows_have_defined_results(spark):
    rows, labels = small_tables(2)
    rows += [(901, None), (902, ""), (903, " ... "), (3, rows[2][1]), (None, "Bad1 Bad2 Bad3"), (904, "Bad1 Bad2 Bad3 " * 50_000)]
    labels += [(901, 1), (None, 1), (902, None), (903, 7), (3, 1), (99999, 1)]
    got = near.score_toxicity(*tables(spark, rows, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[904].predicted == 1 and by_id[None].predicted == 1 and by_id[None].held_out is False
    assert by_id[901].score == by_id[902].score == by_id[903].score < 0.5 and by_id[901].evidence == []


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(i, 0) for i in range(1, 40)], 0.0), ([(i, 1) for i in range(1, 40)], 1.0)])
def test_one_class_or_none(spark, labels, score):
    rows, _ = small_tables(3, 40)
    assert {r.score for r in near.score_toxicity(*tables(spark, rows, labels)).collect()} == {score}


def test_empty_tables(spark):
    assert near.score_toxicity(*tables(spark, [], [])).collect() == []


def test_term_counts_are_whole(spark, monkeypatch):
    monkeypatch.setattr(near, "HELD_TERMS", 8)
    rows, labels = small_tables(5)
    taught = [(t, y) for (i, t), y in zip(rows, [0, 1] * 200)]
    got = near.term_counts(spark.createDataFrame(taught, "text string, label int")).collect()
    want = Counter((w, y) for t, y in taught for w in set(words(t)))
    assert sorted((r.n, r.ones) for r in got) == sorted(
        (want[w, 0] + want[w, 1], want[w, 1]) for w in {w for w, _ in want})


def test_held_out_labels_are_met(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = REGISTRY["op12_toxicity"](spark, sf_dir)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if out(r.doc_id)]
    assert all(r.held_out == out(r.doc_id) for r in rows) and len(held) > 500
    toxic = [r for r in held if r.toxic]
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    ranks = sorted(held, key=lambda r: r.score)
    above = sum(sum(not x.toxic for x in ranks[:i]) for i, r in enumerate(ranks) if r.toxic)
    assert above >= 0.95 * len(toxic) * len(clean)
    # Calibration: the mean score is near the share of toxic documents.
    assert abs(sum(r.score for r in held) / len(held) - len(toxic) / len(held)) < 0.03
