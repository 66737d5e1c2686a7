"""Queries of operators 2 and 9, and the pipeline's first stage, against plain Python over the provided tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyspark.llm import quality
from tallyspark.llm.entries import REGISTRY, table


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]


def test_shards_of_the_query(spark, sf_dir):
    rows = REGISTRY["op2_shards"](spark, sf_dir).collect()
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in documents(spark, sf_dir)}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want and len(rows) == len(want)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(count))
    again = REGISTRY["op2_shards"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    # A shuffle: neighbours in the table are no neighbours in the shards.
    place = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(abs(a - b) == 1 for a, b in zip(place, place[1:])) < len(rows) / 20


SOLID = re.compile(rb"[A-Za-z0-9\x80-\xff]")
SYMBOL = re.compile(rb"[^A-Za-z0-9\x80-\xff.,;:?'\"()\-\x00-\x20]")


def slow_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, low = len(words), [w.lower() for w in words]
    if not n:
        return [0.0] * 14
    lengths = [len(w) for w in words]
    mean, square = (sum(lengths) + 180) / (n + 30), (sum(x * x for x in lengths) + 1500) / (n + 30)
    grams = {tuple(low[i:i + 3]) for i in range(max(1, n - 2))}

    def share(count, usual):
        return math.sqrt((count + 30 * usual) / (n + 30))

    return [
        math.log1p(n), math.log(mean), math.log(max(square - mean * mean, 0) + 1),
        share(len(re.findall(rb"[A-Z]", raw)), 0.1), share(len(SYMBOL.findall(raw)), 0),
        share(sum(a == b for a, b in zip(low, low[1:])), 0), math.log((len(set(low)) + 30) / (n + 30)),
        share(sum(not SOLID.search(w) for w in words), 0), share(sum(bool(SYMBOL.match(w[-1:])) for w in words), 0),
        share(raw.count(b"."), 0.09), share(raw.count(b","), 0.05), share(raw.count(b"\n"), 0.015),
        share(len(re.findall(rb"[0-9]", raw)), 0), share(max(1, n - 2) - len(grams), 0)]


ODD = [None, "", " \n", "a", "A a", "a b c", "x\x1f% %% $9", "né ñ!", "the the THE, the.", "1,2 3.4\n\n-- %", "w " * 5000]


def test_statistics_equal_plain_python(spark, sf_dir):
    texts = documents(spark, sf_dir) + [(-1 - i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.stats for r in quality.with_statistics(frame).collect()}
    for i, text in texts:
        assert got[i] == pytest.approx(slow_statistics(text), abs=1e-9), (i, (text or "")[:50])


def slow_scores(spark, sf_dir):
    """Posterior of class 1 by the closed form, from all labelled rows that are not held out."""
    docs = documents(spark, sf_dir)
    x = {i: np.array(slow_statistics(t)) for i, t in docs}
    labels = [(r.doc_id, r.quality) for r in table(spark, sf_dir, "labels").collect()]
    odds = {}
    for y in (0, 1):
        mine = np.array([x[i] for i, q in labels if q == y and i in x and zlib.crc32(str(i).encode()) % 5])
        mean, cov = mine.mean(0), np.cov(mine.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(14)
        for i, v in x.items():
            away = v - mean
            odds[i, y] = math.log(len(mine)) - 0.5 * (np.linalg.slogdet(cov)[1] + away @ np.linalg.solve(cov, away))
    gap = {i: odds[i, 1] - odds[i, 0] for i in x}
    return {i: 1 / (1 + math.exp(-g / (1 + abs(g) / quality.SOFT_LIMIT))) for i, g in gap.items()}


def test_scores_of_the_query(spark, sf_dir):
    want = slow_scores(spark, sf_dir)
    rows = REGISTRY["op9_quality"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_quality_stage_keeps_what_scores_well(spark, sf_dir):
    want = slow_scores(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    clear = {i for i, s in want.items() if abs(s - 0.3) > 1e-6}
    assert {r.doc_id for r in kept.collect()} & clear == {i for i in clear if want[i] >= 0.3}
