"""Operator 13 against a direct search of all periods of small texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyspark.llm import periodic_runs
from tallyspark.llm.entries import REGISTRY


def slow_runs(words, least=24, repeats=3):
    """(start, length, period) of every run, by trying every period at every place."""
    n, runs = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                stretch = words[i:j + q]
                if all(stretch[:-d] != stretch[d:] for d in range(1, q)):
                    runs.append((i, j + q - i, q))
            i = j
    return sorted(runs, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def slow_digest(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_texts(rng, count):
    """Word lists with nested, adjacent and cut-off repetitions over few words."""
    for _ in range(count):
        words, letters = [], rng.choice([2, 3, 30])
        for _ in range(rng.randint(1, 6)):
            block = [str(rng.randrange(letters)) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
            if rng.random() < 0.3:
                block = block * rng.randint(2, 12) + ["x"]
            words += block * rng.choice([1, 2, 3, 4, 9, 30]) + block[:rng.randint(0, len(block))]
        yield words[:700]


def fast(lists):
    numbers = {w: i for i, w in enumerate(sorted({w for words in lists for w in words}))}
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
    flat = np.array([numbers[w] for words in lists for w in words], np.int64)
    start, end, period = periodic_runs.runs_of(flat, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    out = [[] for _ in lists]
    for r, s, e, q in zip(row, start, end, period):
        out[r].append((int(s - offsets[r]), int(e - s), int(q)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_a_direct_search(seed):
    lists = list(periodic_texts(random.Random(seed), 25))
    assert fast(lists) == [slow_runs(w) for w in lists]


def test_runs_of_known_words():
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 500:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    thue = ["a" if bin(i).count("1") % 2 else "b" for i in range(600)]
    lists = [["a"] * 23, ["a"] * 24, ["a"] * 500, (["a"] * 40 + ["b"]) * 9, fibonacci[1], thue, [], ["x"],
             ["a", "b", "c"] * 8, ["a", "b", "c"] * 8 + ["a"], list("abcdefgh") * 3, list("abcdefghi") * 3]
    assert fast(lists) == [slow_runs(w) for w in lists]


def test_long_periodic_texts_take_linear_work():
    """A million equal words, and a long nested repetition."""
    many = np.zeros(1_000_000, np.int64)
    assert periodic_runs.runs_of(many, np.array([0, len(many)])).T.tolist() == [[0, len(many), 1]]
    nested = np.tile(np.concatenate([np.zeros(99, np.int64), [1]]), 2_000)
    runs = periodic_runs.runs_of(nested, np.array([0, len(nested)])).T.tolist()
    assert [0, len(nested), 100] in runs and len(runs) == 2_001


SCHEMA = "doc_id long, text string, runs string, extra int"


def test_odd_rows_have_defined_results(spark):
    spam = "buy now \t" * 30
    rows = [(1, None, "r", 1), (2, "", "r", 2), (3, " \n\x0b\x0c ", "r", 3), (4, spam, "r", 4), (4, spam, "r", 4),
            (None, spam + "ende x", None, None), (7, "\x1c\x85 a" * 30, "r", 7)]
    found = periodic_runs.find_runs(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "extra", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.extra, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    run = [(0, 60, 2)]
    assert sorted(got, key=repr) == sorted([
        (1, 1, 0, [], ""), (2, 2, 0, [], ""), (3, 3, 0, [], ""), (4, 4, 60, run, "buy now"), (4, 4, 60, run, "buy now"),
        (None, None, 61, run, "buy now ende x"), (7, 7, 31, [(1, 29, 1)], "\x1c\x85 a\x1c\x85 a")], key=repr)
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_short_runs_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs.find_runs(spark.createDataFrame([], SCHEMA), least=10)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(w) for w in periodic_texts(rng, 120)] + [None, "", "one", "  two\nwords "]
    rows = [(i * 7 + 1, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in REGISTRY["op13_periodic_runs"](spark, str(tmp_path)).collect())
    assert got == sorted(slow_digest(i, t) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


def test_query_over_the_provided_documents(spark, sf_dir):
    found = REGISTRY["op13_periodic_runs"](spark, sf_dir)
    assert [f.dataType for f in found.schema][:6] == [T.LongType()] * 6
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in found.collect()}
    short = [i for i, t in texts.items() if len((t or "").split()) < 400]
    assert len(short) > 100 and got.keys() == texts.keys()
    assert [got[i] for i in short] == [slow_digest(i, texts[i]) for i in short]
