"""Words, shingle sets and the n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark import session
from tallyspark.llm import group_join
from tallyspark.llm.components import connected_components
from tallyspark.llm.entries import REGISTRY, table
from tallyspark.llm.words import ALPHANUMERIC, NOT_BLANK, shingle_sets, slices


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def set_of(text, size):
    w = words_of(text)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows, size, percent):
    sets = {i: set_of(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é　 \t\n\x0b.,-", max_size=30)), max_size=8))
def test_words_equal_the_regular_expressions(texts):
    column = pa.array(texts, pa.string())
    for table_, pattern in ((NOT_BLANK, r"[^\x20\x09-\x0D]+"),
                            (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for _, w in slices(column, table_):
            found += [[w.text(k, 1).decode() for k in range(w.first[r], w.first[r + 1])] for r in range(w.rows)]
        assert found == [re.findall(pattern, lowered(t)) for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    texts = ["one two three", "  one\n two\tTHREE ", "x" * 50 + " one two three"]
    sets = [set(s.tolist()) for _, w in slices(pa.array(texts), NOT_BLANK) for s in shingle_sets(w, 3)]
    assert sets[0] == sets[1] and sets[0] < sets[2]
    alone = [set(s.tolist()) for t in texts for _, w in slices(pa.array([t]), NOT_BLANK) for s in shingle_sets(w, 3)]
    assert alone == sets


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(8, 40)] + [(3, 3), (2, 1)]
    found = connected_components(spark.createDataFrame(edges + [(None, 5)], "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**dict.fromkeys(range(100, 131), 100), **dict.fromkeys(range(7, 40), 7), 3: 3, 2: 1, 1: 1}


def family(rng, base, n, edits):
    rows = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    return rows


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, monkeypatch, size, percent):
    # Small blocks, so that groups have several and blocks of many members are opened.
    monkeypatch.setattr(group_join, "BLOCK", 3)
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [None, "", "  \n", "one", "One", "one two", "one two three", "a b a b a b a b", "a b " * 4000]
    for _ in range(6):
        texts += family(rng, rng.choices(vocabulary, k=rng.randrange(20, 200)), 25, 6)
    shared = " ".join(rng.choices(vocabulary, k=60))
    texts += [shared + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12))) for _ in range(40)]
    texts += texts[20:30]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, component int")
    got = group_join.jaccard_components(docs, size=size, percent=percent).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size, percent)
    assert len(got) == len(rows)


def test_null_ids_equal_ids_and_no_rows(spark):
    schema = "doc_id long, text string, id string, n int"
    docs = spark.createDataFrame([(None, "a b c d", "k", 0), (1, "a b c d", "k", 0), (1, "a b c d", "k", 0)], schema)
    got = sorted((r.id or 0, r.component_id or 0) for r in group_join.jaccard_components(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1)]
    kept = group_join.keep_first(docs, size=3)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]
    none = spark.createDataFrame([], schema)
    assert group_join.jaccard_components(none).count() == 0 and group_join.keep_first(none).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_rows_with_one_id_and_different_texts_stay(spark, order):
    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    rows = [(7, one, "x"), (7, two, "x"), (7, two, "x"), (3, one, "x"), (9, three, "x"), (5, three, "x"), (5, three, "y"),
            (5, "", "x"), (None, one, "x"), (12, two, "x")]
    docs = spark.createDataFrame(rows[::order], "doc_id long, text string, n string")
    got = sorted(((r.doc_id or 0, r.text) for r in group_join.keep_first(docs.repartition(3), size=3).collect()))
    assert got == sorted([(0, one), (3, one), (5, ""), (5, three), (7, two)])
    kept = [sorted(r.n for r in group_join.keep_first(docs.repartition(k), size=3).collect()) for k in (1, 4)]
    assert kept[0] == kept[1]


def test_links_are_found_once_and_only_the_result_stays(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    searched = []
    monkeypatch.setattr(group_join, "connected_components", lambda e: searched.append(e) or connected_components(e))
    rng = random.Random(8)
    texts = family(rng, [f"v{i}" for i in range(60)], 12, 3) + family(rng, [f"u{i}" for i in range(60)], 12, 3)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def labels():
        return sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "tallyspark").iterdir())

    expected = brute_components(rows, 3, 90)
    got = group_join.jaccard_components(docs)
    assert labels() == ["members"]
    assert {r.id: (r.n_shingles, r.component_id) for r in got.collect()} == expected
    # Links that are not stored would be searched for again by each pass over them.
    plans = [e._jdf.queryExecution().optimizedPlan().toString() for e in searched]
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)
    kept = group_join.keep_first(docs, size=3, percent=90)
    assert labels() == ["members", "members", "repeated-ids"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected.values()})
    with session.scratch(spark):
        assert group_join.jaccard_components(docs).count() == 24
        assert labels() == ["members", "members", "members", "repeated-ids"]
    assert labels() == ["members", "members", "repeated-ids"]


def test_query_on_the_smallest_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in REGISTRY["op7_group_join"](spark, sf_dir).collect()}
    assert got == brute_components(rows, 3, 90)


def test_prefix_holds_the_required_tokens():
    n = np.arange(1, 3000)
    for percent in (80, 90, 100):
        assert (group_join.required(n, percent) >= 1).all()
        assert (group_join.required(n, percent) <= group_join.needed(n, percent)).all()
