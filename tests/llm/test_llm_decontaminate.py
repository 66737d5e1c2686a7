"""Wu-Manber search against plain search."""

import hashlib
import random
import re

import pytest

from tallyspark.llm import decontaminate
from tallyspark.llm.entries import REGISTRY, table


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, width=10):
    windows = []
    for item, text in items:
        w = words_of(text)
        m = min(width, len(w))
        windows += [(item, w[i:i + m]) for i in range(len(w) - m + 1)] if m else []
    result = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        names = sorted({str(f) for f in found if f is not None})
        result.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return result


def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünd", "x1", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(11, 40)))) for i in range(8)]
    items += [(90, "only three words"), (91, "w1"), (92, ""), (93, None), (None, "a b c d e f g h i j k"), (95, items[0][1])]
    docs = [(0, None), (1, ""), (2, "... --- !!!"), (3, "a b c d e f g h i j k"), (4, "Only, THREE words. w1")]
    for i in range(5, 40):
        parts = rng.choices(vocabulary, k=rng.randrange(5, 700))
        if i % 3 == 0:
            text = rng.choice(items[:8])[1].split()
            start = rng.randrange(len(text) - 9)
            parts[len(parts) // 2:len(parts) // 2] = text[start:start + rng.randrange(9, 20)]
        docs.append((i, rng.choice([" ", "  ", ", "]).join(parts)))
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_marks_equal_plain_search(spark, block):
    docs, items = planted()
    found = decontaminate.mark_contaminated(
        spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_words int").repartition(3),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hit_items string"),
        block_patterns=block)
    got = sorted(tuple(r) for r in decontaminate.digest(found).collect())
    assert got == sorted(brute(docs, items))


def test_no_items_no_documents_and_own_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 6)], "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, none)
    assert clean.columns == docs.columns and sorted(r.n_words for r in clean.collect()) == [5, 5, 6]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.n_words for r in decontaminate.drop_contaminated(docs, some).collect()] == [6]
    assert decontaminate.mark_contaminated(docs.limit(0), some).count() == 0


def test_query_on_the_smallest_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = sorted(tuple(r) for r in REGISTRY["op10_decontaminate"](spark, sf_dir).collect())
    assert got == sorted(brute(docs, items))
