"""Sharding and mixing: exact sizes, distributions, budgets against plain arithmetic."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing, shards
from tallyspark.llm.entries import MIX_WEIGHTS, REGISTRY, mix_levels, table


@pytest.mark.parametrize("good, bad, draws", [(0, 5, 3), (5, 0, 3), (7, 9, 16), (30, 50, 20), (400, 100, 250)])
def test_hypergeometric_has_its_support_mean_and_variance(good, bad, draws):
    rng = random.Random(1)
    n = 4000
    values = [shards.hypergeometric(rng, good, bad, draws) for _ in range(n)]
    total = good + bad
    mean = draws * good / total
    variance = mean * bad / total * (total - draws) / (total - 1)
    assert max(0, draws - bad) <= min(values) and max(values) <= min(good, draws)
    assert abs(sum(values) / n - mean) <= 5 * (variance / n) ** 0.5 + 1e-9
    assert abs(sum((v - mean) ** 2 for v in values) / n - variance) <= 0.15 * variance + 1e-9


def test_hypergeometric_follows_its_probabilities():
    rng, n = random.Random(9), 40_000
    counts = collections.Counter(shards.hypergeometric(rng, 6, 9, 7) for _ in range(n))
    for k in range(7):
        p = math.comb(6, k) * math.comb(9, 7 - k) / math.comb(15, 7)
        assert abs(counts[k] - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 1


def test_hypergeometric_of_very_many_rows_stays_near_its_mean():
    value = shards.hypergeometric(random.Random(3), 10**9, 4 * 10**10, 10**8)
    assert abs(value - 10**8 / 41) < 20_000


def test_matrix_keeps_both_sums():
    parts, blocks = [5, 0, 100, 37], shards.even(142, 9)
    matrix = shards.communication_matrix(parts, blocks, 4)
    assert [sum(r) for r in matrix] == parts and [sum(c) for c in zip(*matrix)] == blocks
    assert matrix == shards.communication_matrix(parts, blocks, 4) != shards.communication_matrix(parts, blocks, 5)


def placed(frame, n=7, seed=3):
    by_shard = collections.defaultdict(list)
    for r in shards.shuffle_to_shards(frame, n, seed).collect():
        by_shard[r.shard].append(r.slot)
    return by_shard


@pytest.mark.parametrize("rows", [250_000, 6])
def test_shards_are_even_gapless_and_repeatable(spark, monkeypatch, rows):
    # Few rows in a block make several blocks per shard.
    monkeypatch.setattr(shards, "ROWS", rows)
    monkeypatch.setattr(shards, "MOST", 2000 if rows > 6 else 40)
    frame = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(None).cast("string").alias("text"),
        (F.col("id") % 50).alias("shard"), F.lit("x").alias("slot"), F.lit(1).alias("_part"))
    found = placed(frame)
    assert sorted(map(len, found.values())) == [71] * 4 + [72] * 3 and set(found) == set(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
    ids = frame.filter("doc_id is not null").select("doc_id")
    one = {r.doc_id: (r.shard, r.slot) for r in shards.shuffle_to_shards(ids, 5, 1).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in shards.shuffle_to_shards(ids.repartition(13), 5, 1).collect()}
    assert one == two


def test_every_place_is_as_likely(spark):
    counts = collections.Counter()
    frame = spark.range(40).coalesce(1)
    for seed in range(30):
        counts.update(r.shard for r in shards.shuffle_to_shards(frame, 4, seed).filter("id < 20").collect())
    # 30 draws of 20 of 40 rows: 150 a shard on the average, deviation about 9.
    assert all(110 < counts[s] < 190 for s in range(4))


def test_fewer_rows_than_shards_and_none(spark):
    found = placed(spark.range(3))
    assert {s: sorted(v) for s, v in found.items()} == {0: [0], 1: [0], 2: [0]}
    assert placed(spark.range(0)) == {}


def test_shard_query(spark, sf_dir):
    rows = REGISTRY["op2_shards"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(docs) and {r.shard for r in rows} <= set(range(40))
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


# --- mixing --------------------------------------------------------------------------

def share(budget, children):
    """Budgets by rounds: give by weight, cap at capacity, share out what is left among the others."""
    given = dict.fromkeys(children, 0)
    full = set()
    while True:
        open_ = {c: w for c, (w, _) in children.items() if c not in full}
        left = budget - sum(children[c][1] for c in full)
        over = {c for c, w in open_.items() if children[c][1] * sum(open_.values()) <= w * left}
        if not over:
            break
        full |= over
    for c in full:
        given[c] = children[c][1]
    if open_:
        for c, w in open_.items():
            given[c] = w * left // sum(open_.values())
        spare = left - sum(given[c] for c in open_)
        order = sorted(open_, key=lambda c: (children[c][1] / children[c][0], c))
        for c in order[:spare]:
            given[c] += 1
    return given


def brute_mix(docs, weights, percent, max_epochs, seed):
    """docs: (id, (level values), tokens). The rows taken, with their epochs."""
    supply = collections.Counter()
    for _, leaf, n in docs:
        supply[leaf] += n
    depth = len(next(iter(supply)))

    def weight(leaf):
        return [w.get(v, 1) for w, v in zip(weights, leaf)]

    cap = {leaf: s * max_epochs * all(w > 0 for w in weight(leaf)) for leaf, s in supply.items()}
    nodes = {(): min(sum(supply.values()) * percent // 100, sum(cap.values()))}
    for d in range(depth):
        below = {}
        for node, budget in nodes.items():
            children = {}
            for leaf in supply:
                if leaf[:d] == node:
                    w, c = children.get(leaf[:d + 1], (max(weight(leaf)[d], 1), 0))
                    children[leaf[:d + 1]] = (w, c + cap[leaf])
            below |= share(budget, children)
        nodes = below
    taken = []
    for leaf, budget in nodes.items():
        whole = budget // supply[leaf] if supply[leaf] else 0
        rest, used = budget - whole * supply[leaf], 0
        mine = [(hashlib.md5(f"{seed}|{whole}|{i}".encode()).hexdigest()[:15], str(i), i, n) for i, x, n in docs if x == leaf]
        for _, _, i, n in sorted(mine):
            used += n
            copies = min(whole + (used <= rest), max_epochs)
            taken += [(i, e) for e in range(1, copies + 1)]
    return sorted(taken), nodes


def as_frame(spark, docs):
    rows = [(i, " ".join(["w"] * n), leaf[0], leaf[1], 9) for i, leaf, n in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


@pytest.mark.parametrize("percent, epochs", [(30, 1), (90, 1), (150, 3), (1000, 2)])
def test_mix_equals_plain_arithmetic(spark, percent, epochs):
    rng = random.Random(percent)
    docs = [(i, (rng.choice("abc"), rng.choice("uvwxyz")), rng.randrange(0, 30)) for i in range(400)]
    docs += [(i, ("a", "u"), 17) for i in range(400, 600)]
    weights = {"lang": {"a": 5, "b": 2}, "source": {"v": 7, "w": 0}}
    mixed = mixing.mix(as_frame(spark, docs), levels=levels(), weights=weights, budget_percent=percent,
                       max_epochs=epochs, seed=4)
    want, nodes = brute_mix(docs, [weights["lang"], weights["source"]], percent, epochs, 4)
    assert sorted((r.doc_id, r.epoch) for r in mixed.collect()) == want
    assert all(b >= 0 for b in nodes.values()) and mixed.columns == ["doc_id", "text", "lang", "source", "epoch"]


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("a", "u", 10), ("a", "v", 500), ("b", "u", 1000)], "lang string, source string, supply long")
    got = {(r.lang, r.source): r.budget for r in mixing.budgets(leaves, ["lang", "source"], {}, 400, 1).collect()}
    assert got == {("a", "u"): 10, ("a", "v"): 190, ("b", "u"): 200}
    got = {(r.lang, r.source): r.budget for r in mixing.budgets(leaves, ["lang", "source"], {}, 1400, 1).collect()}
    assert got == {("a", "u"): 10, ("a", "v"): 500, ("b", "u"): 890}


def test_nulls_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b", None, "s", 1), (1, "a b", None, "s", 1), (None, None, "x", None, 1), (3, "", "x", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    taken = mixing.mix(frame, levels=levels(), weights={}, budget_percent=100).collect()
    assert sorted((r.doc_id or 0, r.epoch) for r in taken) == [(0, 1), (1, 1), (1, 1), (3, 1)]
    assert mixing.mix(frame.limit(0), levels=levels(), weights={}, budget_percent=100).count() == 0


def test_mixing_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.n_tokens().alias("n"), *[
        c.alias(name) for name, c in mix_levels().items()]).collect()
    rows = [(r.doc_id, (r.domain, r.lang, r.source), r.n) for r in docs]
    want, _ = brute_mix(rows, [MIX_WEIGHTS["domain"], MIX_WEIGHTS["lang"], {}], 120, 3, 5)
    assert sorted((r.doc_id, r.epoch) for r in REGISTRY["op8_mixing"](spark, sf_dir).collect()) == want
