"""Uniqueness by packed hashes."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import quality


def test_repeated_values_are_found_and_counted(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(3000)] + [f"k{rng.randrange(0, 6000, 7)}" for _ in range(900)] + ["hot"] * 4000 + [None] * 9
    rng.shuffle(keys)
    want = {k: keys.count(k) for k in set(keys) if k and keys.count(k) > 1}
    rows = spark.createDataFrame([(k, 1) for k in keys], "k string, v int")
    for parts in (1, 7):
        assert {r.k: r.n for r in quality.duplicated_in_large(rows.repartition(parts), ["k"]).collect()} == want


def test_several_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "a"), (None, "a"), (2, None), (2, None)], "x long, y string")
    assert [tuple(r) for r in quality.duplicated_in_large(rows, ("x", "y")).collect()] == [(1, "a", 2)]
    assert quality.duplicated_in_large(rows.limit(0), ["x"]).collect() == []


@pytest.mark.parametrize("held", [1, 5, 1 << 20])
def test_packs_of_any_size(spark, monkeypatch, held):
    """Values of all buckets, repeated within and across tasks, and near misses in the last bit."""
    monkeypatch.setattr(quality, "HELD_HASHES", held)
    bits = 5
    values = [v for i in range(400) for v in (i * 0x12345678901 % 2**53, i * 0x12345678901 % 2**53 ^ 1)]
    repeated = values[::9] + values[::18] + [2**53 - 1, 2**53 - 1, 0]
    rows = spark.createDataFrame([(v,) for v in values + repeated], "h long")
    want = {v for v in values + repeated if (values + repeated).count(v) > 1}
    for parts in (1, 6):
        got = [r.h for r in quality.repeated_hashes(rows.repartition(parts), bits).collect()]
        assert sorted(got) == sorted(want)


def test_unique_keys_shuffle_little(spark):
    """A key costs about six bytes in the exchange, however long it is, and the second pass moves none."""
    n = 300_000
    rows = spark.range(n).select(F.concat(F.lit("a rather long transaction id "), F.sha1(F.col("id").cast("string"))).alias("k"))
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    def shuffled(run):
        before = written()
        run()
        return written() - before

    packed = shuffled(lambda: quality.duplicated_in_large(rows, ["k"]).count())
    plain = shuffled(lambda: rows.groupBy("k").count().filter("count > 1").count())
    assert packed < 8 * n and packed < plain / 4
