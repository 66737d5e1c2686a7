"""Features, reasons, forest invariants and rules."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import session
from tallyspark.operators import anomaly, forest_kernel
from tallyspark.plans.tables import Tables
from tallyspark.session import materialize

SCHEMA = ("transaction_id long, account_id long, category_name string, txn_date date, amount decimal(12,2), "
          "txn_type string")


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def ledger(spark, rows):
    return spark.createDataFrame(
        [(i, a, c, day(d), Decimal(str(x)), "debit") for i, (a, c, d, x) in enumerate(rows)], SCHEMA)


def by_id(df):
    return [r for r in df.orderBy("transaction_id").collect()]


def test_same_day_counts_and_no_nulls(spark):
    rows = by_id(anomaly.features(ledger(spark, [
        (1, "Bread", 0, 31), (1, "Bread", 0, 36), (1, "Tools", 1, 270), (1, "Tools", 2, 9)])))
    assert [r.same_day for r in rows] == [2, 2, 1, 1]
    assert all(v is not None for r in rows for v in r.vector)
    assert [r.day_of_week for r in rows] == [3, 3, 4, 5]  # 2026-01-01 is a Thursday


def test_outlier_has_the_largest_zscore(spark):
    rows = by_id(anomaly.features(ledger(spark, [(1, "Paint", i, 44) for i in range(13)] + [(1, "Paint", 13, 3100)])))
    assert rows[-1].z_amount == max(r.z_amount for r in rows) and rows[-1].z_amount > 2


def test_single_row_category_uses_the_global_deviation(spark):
    rows = by_id(anomaly.features(ledger(spark, [(1, "Once", 0, 61), (1, "Often", 1, 33), (1, "Often", 2, 38)])))
    assert rows[0].z_amount == 0
    assert all(v is not None for r in rows for v in r.vector)


def test_equal_amounts_give_zero_in_the_vector(spark):
    rows = by_id(anomaly.features(ledger(spark, [(1, "A", i, 10) for i in range(4)])))
    assert all(r.z_amount is None and r.vector[1] == 0 for r in rows)


def test_reasons(spark):
    rows = spark.createDataFrame([(0, 2.54, 1), (1, -2.1, 4), (2, 2.0, 3), (3, 0.1, 7), (4, None, 1)],
                                 "transaction_id long, z_amount double, same_day long")
    got = [r.reason for r in by_id(rows.select("transaction_id", anomaly.reason().alias("reason")))]
    assert got == [
        "amount 2.5 std devs from category norm",
        "amount -2.1 std devs from category norm; 4 transactions same day (possible duplicate/testing)",
        "unusual combination of amount/timing features",
        "7 transactions same day (possible duplicate/testing)",
        "unusual combination of amount/timing features",
    ]


def test_mean_path_length_values():
    assert forest_kernel.mean_path_length([0, 1, 2]).tolist() == [0, 0, 1]
    assert forest_kernel.mean_path_length(256) == pytest.approx(10.24, abs=0.01)


def test_batched_paths_equal_a_walk():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 4)).round(1)
    packed = forest_kernel.pack([forest_kernel.grow_tree(points[rng.integers(0, 300, 64)], [1, t]) for t in range(20)])
    feature, threshold, left, depth, roots = packed

    def walk(v):
        total = 0.0
        for node in roots:
            while not np.isinf(threshold[node]):
                node = left[node] + int(v[feature[node]] > threshold[node])
            total += depth[node]
        return total / len(roots)

    got = forest_kernel.path_lengths(packed, points, 6, chunk=37)
    assert np.allclose(got, [walk(v) for v in points])


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return Tables(spark, sf_dir).events


@pytest.fixture(scope="module")
def found(events):
    return anomaly.detect(events)


def test_threshold_is_the_exact_percentile(found):
    scores = np.array([r.raw_score for r in found.scored.select("raw_score").collect()])
    assert found.threshold == pytest.approx(np.percentile(scores, 98), abs=1e-12)
    assert found.flags.count() == int((scores > found.threshold).sum())
    assert 0.01 <= found.flags.count() / len(scores) <= 0.03


def test_threshold_with_ties(spark):
    for values in ([0.5] * 10, [0.1, 0.9], [0.25] * 98 + [0.5, 0.75], [0.4]):
        df = spark.createDataFrame([(v,) for v in values], "raw_score double")
        assert anomaly.contamination_threshold(df) == pytest.approx(np.percentile(values, 98), abs=1e-9)


def test_normalised_scores_span_the_unit_range(found):
    low, high = anomaly.normalise(found.scored).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert (low, high) == (Decimal("0.0000"), Decimal("1.0000"))


def test_equal_scores_normalise_to_zero(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "raw_score double")
    assert {r.anomaly_score for r in anomaly.normalise(df).collect()} == {Decimal("0.0000")}


def test_flagged_rows_lie_further_out(found):
    joined = found.scored.withColumn("flagged", F.col("raw_score") > found.threshold)
    z = {r.flagged: r.z for r in joined.groupBy("flagged").agg(F.avg(F.abs("z_amount")).alias("z")).collect()}
    assert z[True] > z[False]


def test_scores_do_not_depend_on_partitioning(events):
    def scores(df, parts):
        featured = materialize(anomaly.features(df).repartition(parts), "features")
        rows = anomaly.fit_forest(featured, trees=20).score(featured)
        return sorted((r.transaction_id, r.raw_score) for r in rows.select("transaction_id", "raw_score").collect())

    assert scores(events, 1) == scores(events, 7)


def test_injected_outlier_ranks_first(spark, events):
    odd = events.limit(1).withColumns({
        "transaction_id": F.lit(10**9).cast("long"), "amount": F.lit(5000).cast("decimal(12,2)")})
    assert anomaly.detect(events.unionByName(odd)).flags.first().transaction_id == 10**9


def test_each_tree_gets_its_full_sample(spark):
    for n in (500, 3000, 100_000):
        rows = spark.range(n).select(F.col("id").alias("transaction_id"), F.array(F.lit(1.0)).alias("vector"))
        sizes = [r["count"] for r in anomaly.sample_for_trees(rows, n).groupBy("tree").count().collect()]
        assert len(sizes) == 200 and max(sizes) <= 256
        assert min(sizes) == 256


def test_samples_are_drawn_by_one_rule(spark):
    """Every row joins as many distinct trees on the average, whatever the number of rows."""
    for n in (300, 400, 2000):
        rows = spark.range(n).select(F.col("id").alias("transaction_id"), F.array(F.lit(1.0)).alias("vector"))
        drawn = anomaly.sample_for_trees(rows, n, sample=256).select("tree", "transaction_id")
        assert drawn.count() == drawn.distinct().count() == 200 * min(n, 256)
        per_row = drawn.groupBy("transaction_id").count().agg(F.avg("count")).first()[0]
        assert per_row == pytest.approx(200 * min(n, 256) / n, rel=0.02)


def test_negative_outliers_are_flagged_too(spark):
    rows = spark.createDataFrame([(1, -2.5, 1), (2, 2.5, 1), (3, 1.0, 9), (4, -1.0, 1)],
                                 "transaction_id long, z_amount double, same_day long")
    flags = anomaly.rule_flags(rows.withColumns({"account_id": F.lit(1), "txn_date": F.lit("2026-01-01")}))
    assert sorted(r.transaction_id for r in flags.collect()) == [1, 2, 3]


def test_detection_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    with session.scratch(spark):
        rows = ledger(spark, [(1, "Paint", i % 28, 40 + i % 7) for i in range(80)])
        assert anomaly.detect(rows).flags.count() >= 0
    assert not list((tmp_path / "tallyspark").iterdir())


def test_duplicate_charges_and_bursts(spark):
    rows = ledger(spark, [(1, "Software", 0, 30), (1, "Software", 0, 30), (1, "Software", 1, 30)]
                  + [(2, "Shopping", 5, x) for x in (1, 2, 3, 4, 5)] + [(2, "Shopping", 6, 100)] * 5)
    rows = rows.withColumn("merchant_name", F.col("category_name"))
    dup = {(r.account_id, str(r.txn_date), float(r.amount)): r.n for r in anomaly.duplicate_charges(rows).collect()}
    assert dup == {(1, "2026-01-01", 30.0): 2, (2, "2026-01-07", 100.0): 5}
    bursts = anomaly.small_charge_bursts(rows).collect()
    assert [(r.account_id, r.n, float(r.total)) for r in bursts] == [(2, 5, 15.0)]
