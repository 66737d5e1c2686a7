"""Skew-proof joins and picks against plain ones."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators import joins


def skewed(spark, n=6000):
    random.seed(1)
    rows = [(i, 1 if i % 3 == 0 else random.choice([None, *range(2, 900)]), random.randint(0, 500)) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id long, account_id long, amount long")


def test_attached_stats_equal_a_window(spark):
    rows = skewed(spark)
    counts = rows.groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    got = joins.attach_group_stats(rows, counts, ["account_id"], "n", "transaction_id")
    w = Window.partitionBy("account_id")
    expected = rows.select("*", F.count("*").over(w).alias("n"), F.sum("amount").over(w).alias("total"))
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_attached_stats_without_hot_or_cold_groups(spark):
    for keys in ([1] * 50, list(range(3000))):
        rows = spark.createDataFrame(list(enumerate(keys)), "transaction_id long, account_id long")
        counts = rows.groupBy("account_id").agg(F.count("*").alias("n"))
        got = joins.attach_group_stats(rows, counts, ["account_id"], "n", "transaction_id")
        assert {r.n for r in got.collect()} == {keys.count(keys[0])}
        assert got.count() == len(keys)


def test_hot_rows_are_dealt_over_many_shuffle_keys(spark):
    rows = skewed(spark)
    counts = rows.groupBy("account_id").agg(F.count("*").alias("n"))
    plan = joins.attach_group_stats(rows, counts, ["account_id"], "n", "transaction_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "_deal" in text


def test_top_rows_equal_a_single_window(spark):
    rows = skewed(spark)
    order = [F.desc("amount"), F.asc("transaction_id")]
    got = joins.top_per_group(rows.repartition(13), ["account_id"], order, 7)
    rank = F.row_number().over(Window.partitionBy("account_id").orderBy(*order))
    expected = rows.withColumn("r", rank).filter("r <= 7").drop("r")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_lookup_starts_no_job_and_doubles_no_row(spark):
    facts = skewed(spark)
    dim = spark.range(100).select(F.col("id").alias("account_id"), F.lit("x").alias("name"))
    doubled = dim.unionByName(dim.withColumn("name", F.lit("a")))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "lookup")
    once, twice = joins.join_dimension(facts, dim, "account_id"), joins.join_dimension(facts, doubled, "account_id")
    assert not tracker.getJobIdsForGroup("lookup")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert once.count() == twice.count() == facts.count()
    assert {r.name for r in twice.select("name").distinct().collect()} <= {"a", None}
