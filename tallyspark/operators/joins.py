"""Joins and per-group picks that hold when one key owns a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_SHARE = 1_000
SPREAD = 512


def join_dimension(facts: DataFrame, dimension: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join a lookup table to a large one by a key; no row of `facts` is ever doubled.

    A key that the lookup holds twice gets the smallest of its rows. There is no
    hint: the planner broadcasts a lookup by its stored or measured size, and
    shuffles both sides of a larger one, where the skew join splits hot keys.
    """
    values = [c for c in dimension.columns if c != on]
    if values:
        single = dimension.groupBy(on).agg(F.min(F.struct(*values)).alias("_row")).select(on, "_row.*")
    else:
        single = dimension.select(on).distinct()
    return facts.join(single, on, how)


def attach_group_stats(rows: DataFrame, stats: DataFrame, keys: list[str], weight: str,
                       row_id: str) -> DataFrame:
    """Give every row the aggregates of its group; `stats` has one row per group.

    A group with at least 1/HOT_SHARE of all rows is hot. There can be at most
    HOT_SHARE of them, so their statistics are broadcast, and their rows are
    dealt over SPREAD shuffle keys that match nothing else. All other groups go
    through a shuffled join. `weight` is the group's row count in `stats`.
    """
    values = [c for c in stats.columns if c not in keys]
    total = stats.agg(F.sum(weight)).scalar()
    stats = stats.withColumn("_hot", F.col(weight) * HOT_SHARE >= total)
    hot = stats.filter("_hot").select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.struct(*values).alias("_hot_stats"),
    )
    cold = stats.filter("not _hot").select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys],
        F.lit(0).alias("_cold_deal"),
        F.struct(*values).alias("_cold_stats"),
    )
    on_hot = _all(F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys)
    dealt = rows.join(F.broadcast(hot), on_hot, "left").withColumn(
        "_deal",
        F.when(F.col("_hot_stats").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(row_id), F.lit(SPREAD))).cast("int"),
    )
    on_cold = _all(F.col(k).eqNullSafe(F.col(f"_cold_{k}")) for k in keys) & (F.col("_deal") == F.col("_cold_deal"))
    merged = dealt.join(cold, on_cold, "left")
    picked = F.coalesce("_hot_stats", "_cold_stats")
    return merged.select(*rows.columns, *[picked[v].alias(v) for v in values])


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of every group; `order` must be total.

    Every input partition keeps `k` rows of a group before anything is
    shuffled. What is left of a group over all partitions is cut again in
    SPREAD slices of partitions, so the last step sees at most SPREAD * k rows
    of a hot group. Which slice a row falls in does not change the result.
    """
    sliced = rows.withColumn("_slice", F.spark_partition_id() % SPREAD)
    in_slice = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    in_group = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        sliced.withColumn("_rank", in_slice).filter(F.col("_rank") <= k)
        .withColumn("_rank", in_group).filter(F.col("_rank") <= k)
        .drop("_slice", "_rank")
    )


def _all(conditions) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result & condition
    return result
