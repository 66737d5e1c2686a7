"""Unusual-transaction scoring: features, an isolation forest, flags and rules."""

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark import schemas
from tallyspark.operators import forest_kernel as kernel
from tallyspark.operators.joins import attach_group_stats, join_dimension
from tallyspark.session import materialize, wide

FEATURES = ["amount", "z_amount", "same_day", "day_of_week", "day_of_month"]
SCORE_UNIT = 1_000_000_000
BUCKET = 32_768

# The limits and texts of the reasons.
Z_LIMIT = 2
SAME_DAY_LIMIT = 3
FALLBACK_REASON = "unusual combination of amount/timing features"
BURST_ROWS = 5
BURST_AMOUNT = 15


def debits(ledger: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """The rows the model looks at: debits with a category, one of `categories` where they are given."""
    rows = ledger.filter((F.col("txn_type") == "debit") & F.col("category_name").isNotNull())
    if categories is not None:
        rows = rows.join(categories.select("category_name"), "category_name", "left_semi")
    return rows.select("transaction_id", "account_id", "txn_date", "category_name", "amount")


def with_calendar(rows: DataFrame, date: str = "txn_date") -> DataFrame:
    """Day of week (Monday 0) and day of month."""
    return rows.withColumn("day_of_week", F.weekday(date)).withColumn("day_of_month", F.dayofmonth(date))


def category_stats(rows: DataFrame) -> DataFrame:
    """Mean and sample deviation per category over all accounts.

    A category without a usable deviation takes that of all rows, which
    follows from the categories' counts, means and deviations.
    """
    amount = F.col("amount").cast("double")
    per_category = rows.groupBy("category_name").agg(
        F.avg(amount).alias("cat_mean"), F.stddev_samp(amount).alias("cat_std"), F.count(amount).alias("_n"))
    total, mean = F.sum("_n"), F.sum(F.col("_n") * F.col("cat_mean")) / F.sum("_n")
    inside = F.sum((F.col("_n") - 1) * F.pow(F.coalesce("cat_std", F.lit(0.0)), 2))
    between = F.sum(F.col("_n") * F.pow("cat_mean", 2)) - total * F.pow(mean, 2)
    # Equal amounts everywhere leave a rest of rounding, not of spread.
    variance = F.when(inside + between > 1e-9 * F.sum(F.col("_n") * F.pow("cat_mean", 2)), (inside + between) / (total - 1))
    overall = per_category.agg(F.sqrt(variance)).scalar()
    return per_category.withColumn("cat_std", F.coalesce(F.nullif("cat_std", F.lit(0.0)), overall)).drop("_n")


def with_zscore(rows: DataFrame) -> DataFrame:
    """Distance from the category's mean in deviations; NULL when nothing deviates anywhere."""
    joined = join_dimension(rows, category_stats(rows), "category_name")
    z = F.try_divide(F.col("amount").cast("double") - F.col("cat_mean"), F.col("cat_std"))
    return joined.withColumn("z_amount", F.round(z, 6)).drop("cat_mean", "cat_std")


def with_same_day(rows: DataFrame) -> DataFrame:
    """Number of debits of the row's account on its day."""
    keys = ["account_id", "txn_date"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("same_day"))
    return attach_group_stats(rows, counts, keys, weight="same_day", row_id="transaction_id")


def features(ledger: DataFrame) -> DataFrame:
    """The five model inputs per debit; an undefined z-score is 0 in the vector."""
    rows = with_calendar(with_same_day(with_zscore(debits(ledger))))
    return rows.withColumn(
        "vector",
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES]),
    )


def stored_features(ledger: DataFrame) -> DataFrame:
    """`features`, stored in as many files as tasks should score them: a row costs far more to score than to move."""
    spread = features(ledger).repartition(wide(ledger.sparkSession), "transaction_id")
    return materialize(spread, "features")


@dataclass
class ForestModel:
    """Grown trees as packed arrays. Their size depends on tree count and sample size only."""

    packed: Any
    sample_size: int

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds `raw_score` in (0, 1), higher meaning more unusual."""
        model = rows.sparkSession.sparkContext.broadcast(self.packed)
        steps = int(np.ceil(np.log2(max(self.sample_size, 2))))
        norm = float(kernel.mean_path_length(self.sample_size))

        def run(vectors: pd.Series) -> pd.Series:
            if len(vectors) == 0:
                return pd.Series([], dtype=float)
            points = np.stack(vectors.to_numpy()).astype(float)
            return pd.Series(np.exp2(-kernel.path_lengths(model.value, points, steps) / max(norm, 1e-12)))

        scorer = F.pandas_udf(run, T.DoubleType())
        return rows.withColumn("raw_score", F.round(scorer("vector"), 9))


def describe(spark: SparkSession, model: ForestModel) -> DataFrame:
    """One row per tree: its nodes, its leaves and the mean path length at its leaves."""
    _, threshold, _, depth, roots = model.packed
    ends = [*roots[1:], len(depth)]
    rows = []
    for t, (begin, end) in enumerate(zip(roots, ends)):
        leaves = np.isinf(threshold[begin:end])
        rows.append((t, int(end - begin), int(leaves.sum()), float(depth[begin:end][leaves].mean())))
    return spark.createDataFrame(rows, "tree long, nodes long, leaves long, mean_depth double")


def sample_for_trees(featured: DataFrame, n_rows: int, trees: int = schemas.FOREST_TREES,
                     sample: int = schemas.FOREST_SAMPLE, seed: int = schemas.SEED, below: float | None = None) -> DataFrame:
    """For each tree the `sample` rows with the smallest numbers, all rows if there are fewer.

    A row has one number for each tree, which follow from a hash of its transaction id, so the draw does not depend on
    partitioning. A partition keeps no more than `sample` rows of a tree, and partials are merged by tree. Numbers from
    `below` on are left out before that: on a large ledger a row's smallest number, which is one comparison, rules out
    nearly every row. By default so many are left that no tree can be expected to run short; `fit_forest` makes sure.
    """
    if below is None:
        below = likely_bound(n_rows, sample)
    bits = 1 << 40
    hashed = featured.withColumn("_hash", F.xxhash64("transaction_id", F.lit(seed)))
    if below < 1:
        first_below = -math.expm1(trees * math.log1p(-below))
        hashed = hashed.filter(F.pmod("_hash", F.lit(bits)) <= F.lit(math.ceil(first_below * bits)))
    schema = T.StructType([
        T.StructField("tree", T.LongType()), T.StructField("number", T.DoubleType()),
        featured.schema["transaction_id"], featured.schema["vector"]])

    def smallest(batches):
        limit, held = below, None
        for batch in batches:
            base = np.asarray(batch.column(0)).view(np.uint64)
            first = ((base & np.uint64(bits - 1)).astype(float) + kernel.unit_numbers(base, 0)) / bits
            row, tree, number = kernel.lowest_numbers(base, first, trees, limit)
            rows = pa.table([pa.array(tree), pa.array(number), *(batch.column(i).take(pa.array(row)) for i in (1, 2))],
                            names=schema.names)
            held = rows if held is None else pa.concat_tables([held, rows])
            if len(held) > 4 * trees * sample:
                held = cut(held)
                if len(held) == trees * sample:
                    limit = min(limit, float(np.max(held.column("number"))))
        if held is not None:
            yield from cut(held).to_batches(max_chunksize=10_000)

    def cut(table):
        places = kernel.smallest_of_trees(*(np.asarray(table.column(c)) for c in ("tree", "number")), sample)
        return table.take(pa.array(places)).combine_chunks()

    partial = hashed.select("_hash", "transaction_id", "vector").mapInArrow(smallest, schema)
    order = Window.partitionBy("tree").orderBy("number", "transaction_id")
    return (
        partial.repartition(min(trees, wide(featured.sparkSession)), "tree")
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample)
        .select("tree", "transaction_id", "vector")
    )


def likely_bound(n_rows: int, sample: int) -> float:
    """A limit that leaves a tree `sample` rows and ten deviations more on the average."""
    return min(1.0, (sample + 10 * math.sqrt(sample) + 20) / max(n_rows, 1))


def fit_forest(featured: DataFrame, trees: int = schemas.FOREST_TREES, sample: int = schemas.FOREST_SAMPLE,
               seed: int = schemas.SEED) -> ForestModel:
    """Grow the forest, one task group per tree.

    What comes back to the driver is the model: `trees` rows of at most
    2 * `sample` nodes, whatever the size of the ledger.
    """
    n_rows = featured.count()
    if n_rows == 0:
        raise ValueError("no debit rows to fit")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("transaction_id")
        nodes = kernel.grow_tree(np.stack(pdf["vector"].to_numpy()).astype(float), [seed, tree])
        return pd.DataFrame({
            "tree": [tree], "n": [len(pdf)], "feature": [nodes[0]], "threshold": [nodes[1]],
            "left": [nodes[2]], "depth": [nodes[3]],
        })

    for below in (likely_bound(n_rows, sample), 1.0):
        grown = (
            sample_for_trees(featured, n_rows, trees, sample, seed, below)
            .groupBy("tree").applyInPandas(
                build, "tree int, n int, feature array<int>, threshold array<double>, "
                       "left array<int>, depth array<double>")
            .toPandas().sort_values("tree")
        )
        # Draws are the same for any bound, so a tree that ran short is drawn again without one.
        if len(grown) == trees and grown["n"].min() >= min(sample, n_rows):
            break
    packed = kernel.pack([tuple(row) for row in grown[["feature", "threshold", "left", "depth"]].to_numpy()])
    return ForestModel(packed, int(grown["n"].max()))


def contamination_threshold(scored: DataFrame, contamination: float = schemas.CONTAMINATION) -> float:
    """The score above which rows are flagged: the exact (1 - contamination) percentile.

    Scores have nine decimals, so they are whole numbers of a billionth. One
    pass counts them in 30,518 buckets, a second counts the single values in
    the at most two buckets that hold the two ranks in question. Both results
    are bounded whatever the number of rows; ranks between two values are
    interpolated.
    """
    units = scored.select(F.round(F.col("raw_score") * SCORE_UNIT).cast("bigint").alias("u"))
    bucket = F.floor(F.col("u") / BUCKET).cast("bigint")
    per_bucket = units.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    total = sum(r.n for r in per_bucket)
    position = (total - 1) * (1.0 - contamination)
    ranks = [int(np.floor(position)), int(np.ceil(position))]
    starts, before = [], 0
    for r in per_bucket:
        starts.append((before, before + r.n, r.b))
        before += r.n
    wanted = {rank: next(s for s in starts if s[0] <= rank < s[1]) for rank in ranks}
    inside = (
        units.filter(bucket.isin(*{s[2] for s in wanted.values()}))
        .groupBy("u").agg(F.count("*").alias("n")).orderBy("u").collect()
    )
    found = {}
    for rank, (start, _, b) in wanted.items():
        seen = start
        for r in inside:
            if r.u // BUCKET != b:
                continue
            seen += r.n
            if rank < seen:
                found[rank] = r.u
                break
    low, high = found[ranks[0]], found[ranks[1]]
    return (low + (high - low) * (position - ranks[0])) / SCORE_UNIT


def normalise(scored: DataFrame) -> DataFrame:
    """Scores stretched to 0..1 over all rows; 0 when all are equal."""
    ends = scored.agg(F.struct(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))).scalar()
    spread = F.nullif(ends["hi"] - ends["lo"], F.lit(0.0))
    score = F.coalesce(F.try_divide(F.col("raw_score") - ends["lo"], spread), F.lit(0.0))
    return scored.withColumn("anomaly_score", score.cast(schemas.SCORE))


def reason():
    """Why a row stands out, in words."""
    far = F.when(
        F.abs("z_amount") > Z_LIMIT,
        F.format_string("amount %.1f std devs from category norm", "z_amount"),
    )
    crowded = F.when(
        F.col("same_day") > SAME_DAY_LIMIT,
        F.concat(F.col("same_day").cast("string"), F.lit(" transactions same day (possible duplicate/testing)")),
    )
    words = F.concat_ws("; ", far, crowded)
    return F.coalesce(F.nullif(words, F.lit("")), F.lit(FALLBACK_REASON))


@dataclass
class Detection:
    """Result of one detection run."""

    scored: DataFrame
    threshold: float
    flags: DataFrame


def detect(ledger: DataFrame, contamination: float = schemas.CONTAMINATION) -> Detection:
    """Features, fit, score and flags.

    Features and scores are each stored once in the shared folder, because
    fit, threshold, normalisation and flags all read them. Inside a
    `session.scratch` block they are removed when the flags are stored.
    """
    featured = stored_features(ledger)
    model = fit_forest(featured)
    scored = materialize(model.score(featured), "scores")
    threshold = contamination_threshold(scored, contamination)
    flags = (
        normalise(scored).filter(F.col("raw_score") > threshold)
        .select("transaction_id", "anomaly_score", reason().alias("reason"),
                F.lit(schemas.FOREST_VERSION).alias("model_version"))
        .orderBy(F.desc("anomaly_score"), "transaction_id")
    )
    return Detection(scored, threshold, flags)


def rule_flags(featured: DataFrame) -> DataFrame:
    """Rows that a reason predicate alone picks out, with that reason."""
    picked = (F.abs("z_amount") > Z_LIMIT) | (F.col("same_day") > SAME_DAY_LIMIT)
    return featured.filter(picked).select(
        "transaction_id", "account_id", "txn_date", "z_amount", "same_day", reason().alias("reason"))


def duplicate_charges(ledger: DataFrame) -> DataFrame:
    """Same account, merchant, day and amount charged more than once."""
    return (
        ledger.filter(F.col("txn_type") == "debit")
        .groupBy("account_id", "merchant_name", "txn_date", "amount")
        .agg(F.count("*").alias("n")).filter("n > 1")
    )


def small_charge_bursts(ledger: DataFrame) -> DataFrame:
    """Days with at least five small debits of an account in one category."""
    return (
        ledger.filter((F.col("txn_type") == "debit") & (F.col("amount") <= BURST_AMOUNT))
        .groupBy("account_id", "category_name", "txn_date")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total")).filter(F.col("n") >= BURST_ROWS)
    )
