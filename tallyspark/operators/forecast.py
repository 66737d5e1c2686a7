"""Cash-flow forecasting: daily series, lag features, models and backtests."""

import os
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark import schemas
from tallyspark.functions.columns import signed
from tallyspark.operators import series_kernel as series
from tallyspark.operators.booster_kernel import MOST_BINS
from tallyspark.session import jvm_object, wide

LAG_COLUMNS = [f"lag_{k}" for k in range(1, schemas.LAGS + 1)]
FITTER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "SeriesFitter.java")
FEATURES = LAG_COLUMNS + ["dow", "day_of_month", "rolling_mean_7"]


def daily_net(ledger: DataFrame) -> DataFrame:
    """Signed sum per account and day, for all accounts at once."""
    return ledger.groupBy("account_id", "txn_date").agg(F.sum(signed()).alias("net_flow"))


def densify(daily: DataFrame) -> DataFrame:
    """Every day from an account's first to its last, 0 where nothing happened.

    Each row fills the days up to the account's next one, so there is no join
    with a calendar. Only the sparse rows are shuffled, once, by account: the
    windows and the per-account models on top keep that partitioning.
    """
    by_day = Window.partitionBy("account_id").orderBy("txn_date")
    until = F.coalesce(F.date_sub(F.lead("txn_date").over(by_day), 1), F.col("txn_date"))
    spans = daily.repartition(wide(daily.sparkSession), "account_id").withColumn("_until", until)
    filled = spans.select("account_id", F.col("txn_date").alias("_start"), "net_flow",
                          F.explode(F.sequence("txn_date", "_until")).alias("txn_date"))
    flow = F.when(F.col("txn_date") == F.col("_start"), F.col("net_flow")).otherwise(F.lit(0))
    return filled.select("account_id", "txn_date", flow.cast(daily.schema["net_flow"].dataType).alias("net_flow"))


def with_lags(dense: DataFrame) -> DataFrame:
    """The flows of the seven days before. They pass the window inside a struct, whose bytes are copied; a wide decimal would
    be taken apart and put together each time."""
    by_day = Window.partitionBy("account_id").orderBy("txn_date")
    packed = dense.withColumn("_packed", F.struct("net_flow"))
    lagged = packed.select("*", *[
        F.lag("_packed", k).over(by_day).alias(f"_packed_{k}") for k in range(1, schemas.LAGS + 1)
    ])
    return lagged.select(*dense.columns, *[
        F.col(f"_packed_{k}.net_flow").alias(f"lag_{k}") for k in range(1, schemas.LAGS + 1)
    ])


def with_calendar(dense: DataFrame) -> DataFrame:
    return dense.withColumn("dow", F.weekday("txn_date")).withColumn("day_of_month", F.dayofmonth("txn_date"))


def with_rolling_mean(dense: DataFrame) -> DataFrame:
    """Mean of the seven days before; NULL until there are seven.

    The sum of the lags, which a day lacks until there are seven; a frame of seven rows would be added up anew each day.
    """
    lagged = dense if set(LAG_COLUMNS) <= set(dense.columns) else with_lags(dense)
    mean = reduce(add, [F.col(c) for c in LAG_COLUMNS]).cast("double") / schemas.LAGS
    return lagged.select(*dense.columns, mean.alias("rolling_mean_7"))


def feature_rows(dense: DataFrame) -> DataFrame:
    """All ten inputs; the first seven days of an account have none and are dropped."""
    featured = with_rolling_mean(with_lags(with_calendar(dense)))
    return featured.filter(F.col(f"lag_{schemas.LAGS}").isNotNull())


def with_split(featured: DataFrame) -> DataFrame:
    """Drops accounts with too little history and marks each row as train or test.

    The first 85 % of an account's days train, in order of time. Count and position share one window, which the other columns
    pass as one struct.
    """
    by_day = Window.partitionBy("account_id").orderBy("txn_date")
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keys = ["account_id", "txn_date"]
    packed = featured.select(*keys, F.struct(*[c for c in featured.columns if c not in keys]).alias("_row"))
    counted = packed.select("*", F.count("*").over(whole).alias("n_rows"), F.row_number().over(by_day).alias("_position"))
    is_train = F.col("_position") <= F.call_function("div", F.col("n_rows") * 85, F.lit(100))
    return counted.filter(F.col("n_rows") >= schemas.MIN_FEATURE_ROWS).select(
        *[c if c in keys else f"_row.{c}" for c in featured.columns], "n_rows", is_train.alias("is_train"))


def skipped_accounts(accounts: DataFrame, featured: DataFrame) -> DataFrame:
    """Accounts without a forecast, and how many feature rows they have."""
    counts = featured.groupBy("account_id").agg(F.count("*").alias("n_rows"))
    return (
        accounts.select("account_id").join(counts, "account_id", "left")
        .select("account_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        .filter(F.col("n_rows") < schemas.MIN_FEATURE_ROWS)
    )


def naive_mae(split: DataFrame) -> DataFrame:
    """Mean absolute error of "same as seven days ago" on the test days."""
    error = F.abs(F.col("net_flow") - F.col(f"lag_{schemas.LAGS}"))
    return split.filter(~F.col("is_train")).groupBy("account_id").agg(
        (F.sum(error).cast("double") / F.count("*")).alias("mae_naive"))


def seasonal_naive(daily: DataFrame, balances: DataFrame, horizon: int = schemas.HORIZON) -> DataFrame:
    """The naive model carried forward: day k repeats the day seven earlier.

    Works on the sparse daily rows: only an account's last seven days matter,
    and each of them without a row is 0. Days before the account's first row
    have no value to repeat.
    """
    by_account = Window.partitionBy("account_id")
    spanned = daily.withColumns({
        "first": F.min("txn_date").over(by_account), "last": F.max("txn_date").over(by_account)})
    age = F.date_diff("last", "txn_date")
    week = spanned.filter(age < schemas.LAGS).groupBy("account_id", "first", "last").agg(
        F.array(*[F.coalesce(F.sum(F.when(age == a, F.col("net_flow"))), F.lit(0).cast("decimal(12,2)"))
                  for a in range(schemas.LAGS)]).alias("by_age"))
    back = (schemas.LAGS - 1) - (F.col("step") - 1) % schemas.LAGS
    flows = (
        week.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .filter(back <= F.date_diff("last", "first"))
        .select("account_id", "last", "step", F.col("by_age")[back].alias("predicted_net_flow"))
    )
    return _with_balance(flows, balances)


def _with_balance(flows: DataFrame, balances: DataFrame) -> DataFrame:
    running = Window.partitionBy("account_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    start = balances.select("account_id", F.col("current_balance"))
    summed = flows.withColumn("_run", F.sum("predicted_net_flow").over(running))
    return summed.join(start, "account_id", "left").select(
        "account_id",
        F.expr("date_add(last, step)").alias("forecast_date"),
        "predicted_net_flow",
        (F.coalesce(F.col("current_balance"), F.lit(0).cast("decimal(12,2)")) + F.col("_run"))
        .alias("predicted_balance"),
    )


# A fitter's columns; its days are numbers.
MODEL = (
    "account_id long, last int, n_rows int, history array<double>, start double, rate double, "
    "feature array<array<int>>, threshold array<array<double>>, value array<array<double>>"
)
ERRORS = "n_test int, mae_model double"


def _inputs(split: DataFrame) -> DataFrame:
    """Every account's days in order, in one task; `_day` counts from 1.

    The window asks for a shuffle or a sort only if the rows are not dealt by account and in order already, as `densify` and
    `with_split` leave them. Doubles go through it, which are cheaper to copy than wide decimals. Days are given as numbers.
    """
    by_day = Window.partitionBy("account_id").orderBy("txn_date")
    plain = split.select("account_id", "txn_date", "is_train", F.col("net_flow").cast("double").alias("net_flow"),
                         *[F.col(c).cast("double").alias(c) for c in FEATURES])
    ordered = plain.withColumn("_day", F.row_number().over(by_day)).sortWithinPartitions("account_id", "txn_date")
    return ordered.withColumn("txn_date", F.unix_date("txn_date"))


def _fitted(split: DataFrame, columns: str, n_trees: int, depth: int, rate: float, models: bool, errors: bool) -> DataFrame:
    """One row for each account's series, from the fitter in the tasks' JVM, which holds one series at a time."""
    spark = split.sparkSession
    fitter = jvm_object(spark, FITTER, "tallyspark.operators.SeriesFitter", len(FEATURES), n_trees, depth, float(rate),
                        schemas.LAGS, MOST_BINS, models, errors)
    types = spark.sparkContext._jvm.org.apache.spark.sql
    encoder = types.Encoders.row(types.types.StructType.fromDDL(columns))
    return DataFrame(_inputs(split)._jdf.mapPartitions(fitter, encoder), spark)


def _with_last_day(fitted: DataFrame) -> DataFrame:
    return fitted.withColumn("last", F.date_from_unix_date("last"))


def backtest(split: DataFrame, n_trees: int = schemas.BOOSTER_TREES, depth: int = schemas.BOOSTER_DEPTH,
             rate: float = schemas.BOOSTER_RATE) -> DataFrame:
    """Per account, the error on its test days of a model fit to its train days: (account_id, n_test, mae_model).

    A series is one row per calendar day, so its size is bounded by the span
    of dates, however many transactions the account has.
    """
    return _fitted(split, f"account_id long, {ERRORS}", n_trees, depth, rate, models=False, errors=True)


def fit_models(split: DataFrame, n_trees: int = schemas.BOOSTER_TREES, depth: int = schemas.BOOSTER_DEPTH,
               rate: float = schemas.BOOSTER_RATE) -> DataFrame:
    """Per account, a model fit to all its days, as one row of plain arrays to store and score again later.

    The row also holds the last day and the days before it that the first
    forecasts need as lags.
    """
    return _with_last_day(_fitted(split, MODEL, n_trees, depth, rate, models=True, errors=False))


def train(split: DataFrame, n_trees: int = schemas.BOOSTER_TREES, depth: int = schemas.BOOSTER_DEPTH,
          rate: float = schemas.BOOSTER_RATE) -> DataFrame:
    """`fit_models` and `backtest` in one pass over the rows, which share their bins: MODEL, n_test and mae_model.

    Bins say nothing of the flows to predict, so the test days' part in them tells the backtest nothing.
    """
    return _with_last_day(_fitted(split, f"{MODEL}, {ERRORS}", n_trees, depth, rate, models=True, errors=True))


def forecast_steps(models: DataFrame, horizon: int = schemas.HORIZON) -> DataFrame:
    """Stored models carried forward a day at a time: (account_id, last, step, predicted_net_flow).

    Some models of a batch advance together; a forecast day is a lag of the next.
    """
    lags = schemas.LAGS

    def run(batches):
        for batch in batches:
            yield from series.carried(batch, horizon, lags)

    return models.select(*series.MODEL_COLUMNS).mapInArrow(
        run, "account_id long, last date, step int, predicted_net_flow double")


def forecast_table(steps: DataFrame, balances: DataFrame) -> DataFrame:
    """Forecast rows in cents; the balance runs over unrounded flows."""
    rows = _with_balance(steps, balances.withColumn(
        "current_balance", F.col("current_balance").cast("double")))
    return rows.select(
        "account_id", "forecast_date",
        F.col("predicted_net_flow").cast(schemas.MONEY).alias("predicted_net_flow"),
        F.col("predicted_balance").cast(schemas.MONEY).alias("predicted_balance"),
        F.lit(schemas.FORECAST_VERSION).alias("model_version"),
    )


def metrics(backtests: DataFrame, split: DataFrame) -> DataFrame:
    """Errors of both models per account, and whether the model beats the naive one."""
    return backtests.select("account_id", "mae_model").join(naive_mae(split), "account_id").withColumn(
        "better", F.col("mae_model") < F.col("mae_naive"))
