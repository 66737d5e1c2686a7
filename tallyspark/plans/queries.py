"""Every operator as a query over the provided tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schemas
from tallyspark.functions.columns import clean_text, slug
from tallyspark.operators import (
    analytics, anomaly, changes, forecast, marts, quality, reports, serving, staging, validation,
)
from tallyspark.plans import sql_functions
from tallyspark.plans.pipeline import run_pipeline
from tallyspark.plans.tables import Tables
from tallyspark.session import materialize, scratch, scratch_path
from tallyspark.sources import files

REGISTRY = {}


def query(name):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(Tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return register


def plain(df: DataFrame) -> DataFrame:
    """Money as doubles, dates as ISO text and whole numbers as bigint, to compare with other engines."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


# --- sources and sinks ------------------------------------------------------

def _write_csv(df: DataFrame, path: str) -> None:
    (df.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path))


@query("src_csv")
def _(t):
    """Columns in another order, and a line break and quotes inside a field."""
    path = scratch_path(t.spark, "transactions-csv")
    feed = t.raw_feed.withColumn("description", F.replace("description", F.lit(" - "), F.lit('\n"-", ')))
    _write_csv(feed.select(*reversed(feed.columns), F.lit("x").alias("unused")), path)
    back = files.read_raw_csv(t.spark, path, schemas.RAW_TABLES["transactions"])
    return back.filter(F.col(files.CORRUPT).isNull()).drop(files.CORRUPT)


@query("src_accounts_ref")
def _(t):
    path = scratch_path(t.spark, "accounts-csv")
    _write_csv(t.raw_accounts, path)
    return files.read_accounts_csv(t.spark, path).select("account_ref", "account_name", "opening_balance")


@query("src_table")
def _(t):
    return t.movements.filter(F.col("txn_type") == "debit").select("transaction_id", "account_id", "amount")


def _raw_zone(t):
    return {
        "accounts": t.raw_accounts, "categories": t.raw_categories, "merchants": t.raw_merchants,
        "transactions": t.raw_feed, "budgets": t.raw_budgets,
    }


@query("sink_raw_overwrite")
def _(t):
    """Lands the raw zone twice; each table must hold one copy."""
    out = scratch_path(t.spark, "raw-zone")
    files.land_raw(_raw_zone(t), out)
    counts = None
    for name, path in files.land_raw(_raw_zone(t), out).items():
        n = t.spark.read.parquet(path).agg(F.count("*").alias("n"))
        n = n.select(F.lit(name).alias("table_name"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return counts


@query("sink_loaded_at")
def _(t):
    stamped = files.stamp_loaded_at(t.raw_feed)
    return stamped.agg(F.count("*").alias("n"), F.count("loaded_at").alias("n_stamped"))


@query("sink_ml_replace")
def _(t):
    """Replaces the flag table twice; it must hold one copy."""
    path = scratch_path(t.spark, "flags")
    flags = anomaly.rule_flags(t.event_features)
    files.replace_table(flags, path)
    files.replace_table(flags, path)
    return t.spark.read.parquet(path).select("transaction_id", "reason")


@query("sink_materialize")
def _(t):
    """Staging as a view, a mart stored from it."""
    views = files.materialize_layer({"transactions": t.movements}, "", "staging", as_views=True)
    mart = {"monthly_cashflow": marts.monthly_cashflow(views["transactions"])}
    out = scratch_path(t.spark, "layers")
    return files.materialize_layer(mart, out, "analytics", as_views=False)["monthly_cashflow"]


@query("sink_csv_export")
def _(t):
    named = anomaly.rule_flags(t.event_features).select(
        "transaction_id", F.col("z_amount").alias("anomaly_score"),
        F.concat(F.lit("User #"), F.col("account_id").cast("string"), F.lit("'s Account")).alias("account_name"))
    path = scratch_path(t.spark, "export")
    files.export_flags_csv(named, path)
    schema = T.StructType(named.schema.fields + [T.StructField("account_slug", T.StringType())])
    return t.spark.read.option("header", True).schema(schema).csv(path)


# --- cleaning, validation, keys -----------------------------------------------

def _register_rules():
    for rule, name in (
        ("account_ref", "val_account_ref"), ("category", "val_category"),
        ("amount_numeric", "val_amount_numeric"), ("amount_positive", "val_amount_positive"),
        ("txn_type", "val_txn_type"), ("txn_date", "val_date_present"), ("is_recurring", "val_is_recurring"),
    ):
        query(name)(lambda t, rule=rule: validation.rejected_by(t.checked, rule))


_register_rules()


@query("val_merchant_optional")
def _(t):
    return validation.accepted(t.checked).filter(F.col("merchant_id").isNull()).select(
        "transaction_id", "account_id", "category_name")


@query("val_round_cents")
def _(t):
    return validation.accepted(t.checked).select("transaction_id", "amount")


@query("val_report")
def _(t):
    return validation.validation_report(t.checked)


@query("val_reject_sample")
def _(t):
    return validation.reject_sample(t.checked, 10)


@query("load_accounts")
def _(t):
    return staging.load_accounts(t.raw_accounts)


@query("load_categories")
def _(t):
    return staging.load_categories(t.raw_categories)


@query("load_merchants")
def _(t):
    return staging.load_merchants(t.raw_merchants, staging.load_categories(t.raw_categories))


@query("load_merchants_repeated")
def _(t):
    """Categories listed twice, with another id each, leave one row a merchant."""
    categories = staging.load_categories(t.raw_categories)
    again = categories.withColumn("category_id", F.concat(F.lit("z"), "category_id"))
    return staging.load_merchants(t.raw_merchants, categories.unionByName(again))


@query("load_budgets")
def _(t):
    """The feed's loads as two files; the second, larger one wins."""
    path = scratch_path(t.spark, "budget-feed")
    feed = t.raw_budgets
    _write_csv(feed.filter("load_seq = 1").drop("load_seq"), f"{path}/a")
    _write_csv(feed.filter("load_seq > 1").drop("load_seq"), f"{path}/b")
    back = files.read_raw_csv(t.spark, f"{path}/*", schemas.RAW_TABLES["budgets"], order="load_seq")
    return staging.load_budgets(back, staging.load_categories(t.raw_categories), t.accounts)


@query("stg_accounts")
def _(t):
    return staging.stage_accounts(t.raw_accounts)


@query("stg_categories")
def _(t):
    return staging.stage_categories(t.raw_categories)


@query("stg_merchants")
def _(t):
    return staging.stage_merchants(t.raw_merchants)


@query("stg_transactions")
def _(t):
    return staging.stage_transactions(t.raw_feed)


@query("stg_report")
def _(t):
    return staging.staging_report(t.raw_feed)


@query("stg_budgets")
def _(t):
    return staging.stage_budgets(t.raw_budgets)


@query("clean_text")
def _(t):
    return t.raw_feed.select("source_txn_id", clean_text("description").alias("description"))


@query("suggest_category")
def _(t):
    rows = t.ledger.withColumn(
        "category_name", F.when(F.col("is_recurring"), F.col("category_name")).otherwise("  "))
    return staging.suggest_category(rows, t.merchants).select(
        "transaction_id", "suggested_category", "effective_category")


@query("budget_baseline")
def _(t):
    return t.budgets


# --- data quality -------------------------------------------------------------

@query("dq_unique")
def _(t):
    return quality.duplicated_in_large(t.raw_table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_not_null")
def _(t):
    return quality.nulls(t.raw_feed, "merchant_name").select("source_txn_id")


@query("dq_relationships")
def _(t):
    child = t.raw_feed.select(F.trim("category_name").alias("category_name"))
    return quality.orphans(child, "category_name", t.categories, "category_name")


@query("dq_accepted_values")
def _(t):
    return quality.outside(t.raw_feed, "txn_type", schemas.TXN_TYPES).select("source_txn_id", "txn_type")


@query("dq_schema_checks")
def _(t):
    tables = {
        "accounts": staging.stage_accounts(t.raw_accounts),
        "categories": staging.stage_categories(t.raw_categories),
        "merchants": staging.stage_merchants(t.raw_merchants),
        "transactions": staging.stage_transactions(t.raw_transactions),
        "budgets": materialize(t.budgets, "budgets"),
    }
    return quality.run_tests(tables, quality.SCHEMA_TESTS)


@query("dq_gate")
def _(t):
    accounts = staging.stage_accounts(t.raw_accounts)
    categories = staging.stage_categories(t.raw_categories)
    transactions = staging.stage_transactions(t.raw_transactions)
    fct = marts.fct_transactions(transactions, categories)
    tables = {
        "stg_accounts": accounts, "stg_categories": categories,
        "stg_merchants": staging.stage_merchants(t.raw_merchants),
        "stg_transactions": transactions, "dim_accounts": accounts, "fct_transactions": fct,
        "account_health": marts.account_health(accounts, transactions),
    }
    return quality.run_tests(tables, quality.STAGING_TESTS + quality.MART_TESTS)


# --- marts --------------------------------------------------------------------

@query("dim_accounts")
def _(t):
    return t.accounts


@query("dim_categories")
def _(t):
    return t.categories


@query("fct_transactions")
def _(t):
    return t.fct


@query("monthly_cashflow")
def _(t):
    return t.monthly


@query("category_spend_monthly")
def _(t):
    return t.spend


@query("account_health")
def _(t):
    return t.health


@query("budget_vs_actual")
def _(t):
    return t.budget_vs_actual


@query("recurring_transactions")
def _(t):
    return t.recurring


# --- the ten questions ----------------------------------------------------------

@query("q01_accounts")
def _(t):
    return analytics.account_list(t.accounts)


@query("q02_recent_txns")
def _(t):
    return analytics.recent_transactions(t.ledger_with_orphans, t.accounts, t.categories)


@query("q03_category_total")
def _(t):
    return analytics.category_totals(t.ledger_with_orphans, t.categories)


@query("q04_high_expense_accounts")
def _(t):
    return analytics.high_expense_accounts(t.monthly)


@query("q05_mom_change")
def _(t):
    return analytics.month_on_month(t.monthly)


@query("q06_rolling7")
def _(t):
    return analytics.rolling_daily_spend(t.movements)


@query("q07_top3_categories")
def _(t):
    return analytics.top_categories(t.spend)


@query("q08_anomaly_review")
def _(t):
    return analytics.review_flags(t.flags_with_orphans, t.ledger_with_orphans, t.accounts)


@query("q09_budget_variance")
def _(t):
    return analytics.budget_variance(t.budgets, t.categories, t.stored_spend)


@query("q10_runway")
def _(t):
    return analytics.runway(t.health)


# --- serving ----------------------------------------------------------------------

@query("srv_accounts")
def _(t):
    return serving.account_picker(t.accounts)


@query("srv_health")
def _(t):
    return serving.health_rows(t.health)


@query("srv_monthly")
def _(t):
    return serving.monthly_rows(t.monthly)


@query("srv_forecast")
def _(t):
    return serving.forecast_rows(t.naive_forecast)


@query("srv_category_spend")
def _(t):
    return serving.category_spend_rows(t.spend)


@query("srv_anomalies")
def _(t):
    return serving.anomaly_rows(t.distance_flags, t.ledger)


@query("srv_txn_count")
def _(t):
    return serving.transaction_count(t.movements)


@query("srv_budget_vs_actual")
def _(t):
    return serving.budget_rows(t.budget_vs_actual)


@query("srv_recurring")
def _(t):
    return serving.recurring_rows(t.recurring)


@query("srv_category_drilldown")
def _(t):
    return serving.category_drilldown(t.ledger, "PROMO", "1998-01", "1998-06")


@query("srv_categories")
def _(t):
    return serving.category_names(t.categories)


@query("srv_merchants")
def _(t):
    return serving.merchant_names(t.merchants)


@query("srv_recent_300")
def _(t):
    return serving.newest_per_account(t.ledger)


@query("srv_data_status")
def _(t):
    return serving.data_status(files.stamp_loaded_at(t.movements)).select(
        "n", "last_txn_date", F.col("last_loaded_at").isNotNull().alias("is_stamped"))


@query("srv_access_filter")
def _(t):
    """Three users: one who sees everything, one nation's, one unknown."""
    seen = None
    for user in ("demo", "nation_3", "nobody"):
        rows = serving.visible_accounts(t.accounts, t.access, user).select(
            F.lit(user).alias("username"), "account_id", "account_name")
        seen = rows if seen is None else seen.unionByName(rows)
    return seen


@query("srv_data_status_stored")
def _(t):
    """The status of the ledger as it is stored by month."""
    path = scratch_path(t.spark, "ledger")
    files.write_ledger(t.ledger, path)
    return serving.data_status(files.read_ledger(t.spark, path))


# --- reports in SQL with bound parameters -------------------------------------------

def _in_sql(t, call, args, **tables):
    sql_functions.register(t.spark, tables)
    return t.spark.sql(f"SELECT * FROM {call}", args=args)


@query("sql_health_of")
def _(t):
    return _in_sql(t, "health_of(:account)", {"account": 7}, account_health=t.health)


@query("sql_monthly_cashflow_of")
def _(t):
    return _in_sql(t, "monthly_cashflow_of(:account)", {"account": 7}, monthly_cashflow=t.monthly)


@query("sql_category_spend_of")
def _(t):
    return _in_sql(t, "category_spend_of(:account)", {"account": 7}, category_spend_monthly=t.spend)


@query("sql_budget_vs_actual_of")
def _(t):
    return _in_sql(t, "budget_vs_actual_of(:account)", {"account": 7}, budget_vs_actual=t.budget_vs_actual)


@query("sql_recurring_of")
def _(t):
    return _in_sql(t, "recurring_of(:account)", {"account": 7}, recurring_transactions=t.recurring)


@query("sql_forecast_of")
def _(t):
    """A missing account stands for all."""
    return _in_sql(t, "forecast_of(:account)", {"account": None}, cashflow_forecast=t.naive_forecast)


@query("sql_anomalies_of")
def _(t):
    return _in_sql(t, "anomalies_of(:account)", {"account": 7}, anomaly_flags=t.distance_flags, fct_transactions=t.ledger)


@query("sql_category_drilldown")
def _(t):
    """Months in reverse order, all accounts."""
    return _in_sql(t, "category_drilldown(:category, :start, :end)",
                   {"category": "PROMO", "start": "1998-06", "end": "1998-01"}, fct_transactions=t.ledger)


@query("sql_newest_transactions")
def _(t):
    return _in_sql(t, "newest_transactions(:account)", {"account": 7}, fct_transactions=t.ledger).drop("place")


@query("sql_accounts_visible_to")
def _(t):
    return _in_sql(t, "accounts_visible_to(:user)", {"user": "nation_3"}, accounts=t.accounts, access=t.access)


# --- report frames ----------------------------------------------------------------

def _kpis(t):
    return reports.kpis(t.accounts, t.health, t.monthly)


@query("rep_kpi")
def _(t):
    return _kpis(t)


@query("rep_runway_status")
def _(t):
    return reports.runway_status(_kpis(t))


@query("rep_net_flow_sign")
def _(t):
    return reports.net_flow_marks(t.monthly)


@query("rep_month_range")
def _(t):
    """A range with its ends in reverse order."""
    return reports.in_months(t.spend, "1999-03", "1998-11")


@query("rep_category_rollup")
def _(t):
    return reports.category_rollup(t.spend, "1998-01", "1998-12")


@query("rep_budget_rollup")
def _(t):
    return reports.budget_rollup(t.budget_vs_actual, "0001-01", "9999-12")


@query("rep_over_budget_names")
def _(t):
    return reports.over_budget_names(reports.budget_rollup(t.budget_vs_actual, "0001-01", "9999-12"))


@query("rep_recurring_changed")
def _(t):
    changes_ = reports.recurring_changes(t.recurring)
    return reports.changed_merchants(changes_)


@query("rep_recommendations")
def _(t):
    return reports.recommendations(
        t.stored_spend, materialize(t.budget_vs_actual, "budget-vs-actual"), t.health, t.naive_forecast)


# --- anomalies ----------------------------------------------------------------------

@query("anom_input")
def _(t):
    return anomaly.debits(t.ledger_with_orphans, t.categories)


@query("anom_calendar")
def _(t):
    return anomaly.with_calendar(anomaly.debits(t.events)).select("transaction_id", "day_of_week", "day_of_month")


@query("anom_zscore")
def _(t):
    return anomaly.with_zscore(anomaly.debits(t.events)).select("transaction_id", "z_amount")


@query("anom_same_day")
def _(t):
    return anomaly.with_same_day(anomaly.debits(t.events)).select("transaction_id", "same_day")


@query("anom_features")
def _(t):
    return t.event_features.select(
        "transaction_id", *[F.col("vector")[i].alias(f"f{i}_{c}") for i, c in enumerate(anomaly.FEATURES)])


@query("anom_iforest_fit")
def _(t):
    """The grown forest, one row per tree."""
    featured = anomaly.stored_features(t.events)
    model = anomaly.fit_forest(featured)
    return anomaly.describe(t.spark, model)


@query("anom_iforest_score")
def _(t):
    featured = anomaly.stored_features(t.events)
    return anomaly.fit_forest(featured).score(featured).select("transaction_id", "raw_score")


@query("anom_threshold")
def _(t):
    """Flagged and unflagged rows at the exact contamination percentile."""
    found = anomaly.detect(t.events)
    return found.scored.groupBy((F.col("raw_score") > found.threshold).alias("flagged")).agg(
        F.count("*").alias("n"), F.min("raw_score").alias("lowest"), F.max("raw_score").alias("highest"))


@query("anom_normalize")
def _(t):
    found = anomaly.detect(t.events)
    return anomaly.normalise(found.scored).select("transaction_id", "anomaly_score")


@query("anom_threshold_of_distance")
def _(t):
    """The same threshold over a score that SQL can compute."""
    threshold = anomaly.contamination_threshold(t.z_scored)
    return t.z_scored.agg(
        F.round(F.lit(threshold), 9).alias("threshold"), F.count("*").alias("n"),
        F.count_if(F.col("raw_score") > threshold).alias("n_flagged"))


@query("anom_normalize_of_distance")
def _(t):
    return anomaly.normalise(t.z_scored).select("transaction_id", "anomaly_score")


@query("anom_forest_facts")
def _(t):
    """What must hold for the forest and its flags, whatever it learnt."""
    with scratch(t.spark):
        found = anomaly.detect(t.events)
        scored = found.scored.agg(
            F.count("*").alias("n"), (F.min("raw_score") > 0).alias("above_0"), (F.max("raw_score") < 1).alias("below_1"),
            F.count_if(F.col("raw_score") > found.threshold).alias("n_above"),
            F.count_if(F.col("raw_score") >= found.threshold).alias("n_from")).first()
        n_flags = found.flags.count()
        trees = anomaly.describe(t.spark, anomaly.fit_forest(anomaly.stored_features(t.events))).agg(
            F.count("*").alias("n"), F.count_if(F.col("nodes") == 2 * F.col("leaves") - 1).alias("n_binary")).first()
    # Ranks above the percentile's are flagged, but for ties with it.
    most = scored["n"] - 1 - int((scored["n"] - 1) * (1 - schemas.CONTAMINATION))
    return t.spark.range(1).select(
        F.lit(scored["n"]).alias("n"), F.lit(scored["above_0"] and scored["below_1"]).alias("scores_in_range"),
        F.lit(n_flags == scored["n_above"] <= most <= scored["n_from"] + 1).alias("flags_follow"),
        F.lit(trees["n"]).alias("n_trees"), F.lit(trees["n_binary"]).alias("n_binary"))


@query("anom_reason")
def _(t):
    return t.event_features.select("transaction_id", anomaly.reason().alias("reason"))


@query("anom_write")
def _(t):
    path = scratch_path(t.spark, "anomaly-flags")
    files.replace_table(anomaly.detect(t.events).flags, path)
    return t.spark.read.parquet(path)


@query("anom_rules")
def _(t):
    return anomaly.rule_flags(t.event_features)


@query("anom_duplicate_charges")
def _(t):
    """Equal charges, to the whole unit, of one user and type on one day."""
    return anomaly.duplicate_charges(t.events.withColumns(
        {"merchant_name": F.col("category_name"), "amount": F.floor("amount").cast(schemas.MONEY)}))


@query("anom_small_bursts")
def _(t):
    return anomaly.small_charge_bursts(t.events.withColumn("category_name", F.lit("any")))


# --- forecasts ----------------------------------------------------------------------

@query("fc_daily_net")
def _(t):
    return forecast.daily_net(t.movements)


@query("fc_densify")
def _(t):
    return t.dense


@query("fc_lags")
def _(t):
    return forecast.with_lags(t.dense)


@query("fc_calendar")
def _(t):
    return forecast.with_calendar(t.dense)


@query("fc_rolling_mean")
def _(t):
    return forecast.with_rolling_mean(t.dense)


@query("fc_dropna")
def _(t):
    return forecast.feature_rows(t.dense)


@query("fc_min_history")
def _(t):
    """Accounts of the short event ledger that cannot be forecast."""
    dense = forecast.densify(forecast.daily_net(t.events))
    users = t.events.select("account_id").distinct()
    return forecast.skipped_accounts(users, forecast.feature_rows(dense))


@query("fc_split")
def _(t):
    return t.forecast_split.select("account_id", "txn_date", "n_rows", "is_train")


@query("fc_gbt_fit")
def _(t):
    return t.forecast_models.select("account_id", "n_rows", "start", "rate", "feature", "threshold", "value")


@query("fc_gbt_fit_facts")
def _(t):
    """What must hold for every stored model: its size, its rows and the mean it starts from."""
    return t.forecast_models.select(
        "account_id", "n_rows", F.round("start", 4).alias("start"), F.size("feature").alias("n_trees"),
        F.size(F.flatten("threshold")).alias("n_inner"), F.size(F.flatten("value")).alias("n_leaves"))


@query("fc_backtest_mae")
def _(t):
    return forecast.backtest(t.forecast_split).select("account_id", "mae_model")


@query("fc_backtest_facts")
def _(t):
    found = forecast.metrics(forecast.backtest(t.forecast_split), t.forecast_split)
    return found.select(
        "account_id", F.round("mae_naive", 6).alias("mae_naive"), (F.col("mae_model") >= 0).alias("is_error"),
        (F.col("better") == (F.col("mae_model") < F.col("mae_naive"))).alias("agrees"))


@query("fc_naive_mae")
def _(t):
    return forecast.naive_mae(t.forecast_split)


@query("fc_recursive")
def _(t):
    return forecast.forecast_steps(t.forecast_models).select(
        "account_id", F.expr("date_add(last, step)").alias("forecast_date"), "predicted_net_flow")


@query("fc_running_balance")
def _(t):
    return t.forecast


@query("fc_forecast_facts")
def _(t):
    """What must hold for every account's forecast: its days, and that the balance follows the flows."""
    start = t.health.select("account_id", F.col("current_balance").cast("double").alias("start"))
    # Flows and balances are rounded on their own, half a cent each at most.
    off = F.col("end") - F.col("start") - F.col("flows")
    return t.forecast.groupBy("account_id").agg(
        F.count("*").alias("n"), F.countDistinct("forecast_date").alias("n_days"),
        F.min("forecast_date").alias("first_day"), F.max("forecast_date").alias("last_day"),
        F.max_by("predicted_balance", "forecast_date").cast("double").alias("end"),
        F.sum("predicted_net_flow").cast("double").alias("flows"),
    ).join(start, "account_id").select(
        "account_id", "n", "n_days", "first_day", "last_day", (F.abs(off) < 0.16).alias("balance_follows"))


@query("fc_seasonal_naive")
def _(t):
    return t.naive_forecast


@query("fc_write")
def _(t):
    path = scratch_path(t.spark, "cashflow-forecast")
    files.replace_table(t.forecast, path)
    return t.spark.read.parquet(path)


@query("fc_write_facts")
def _(t):
    """Writes the forecast twice; it must hold one copy."""
    path = scratch_path(t.spark, "cashflow-forecast")
    forecasts = materialize(t.forecast, "forecast")
    for _ in range(2):
        files.replace_table(forecasts, path)
    return t.spark.read.parquet(path).groupBy("model_version").agg(
        F.count("*").alias("n"), F.countDistinct("account_id").alias("n_accounts"))


@query("fc_metrics")
def _(t):
    return forecast.metrics(forecast.backtest(t.forecast_split), t.forecast_split)


# --- change sets ----------------------------------------------------------------------

@query("edit_append")
def _(t):
    new_rows = t.events.select(
        F.concat(F.lit("e-"), F.col("transaction_id").cast("string")).alias("transaction_id"),
        "account_id", "txn_date", F.concat(F.lit(" "), "merchant_name").alias("merchant_name"), "category_name",
        (-F.col("amount")).alias("amount"), "txn_type", F.lit("  ").alias("description"),
        F.lit(False).alias("is_recurring"))
    return changes.append_rows(t.ledger, new_rows)


@query("edit_update_delete")
def _(t):
    """Two updates of each changed id, the later one with the smaller values."""
    changed = t.ledger.filter(F.col("is_recurring"))
    first = changed.withColumns({"amount": F.col("amount") + 1, "merchant_name": F.lit("Zz"), "sequence": F.lit(1)})
    last = changed.withColumns({
        "amount": -F.col("amount"), "merchant_name": F.lit("  "), "txn_type": F.lit("credit"), "sequence": F.lit(2)})
    deletes = t.ledger.filter(F.col("amount") < 30000).select("transaction_id")
    return changes.apply_changes(t.ledger, last.unionByName(first), deletes)


@query("edit_stored_months")
def _(t):
    """Changes of a stored ledger: the first months' credits are doubled, its other recurring rows move a year ahead, and
    its smaller other rows go. Only these months and those a year later are written."""
    path = scratch_path(t.spark, "ledger")
    files.write_ledger(t.ledger, path)
    early = files.read_ledger(t.spark, path).filter("txn_month < '1992-04'").drop("txn_month")
    credits = early.filter("txn_type = 'credit'").withColumns({"amount": F.col("amount") * 2, "sequence": F.lit(1)})
    moved = early.filter("is_recurring AND txn_type <> 'credit'").withColumns({
        "txn_date": F.date_add("txn_date", 366), "sequence": F.lit(1)})
    gone = early.filter("NOT is_recurring AND amount < 20000").select("transaction_id")
    months = changes.change_stored_ledger(t.spark, path, credits.unionByName(moved), gone)
    return files.read_ledger(t.spark, path).withColumn("rewritten", F.col("txn_month").isin(months)).drop("txn_month")


@query("edit_merchant_upsert")
def _(t):
    """Events naming merchants by their key, some of which are known brands."""
    rows = t.events.withColumn("merchant_name", F.concat(F.lit(" Brand#"), "merchant_name"))
    return changes.add_merchants(t.merchants, rows)


@query("edit_category_rules")
def _(t):
    rules = t.raw_table("part").groupBy(F.col("p_brand").alias("merchant_name")).agg(
        F.min("p_type").alias("default_category")).filter(F.col("merchant_name") >= "Brand#2")
    return changes.apply_category_rules(t.merchants, rules)


@query("slug")
def _(t):
    return t.accounts.select("account_id", slug("account_name").alias("slug"))


# --- the whole run ----------------------------------------------------------------------

@query("run_pipeline")
def _(t):
    """Raw files of the whole tables through every step; rows of each result."""
    base = scratch_path(t.spark, "run")
    for name, df in _raw_zone(t).items():
        _write_csv(df.drop("load_seq"), f"{base}/in/{name}.csv")
    run = run_pipeline(t.spark, f"{base}/in", f"{base}/out")
    report = None
    for name, df in sorted(run.tables.items()):
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        report = n if report is None else report.unionByName(n)
    return report


@query("run_pipeline_facts")
def _(t):
    """Rows of the run's tables that SQL can count."""
    counted = REGISTRY["run_pipeline"](t.spark, t.sf_dir)
    return counted.filter(F.col("table_name").isin(
        "accounts", "categories", "merchants", "raw_transactions", "checked", "rejected", "fct_transactions",
        "malformed_rows", "data_tests", "budgets", "account_health", "skipped_accounts"))
