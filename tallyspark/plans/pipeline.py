"""The daily run: raw files to validated ledger, marts, gate, models and results."""

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import anomaly, forecast, marts, quality, staging, validation
from tallyspark.session import materialize, scratch
from tallyspark.sources import files


@dataclass
class RunResult:
    """Tables of a run by name, and the seconds each step took."""

    tables: dict[str, DataFrame]
    seconds: dict[str, float] = field(default_factory=dict)


def run_pipeline(spark: SparkSession, in_dir: str, out_dir: str) -> RunResult:
    """Read the raw CSV files below `in_dir`, write every result below `out_dir`.

    Each step ends in a written table, so a lost executor costs tasks of one
    step only and later steps read columns, not lineage. Malformed rows of any
    feed end up in `malformed_rows`, those of transactions in `rejected` too. A
    later row of the budget feed replaces an earlier one; files are in order of
    their paths. `out_dir` must not lie below `in_dir`.

    Raw tables, staging and marts are written to the run's own folder and tested there. Only when the gate lets them
    pass are they put into place, all together; otherwise it raises, every published table is the old one, and the run's
    folder stays to be looked at. The two models read published tables and run side by side.
    """
    run = RunResult({})
    publication = files.Publication(spark, out_dir)

    def step(name, work):
        started = time.monotonic()
        work()
        run.seconds[name] = round(time.monotonic() - started, 3)

    def stored(name, df, partition_by=None):
        run.tables[name] = publication.write(name, df, partition_by)

    def replaced(name, df):
        path = f"{out_dir}/{name}"
        files.replace_table(df, path)
        run.tables[name] = spark.read.schema(df.schema).parquet(path)

    def raw_view(name, landed):
        """The validation gives malformed transactions their reason; other feeds go on without such rows."""
        whole = landed.filter(F.col(files.CORRUPT).isNull()).drop(files.CORRUPT)
        return landed if name == "transactions" else whole

    def load_raw():
        raw = {
            name: files.read_raw_csv(spark, f"{in_dir}/{name}.csv", schema, order="load_seq" if name == "budgets" else None)
            for name, schema in schemas.RAW_TABLES.items() if name != "accounts"
        }
        raw["accounts"] = files.read_accounts_csv(spark, f"{in_dir}/accounts.csv")
        malformed = None
        for name, df in raw.items():
            landed = publication.write(f"raw_{name}", files.stamp_loaded_at(df))
            marked = landed.filter(F.col(files.CORRUPT).isNotNull()).select(
                F.lit(name).alias("feed"), F.col(files.CORRUPT).alias("record"))
            malformed = marked if malformed is None else malformed.unionByName(marked)
            run.tables[f"raw_{name}"] = raw_view(name, landed)
        stored("malformed_rows", malformed)

    def stage():
        t = run.tables
        stored("accounts", staging.stage_accounts(t["raw_accounts"]))
        stored("categories", staging.stage_categories(t["raw_categories"]))
        stored("merchants", staging.stage_merchants(t["raw_merchants"]))
        checked = validation.check_transactions(
            t["raw_transactions"], t["accounts"], t["categories"], t["merchants"])
        stored("checked", checked)
        stored("rejected", validation.rejected(t["checked"]))
        fct = marts.fct_transactions(validation.accepted(t["checked"]), t["categories"])
        stored("fct_transactions", files.ledger_layout(fct), files.LEDGER_PARTITION)
        budgets = staging.load_budgets(t["raw_budgets"], t["categories"], t["accounts"])
        stored("budgets", budgets.drop("category_id"))

    def build_marts():
        t = run.tables
        fct = t["fct_transactions"]
        # The ledger is read for three marts; the others build on those.
        stored("daily_movement", marts.daily_movement(fct))
        stored("monthly_cashflow", marts.monthly_from_daily(t["daily_movement"]))
        stored("account_health", marts.health_from_daily(t["accounts"], t["daily_movement"]))
        stored("category_spend_monthly", marts.category_spend_monthly(fct))
        stored("budget_vs_actual", marts.budget_vs_actual(t["budgets"], t["category_spend_monthly"]))
        stored("recurring_transactions", marts.recurring_transactions(fct))

    def gate():
        t = run.tables
        tested = {
            "stg_accounts": t["accounts"], "stg_categories": t["categories"],
            "stg_merchants": t["merchants"], "stg_transactions": validation.accepted(t["checked"]),
            "dim_accounts": t["accounts"], "fct_transactions": t["fct_transactions"],
            "account_health": t["account_health"],
        }
        stored("data_tests", quality.run_tests(tested, quality.STAGING_TESTS + quality.MART_TESTS))
        quality.assert_gate(t["data_tests"])

    def publish():
        for name, df in publication.publish().items():
            run.tables[name] = raw_view(name.removeprefix("raw_"), df) if name.startswith("raw_") else df

    def flag():
        if anomaly.debits(run.tables["fct_transactions"]).isEmpty():
            return
        with scratch(spark):
            replaced("anomaly_flags", anomaly.detect(run.tables["fct_transactions"]).flags)

    def predict():
        t = run.tables
        daily = t["daily_movement"].select("account_id", "txn_date", "net_flow")
        rows = forecast.feature_rows(forecast.densify(daily))
        replaced("skipped_accounts", forecast.skipped_accounts(t["accounts"], rows))
        # Days are made anew where they are read: that costs less than storing them, and they stay dealt as `densify` does.
        split = forecast.with_split(rows)
        with scratch(spark):
            trained = materialize(forecast.train(split), "trained")
            replaced("forecast_models", trained.drop("n_test", "mae_model"))
            replaced("forecast_metrics", forecast.metrics(trained, split))
        steps = forecast.forecast_steps(t["forecast_models"])
        replaced("cashflow_forecast", forecast.forecast_table(steps, t["account_health"]))

    for name, work in (
        ("load raw", load_raw), ("stage and validate", stage), ("marts", build_marts),
        ("quality gate", gate), ("publish", publish),
    ):
        step(name, work)
    with ThreadPoolExecutor(2) as models:
        for running in [models.submit(step, *s) for s in (("anomalies", flag), ("forecast", predict))]:
            running.result()
    return run
