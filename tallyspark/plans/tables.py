"""The provided tables as a ledger, with every derived table built on first use."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import anomaly, forecast, marts, staging, validation
from tallyspark.session import materialize
from tallyspark.sources import testtables as source


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw_table(self, name: str) -> DataFrame:
        return source.table(self.spark, self.sf_dir, name)

    def _from(self, build) -> DataFrame:
        return build(self.spark, self.sf_dir)

    @cached_property
    def accounts(self):
        return self._from(source.accounts)

    @cached_property
    def categories(self):
        return self._from(source.categories)

    @cached_property
    def merchants(self):
        return self._from(source.merchants)

    @cached_property
    def movements(self):
        """The ledger without names, for work that needs no join."""
        return self._from(source.cash_movements)

    @cached_property
    def ledger(self):
        return self._from(source.transactions)

    @cached_property
    def ledger_with_orphans(self):
        """The ledger and newer rows whose account or category does not exist."""
        newer = self.ledger.filter("is_recurring").withColumn("txn_date", F.date_add("txn_date", 36500))
        of_unknown_account = newer.withColumns({
            "transaction_id": F.concat(F.lit("a-"), "transaction_id"),
            "account_id": F.col("account_id") + 1_000_000_000})
        of_unknown_category = newer.withColumns({
            "transaction_id": F.concat(F.lit("c-"), "transaction_id"), "category_name": F.lit("Uncharted")})
        return self.ledger.unionByName(of_unknown_account).unionByName(of_unknown_category)

    @cached_property
    def events(self):
        return self._from(source.event_transactions)

    @cached_property
    def fct(self):
        return marts.fct_transactions(self.ledger, self.categories)

    @cached_property
    def monthly(self):
        return marts.monthly_cashflow(self.movements)

    @cached_property
    def spend(self):
        return marts.category_spend_monthly(self.fct)

    @cached_property
    def stored_spend(self):
        """The spend mart written once, for reports that read it several times."""
        return materialize(self.spend, "category-spend")

    @cached_property
    def health(self):
        return marts.account_health(self.accounts, self.movements)

    @cached_property
    def budgets(self):
        return marts.budget_baseline(self.stored_spend, self.movements)

    @cached_property
    def budget_vs_actual(self):
        return marts.budget_vs_actual(self.budgets, self.stored_spend)

    @cached_property
    def recurring(self):
        return marts.recurring_transactions(self.ledger)

    @cached_property
    def raw_accounts(self):
        return self._from(source.raw_accounts)

    @cached_property
    def raw_categories(self):
        return self._from(source.raw_categories)

    @cached_property
    def raw_merchants(self):
        return self._from(source.raw_merchants)

    @cached_property
    def raw_feed(self):
        """Raw transactions as they arrive."""
        return self._from(source.raw_transactions)

    @cached_property
    def raw_transactions(self):
        """The feed landed in the raw zone, for queries that clean or test it in several passes."""
        return materialize(self.raw_feed, "raw-transactions")

    @cached_property
    def raw_budgets(self):
        return source.raw_budgets(self.budgets)

    @cached_property
    def checked(self):
        return validation.check_transactions(
            self.raw_feed, staging.stage_accounts(self.raw_accounts),
            staging.stage_categories(self.raw_categories), staging.stage_merchants(self.raw_merchants))

    @cached_property
    def event_features(self):
        return anomaly.features(self.events)

    @cached_property
    def distance_flags(self):
        """Flags with a score that SQL can compute too: the z-score's distance."""
        debits = materialize(anomaly.debits(self.ledger), "debits")
        rows = anomaly.with_same_day(anomaly.with_zscore(debits))
        score = (F.floor(F.abs("z_amount") * 1000) / 10000).cast("decimal(6,4)")
        return rows.filter(F.abs("z_amount") > 1.5).select(
            "transaction_id", score.alias("anomaly_score"), anomaly.reason().alias("reason"))

    @cached_property
    def flags_with_orphans(self):
        """The same flags and higher ones of unknown accounts and of transactions that do not exist."""
        ids = self.ledger.filter("is_recurring").select("transaction_id")
        higher = [
            ids.select(F.concat(F.lit(prefix), "transaction_id").alias("transaction_id"),
                       F.lit(9).cast("decimal(6,4)").alias("anomaly_score"), F.lit("x").alias("reason"))
            for prefix in ("a-", "gone-")
        ]
        return self.distance_flags.unionByName(higher[0]).unionByName(higher[1])

    @cached_property
    def dense(self):
        return forecast.densify(forecast.daily_net(self.movements))

    @cached_property
    def forecast_split(self):
        return forecast.with_split(forecast.feature_rows(self.dense))

    @cached_property
    def forecast_models(self):
        """The fitted models as a stored table, which forecasts read."""
        return materialize(forecast.fit_models(self.forecast_split), "forecast-models")

    @cached_property
    def forecast(self):
        return forecast.forecast_table(forecast.forecast_steps(self.forecast_models), self.health)

    @cached_property
    def z_scored(self):
        """Events with a score that SQL can compute too: the z-score's distance."""
        return self.event_features.select(
            "transaction_id", F.round(F.abs(F.coalesce("z_amount", F.lit(0.0))) / 1000, 9).alias("raw_score"))

    @cached_property
    def naive_forecast(self):
        return forecast.seasonal_naive(forecast.daily_net(self.movements), self.health)

    @cached_property
    def access(self):
        """Who may see which account: a user per nation, and one who sees all."""
        named = self.raw_table("supplier").select(
            F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("username"),
            F.col("s_name").alias("account_name"))
        everyone = named.agg(F.lit("demo").alias("username"), F.lit("*").alias("account_name"))
        return named.unionByName(everyone)
