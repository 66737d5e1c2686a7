"""The ten documented analysis questions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators.marts import actual_by_category


def account_list(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id", "account_name", "account_type", "opening_balance")


def recent_transactions(ledger: DataFrame, accounts: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """The newest `n` rows with names, of rows whose account and category exist.

    Both lookups come before the cut, so rows of unknown keys take no place.
    The cut itself keeps `n` rows per task.
    """
    named = accounts.select("account_id", "account_name").dropDuplicates(["account_id"])
    return (
        of_known_categories(ledger, categories).join(named, "account_id")
        .orderBy(F.desc("txn_date"), "transaction_id").limit(n)
        .select("transaction_id", "txn_date", "account_name", "merchant_name", "category_name", "amount", "txn_type")
    )


def of_known_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    return rows.join(categories.select("category_name"), "category_name", "left_semi").select(*rows.columns)


def category_totals(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Debits by category; the few sums are looked up, not the rows."""
    sums = ledger.filter(F.col("txn_type") == "debit").groupBy("category_name").agg(F.sum("amount").alias("total_spend"))
    return of_known_categories(sums, categories).orderBy(F.desc("total_spend"), "category_name")


def high_expense_accounts(monthly: DataFrame, above: int = 3000) -> DataFrame:
    return (
        monthly.groupBy("account_id")
        .agg(F.sum("total_expense").alias("expense"), F.count("*").alias("n_months"))
        .filter(F.col("expense") > F.col("n_months") * above)
        .select("account_id", (F.col("expense").cast("double") / F.col("n_months")).alias("avg_monthly_expense"))
    )


def month_on_month(monthly: DataFrame) -> DataFrame:
    """Net flow against the account's previous month with rows; the first month has none."""
    by_month = Window.partitionBy("account_id").orderBy("month")
    return monthly.select(
        "account_id", "month", "net_flow",
        (F.col("net_flow") - F.lag("net_flow").over(by_month)).alias("mom_change"),
    )


def rolling_daily_spend(ledger: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the last seven days that have debits; days without any do not count."""
    daily = (
        ledger.filter(F.col("txn_type") == "debit")
        .groupBy("account_id", "txn_date").agg(F.sum("amount").alias("daily_spend"))
    )
    frame = Window.partitionBy("account_id").orderBy("txn_date").rowsBetween(-(days - 1), 0)
    mean = F.sum("daily_spend").over(frame).cast("double") / F.count("daily_spend").over(frame)
    return daily.withColumn("rolling_7day_avg", mean)


def top_categories(spend: DataFrame, k: int = 3) -> DataFrame:
    """The highest categories per account and month; equal spend shares a rank."""
    ranked = F.rank().over(Window.partitionBy("account_id", "month").orderBy(F.desc("total_amount")))
    return (
        spend.select("account_id", "month", "category_name", "total_amount", ranked.alias("rnk"))
        .filter(F.col("rnk") <= k)
    )


def review_flags(flags: DataFrame, ledger: DataFrame, accounts: DataFrame, n: int = 20) -> DataFrame:
    """The `n` most anomalous flags whose transaction and account exist, with their detail.

    Flags are few beside the ledger; they are joined before the cut, which
    keeps `n` rows per task.
    """
    named = accounts.select("account_id", "account_name").dropDuplicates(["account_id"])
    return (
        flags.select("transaction_id", "anomaly_score", "reason")
        .join(ledger.select("transaction_id", "account_id", "txn_date", "amount", "category_name"), "transaction_id")
        .join(named, "account_id")
        .orderBy(F.desc("anomaly_score"), "transaction_id").limit(n)
        .select("transaction_id", "anomaly_score", "reason", "txn_date", "account_name", "amount", "category_name")
    )


def budget_variance(budgets: DataFrame, categories: DataFrame, spend: DataFrame) -> DataFrame:
    known = budgets.join(categories.select("category_name"), "category_name")
    return (
        known.join(actual_by_category(spend), ["account_id", "month", "category_name"], "left")
        .withColumn("actual_amount", F.coalesce("actual_amount", F.lit(0).cast("decimal(12,2)")))
        .select(
            "account_id", "month", "category_name", "budgeted_amount", "actual_amount",
            (F.col("actual_amount") - F.col("budgeted_amount")).alias("variance"),
        )
        .orderBy(F.desc("variance"), "account_id", "month", "category_name")
    )


def runway_days():
    """Balance over burn; NULL without burn."""
    burn = F.col("avg_daily_burn").cast("double")
    return F.when(burn > 0, F.col("current_balance").cast("double") / F.nullif(burn, F.lit(0.0)))


def runway(health: DataFrame) -> DataFrame:
    """Days until the balance is used up, shortest first, accounts without burn first of all."""
    return health.select(
        "account_id", "account_name", "current_balance", "avg_daily_burn", runway_days().alias("runway_days")
    ).orderBy(F.asc_nulls_first("runway_days"), "account_id")
