"""Report queries. Each serves one account when `account_id` is given, else every account."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import month_range, ordered_months
from tallyspark.operators.joins import top_per_group


def _of(df: DataFrame, account_id) -> DataFrame:
    return df if account_id is None else df.filter(F.col("account_id") == account_id)


def account_picker(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id", "account_name", "account_type")


def health_rows(health: DataFrame, account_id=None) -> DataFrame:
    return _of(health, account_id)


def monthly_rows(monthly: DataFrame, account_id=None) -> DataFrame:
    return _of(monthly, account_id).orderBy("account_id", "month")


def forecast_rows(forecast: DataFrame, account_id=None) -> DataFrame:
    return _of(forecast, account_id).orderBy("account_id", "forecast_date")


def category_spend_rows(spend: DataFrame, account_id=None) -> DataFrame:
    return _of(spend, account_id).orderBy("account_id", F.desc("month"), "category_name")


def anomaly_rows(flags: DataFrame, ledger: DataFrame, account_id=None) -> DataFrame:
    """Flags with the detail of their transaction, most anomalous first."""
    detail = _of(ledger, account_id).select("transaction_id", "account_id", "txn_date", "amount", "category_name")
    return (
        flags.select("transaction_id", "anomaly_score", "reason").join(detail, "transaction_id")
        .orderBy("account_id", F.desc("anomaly_score"), "transaction_id")
    )


def transaction_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("n"))


def budget_rows(budget_vs_actual: DataFrame, account_id=None) -> DataFrame:
    return _of(budget_vs_actual, account_id).orderBy("account_id", F.desc("month"), "category_name")


def recurring_rows(recurring: DataFrame, account_id=None) -> DataFrame:
    return _of(recurring, account_id).orderBy("account_id", F.desc("last_txn_date"), "merchant_name")


def category_drilldown(ledger: DataFrame, category_name: str, start_month=None, end_month=None,
                       account_id=None) -> DataFrame:
    """Debits of one category in a range of months, newest first."""
    wanted = (
        (F.col("category_name") == category_name)
        & (F.col("txn_type") == "debit")
        & month_range(start_month, end_month)
    )
    if "txn_month" in ledger.columns:
        # The stored ledger's folders are months; those outside the range are not even listed.
        start_month, end_month = ordered_months(start_month, end_month)
        if start_month is not None:
            wanted = wanted & (F.col("txn_month") >= start_month)
        if end_month is not None:
            wanted = wanted & (F.col("txn_month") <= end_month)
    return (
        _of(ledger, account_id).filter(wanted)
        .select("account_id", "transaction_id", "txn_date", "merchant_name", "amount", "is_recurring")
        .orderBy("account_id", F.desc("txn_date"), "transaction_id")
    )


def category_names(categories: DataFrame) -> DataFrame:
    return categories.select("category_id", "category_name").orderBy("category_name")


def merchant_names(merchants: DataFrame) -> DataFrame:
    return merchants.select("merchant_id", "merchant_name", "default_category").orderBy("merchant_name")


def newest_per_account(ledger: DataFrame, account_id=None, n: int = 300) -> DataFrame:
    """The newest `n` rows of each account."""
    order = [F.desc("txn_date"), F.desc("transaction_id")]
    return top_per_group(_of(ledger, account_id), ["account_id"], order, n)


def data_status(ledger: DataFrame) -> DataFrame:
    """Row count, newest transaction and, where rows are stamped, time of the last load.

    On the stored ledger the count reads file footers only, and the newest transaction is looked for in the last month's
    folder, which its list of folders tells.
    """
    if "txn_month" in ledger.columns and "loaded_at" not in ledger.columns:
        last_month = ledger.agg(F.max("txn_month")).scalar()
        newest = ledger.filter(F.col("txn_month") == last_month).agg(F.max("txn_date")).scalar()
        return ledger.agg(F.count("*").alias("n")).select("n", newest.alias("last_txn_date"))
    aggregates = [F.count("*").alias("n"), F.max("txn_date").alias("last_txn_date")]
    if "loaded_at" in ledger.columns:
        aggregates.append(F.max("loaded_at").alias("last_loaded_at"))
    return ledger.agg(*aggregates)


def visible_accounts(accounts: DataFrame, access: DataFrame, username: str) -> DataFrame:
    """The accounts a user may see: those named in `access`, or all with `*`; none for unknown users."""
    mine = access.filter(F.col("username") == username)
    everything = mine.filter(F.col("account_name") == "*").select(F.lit(True).alias("all"))
    named = mine.select("account_name")
    # One row or none; a scalar of an empty table is NULL.
    unrestricted = F.coalesce(everything.agg(F.max("all")).scalar(), F.lit(False))
    listed = accounts.join(named.withColumn("_listed", F.lit(True)).distinct(), "account_name", "left")
    return listed.filter(F.coalesce("_listed", unrestricted)).select(*accounts.columns)
