"""The marts: facts and per-account, per-month aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.columns import amount_if, cents, cents_mean, month_start, month_text, signed
from tallyspark.operators.joins import join_dimension
from tallyspark.schemas import BUDGETABLE_GROUPS

TOTAL = "decimal(22,2)"
BURN_WINDOW_DAYS = 30
BUDGET_MONTHS = 6


def fct_transactions(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Transactions with their category's group; an unknown category keeps its row, group NULL."""
    groups = categories.select("category_name", "category_group")
    joined = join_dimension(transactions, groups, "category_name")
    return joined.select(
        "transaction_id", "account_id", "txn_date", "merchant_name", "category_name",
        "category_group", "amount", "txn_type", "description", "is_recurring",
    )


def monthly_cashflow(ledger: DataFrame) -> DataFrame:
    return _monthly(ledger, amount_if("credit"), amount_if("debit"), signed())


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    """The same mart from stored daily totals, without another pass over the ledger."""
    return _monthly(daily, F.col("income"), F.col("expense"), F.col("net_flow"))


def _monthly(rows, income, expense, net):
    totals = rows.groupBy("account_id", month_start().alias("_month")).agg(
        F.sum(income).cast(TOTAL).alias("total_income"),
        F.sum(expense).cast(TOTAL).alias("total_expense"),
        F.sum(net).cast(TOTAL).alias("net_flow"),
    )
    return totals.select(
        "account_id", month_text("_month").alias("month"), "total_income", "total_expense", "net_flow")


def category_spend_monthly(fct: DataFrame) -> DataFrame:
    """Debit spend; an unknown category stays as a group of its own."""
    totals = (
        fct.filter(F.col("txn_type") == "debit")
        .groupBy("account_id", month_start().alias("_month"), "category_name", "category_group")
        .agg(F.sum("amount").alias("total_amount"), F.count("*").alias("txn_count"))
    )
    return totals.select(
        "account_id", month_text("_month").alias("month"), "category_name", "category_group",
        "total_amount", "txn_count")


def daily_movement(ledger: DataFrame) -> DataFrame:
    """Totals per account and day: the grain that bounds every per-account window."""
    return ledger.groupBy("account_id", "txn_date").agg(
        F.sum(amount_if("credit")).alias("income"),
        F.sum(amount_if("debit")).alias("expense"),
        F.sum(signed()).alias("net_flow"),
    )


def account_health(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Current balance and average daily burn.

    The burn sums debits dated no earlier than 30 days before the account's last
    row of any type. Both ends count, so up to 31 days are divided by 30.
    Rows are reduced to one per account and day before any window, so an account
    of any size is a few thousand rows in it.
    """
    return health_from_daily(accounts, daily_movement(ledger))


def health_from_daily(accounts: DataFrame, daily: DataFrame) -> DataFrame:
    """`account_health` from stored daily totals."""
    daily = daily.withColumn("last_date", F.max("txn_date").over(Window.partitionBy("account_id")))
    recent = F.col("txn_date") >= F.date_sub("last_date", BURN_WINDOW_DAYS)
    per_account = daily.groupBy("account_id").agg(
        F.sum("net_flow").alias("net_movement"),
        F.sum(F.when(recent, F.col("expense"))).alias("recent_debit"),
    )
    return accounts.join(per_account, "account_id", "left").select(
        "account_id", "account_name", "account_type",
        (F.col("opening_balance") + F.coalesce("net_movement", F.lit(0).cast("decimal(12,2)")))
        .cast("decimal(22,2)").alias("current_balance"),
        (F.coalesce("recent_debit", F.lit(0).cast("decimal(12,2)")) / F.lit(30).cast("decimal(2,0)"))
        .cast("decimal(22,6)").alias("avg_daily_burn"),
    )


def actual_by_category(spend: DataFrame) -> DataFrame:
    """The spend mart without its groups."""
    return spend.groupBy("account_id", "month", "category_name").agg(F.sum("total_amount").alias("actual_amount"))


def budget_vs_actual(budgets: DataFrame, spend: DataFrame) -> DataFrame:
    """Every budget with the debit spend of its month; spend without a budget does not appear.

    Reads the spend mart, so the ledger is not scanned again.
    """
    return budgets.join(actual_by_category(spend), ["account_id", "month", "category_name"], "left").select(
        "account_id", "month", "category_name", "budgeted_amount",
        F.coalesce("actual_amount", F.lit(0).cast("decimal(12,2)")).cast("decimal(22,2)").alias("actual_amount"),
    )


def recurring_transactions(ledger: DataFrame) -> DataFrame:
    """Recurring debits per account and merchant, with the amount of the latest one.

    The latest row is an aggregate, not a self-join; on equal dates the highest
    transaction id wins.
    """
    latest = F.struct("txn_date", "transaction_id")
    grouped = (
        ledger.filter(F.col("is_recurring") & (F.col("txn_type") == "debit") & F.col("merchant_name").isNotNull())
        .groupBy("account_id", "merchant_name")
        .agg(
            F.count("*").alias("occurrence_count"),
            F.sum(cents("amount")).alias("sum_cents"),
            F.max("txn_date").alias("last_txn_date"),
            F.max_by("amount", latest).alias("last_amount"),
        )
    )
    return grouped.select(
        "account_id", "merchant_name", "occurrence_count",
        cents_mean("sum_cents", "occurrence_count").alias("typical_amount"),
        "last_txn_date", "last_amount",
    )


def budget_baseline(spend: DataFrame, ledger: DataFrame) -> DataFrame:
    """A budget for each account and budgetable category, sized by its own past spend.

    The size is the mean of the spend mart's months, those with activity. Months are those of the
    ledger's last day minus 0, 30, … 150 days, each once, so a month can be
    missing where two of those days share one.
    """
    typical = (
        spend.filter(F.col("category_group").isin(*BUDGETABLE_GROUPS))
        .groupBy("account_id", "category_name")
        .agg(F.sum(cents("total_amount")).alias("sum_cents"), F.count("*").alias("n_months"))
    )
    end = ledger.agg(F.max("txn_date")).scalar()
    months = F.array_distinct(F.array(*[
        F.date_format(F.date_sub(end, 30 * i), "yyyy-MM") for i in range(BUDGET_MONTHS)
    ]))
    return typical.select(
        "account_id", "category_name", F.explode(months).alias("month"),
        cents_mean("sum_cents", "n_months").alias("budgeted_amount"),
    )
