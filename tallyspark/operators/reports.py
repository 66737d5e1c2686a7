"""Report frames: figures and statuses derived from the marts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.columns import ordered_months
from tallyspark.operators.analytics import runway_days

RUNWAY_BUFFER_DAYS = 60
CHANGE_SHARE = 0.05
MAX_RECOMMENDATIONS = 3


def kpis(accounts: DataFrame, health: DataFrame, monthly: DataFrame) -> DataFrame:
    """Balance, burn, runway and the last month's net flow per account; 0 where there is none."""
    zero = F.lit(0).cast("decimal(12,2)")
    last = monthly.groupBy("account_id").agg(F.max_by("net_flow", "month").alias("last_month_net"))
    return (
        accounts.select("account_id")
        .join(health.select("account_id", "current_balance", "avg_daily_burn"), "account_id", "left")
        .join(last, "account_id", "left")
        .select(
            "account_id",
            F.coalesce("current_balance", zero).alias("current_balance"),
            F.coalesce("avg_daily_burn", zero).alias("avg_daily_burn"),
            runway_days().alias("runway_days"),
            F.coalesce("last_month_net", zero).alias("last_month_net"),
        )
    )


# The words of statuses, marks and recommendations below.
def runway_status(kpi: DataFrame) -> DataFrame:
    """Words for the figures. A runway below the buffer, negative ones included, warns."""
    short = F.coalesce(F.col("runway_days") < RUNWAY_BUFFER_DAYS, F.lit(False))
    return kpi.select(
        "account_id",
        F.when(F.col("runway_days").isNull(), "no burn detected")
        .when(short, "below 60-day buffer").otherwise("healthy buffer").alias("runway_status"),
        F.when(F.col("last_month_net") >= 0, "inflow").otherwise("outflow").alias("net_flow_status"),
        short.alias("warn"),
    )


def net_flow_marks(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "account_id", "month", "net_flow",
        F.when(F.col("net_flow") < 0, "critical").otherwise("good").alias("mark"),
    )


def in_months(df: DataFrame, start_month: str | None = None, end_month: str | None = None) -> DataFrame:
    """Rows of a monthly mart within a range of months.

    Without arguments every account keeps its latest month. Reversed ends are
    swapped; one end alone leaves the other side open.
    """
    start_month, end_month = ordered_months(start_month, end_month)
    if start_month is None and end_month is None:
        latest = F.max("month").over(Window.partitionBy("account_id"))
        return df.withColumn("_latest", latest).filter(F.col("month") == F.col("_latest")).drop("_latest")
    if start_month is not None:
        df = df.filter(F.col("month") >= start_month)
    if end_month is not None:
        df = df.filter(F.col("month") <= end_month)
    return df


def category_rollup(spend: DataFrame, start_month=None, end_month=None) -> DataFrame:
    """Spend per account and category over the range, ranked, with the bar's label."""
    totals = (
        in_months(spend, start_month, end_month)
        .groupBy("account_id", "category_name").agg(F.sum("total_amount").alias("total_amount"))
    )
    by_account = Window.partitionBy("account_id")
    order = by_account.orderBy(F.desc("total_amount"), "category_name")
    return totals.select(
        "account_id", "category_name", "total_amount",
        F.row_number().over(order).alias("position"),
        F.max("total_amount").over(by_account).alias("max_spend"),
        F.concat(F.lit("$"), F.format_number(F.col("total_amount").cast("decimal(20,0)"), 0)).alias("label"),
    )


def budget_rollup(bva: DataFrame, start_month=None, end_month=None) -> DataFrame:
    totals = (
        in_months(bva, start_month, end_month)
        .groupBy("account_id", "category_name")
        .agg(F.sum("budgeted_amount").alias("budgeted_amount"), F.sum("actual_amount").alias("actual_amount"))
    )
    over = F.col("actual_amount") > F.col("budgeted_amount")
    return totals.withColumn("status", F.when(over, "over").otherwise("within"))


def over_budget_names(rollup: DataFrame) -> DataFrame:
    """Over-budget categories of each account in one line, smallest budget first."""
    return (
        rollup.filter(F.col("status") == "over")
        .groupBy("account_id")
        .agg(F.expr("listagg(category_name, ', ') within group (order by budgeted_amount, category_name)")
             .alias("over_budget"))
    )


def recurring_changes(recurring: DataFrame) -> DataFrame:
    """Marks merchants whose last charge is more than 5 % off the typical one.

    Compared as 20 * |last - typical| > typical, which needs no division.
    """
    typical, last = F.col("typical_amount"), F.col("last_amount")
    changed = (typical > 0) & (F.abs(last - typical) * int(round(1 / CHANGE_SHARE)) > typical)
    return recurring.withColumn("amount_changed", changed)


def changed_merchants(changes: DataFrame) -> DataFrame:
    return (
        changes.filter("amount_changed")
        .groupBy("account_id")
        .agg(F.expr("listagg(merchant_name, ', ') within group (order by last_txn_date desc, merchant_name)")
             .alias("changed_merchants"))
    )


def recommendations(spend: DataFrame, bva: DataFrame, health: DataFrame, forecast: DataFrame,
                    cut_pct: int = 15) -> DataFrame:
    """Up to three savings proposals per account, over-budget categories first.

    1. Categories over budget in the account's latest month: save the overage.
    2. Other discretionary or variable categories of that month: save
       `cut_pct` percent of the spend.
    Each comes with the new runway (only for a positive balance and burn) and
    the new balance at the end of the forecast.
    """
    if cut_pct not in range(5, 31, 5):
        raise ValueError("cut_pct must be 5, 10, … 30")
    latest = in_months(spend)
    latest_month = latest.select("account_id", "month").distinct()
    over = (
        bva.join(latest_month, ["account_id", "month"])
        .filter(F.col("actual_amount") > F.col("budgeted_amount"))
        .select(
            "account_id", "category_name", F.lit(1).alias("kind_rank"),
            F.lit("Get back to budget").alias("action"),
            (F.col("actual_amount") - F.col("budgeted_amount")).cast("decimal(24,4)").alias("monthly_savings"),
            F.col("actual_amount").alias("spent"), F.col("budgeted_amount").alias("budget"),
        )
    )
    cut = (
        latest.filter(F.col("category_group").isin("discretionary", "variable_expense"))
        .join(over.select("account_id", "category_name"), ["account_id", "category_name"], "left_anti")
        .select(
            "account_id", "category_name", F.lit(2).alias("kind_rank"),
            F.lit(f"Hypothetical: cut it by {cut_pct}%").alias("action"),
            (F.col("total_amount") * F.lit(cut_pct) / F.lit(100)).cast("decimal(24,4)").alias("monthly_savings"),
            F.col("total_amount").alias("spent"), F.lit(None).cast("decimal(12,2)").alias("budget"),
        )
        .filter(F.col("monthly_savings") > 0)
    )
    order = Window.partitionBy("account_id").orderBy("kind_rank", F.desc("monthly_savings"), "category_name")
    picked = (
        over.unionByName(cut).withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= MAX_RECOMMENDATIONS)
    )
    end_balance = forecast.groupBy("account_id").agg(
        F.max_by("predicted_balance", "forecast_date").alias("old_forecast_balance"))
    joined = (
        picked.join(health.select("account_id", "current_balance", "avg_daily_burn"), "account_id", "left")
        .join(end_balance, "account_id", "left")
    )
    return _consequences(joined)


def _consequences(picked: DataFrame) -> DataFrame:
    balance = F.coalesce(F.col("current_balance").cast("double"), F.lit(0.0))
    burn = F.coalesce(F.col("avg_daily_burn").cast("double"), F.lit(0.0))
    savings = F.col("monthly_savings").cast("double")
    meaningful = (burn > 0) & (balance > 0)
    new_burn = F.greatest(burn - savings / 30, F.lit(0.0))
    old_runway = F.when(meaningful, balance / F.nullif(burn, F.lit(0.0)))
    new_runway = F.when(meaningful & (new_burn > 0), balance / F.nullif(new_burn, F.lit(0.0)))
    days = F.round(new_runway - old_runway).cast("bigint")
    money = lambda c: F.format_string("$%s", F.format_number(F.col(c).cast("decimal(24,0)"), 0))
    headline = F.when(
        F.col("kind_rank") == 1,
        F.concat("category_name", F.lit(" is "), money("monthly_savings"), F.lit(" over its "), money("budget"),
                 F.lit(" budget this month ("), money("spent"), F.lit(" spent).")),
    ).otherwise(F.concat("category_name", F.lit(" is your top discretionary/variable spend this month at "),
                         money("spent"), F.lit(".")))
    return picked.select(
        "account_id", "position", "category_name", "action",
        savings.alias("monthly_savings"),
        old_runway.alias("old_runway"),
        new_runway.alias("new_runway"),
        F.when(~meaningful, F.when(balance <= 0, "not meaningful with a negative balance")
               .otherwise("no burn detected")).alias("runway_na_reason"),
        F.when(meaningful & new_runway.isNull(), "no longer burning cash")
        .when(meaningful & (days == 0), "no meaningful change")
        .when(meaningful, F.format_string("%+,d days", days)).alias("runway_change"),
        F.col("old_forecast_balance").cast("double").alias("old_forecast_balance"),
        F.round(F.col("old_forecast_balance").cast("double") + savings, 4).alias("new_forecast_balance"),
        headline.alias("headline"),
    )
