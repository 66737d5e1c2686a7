"""The ledger data model derived from the provided star-schema tables.

Accounts come from supplier, categories and merchants from part, transactions
from lineitem; a second ledger comes from events. `raw_*` renders the same rows
as text with faults, so that cleaning and validation run over whole tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schemas import MONEY

# Group of each product-type prefix.
GROUP_OF_TYPE = {
    "LARGE": "variable_expense",
    "STANDARD": "variable_expense",
    "SMALL": "discretionary",
    "MEDIUM": "discretionary",
    "ECONOMY": "fixed_expense",
    "PROMO": "transfer",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("account_id"),
        F.col("s_name").alias("account_name"),
        F.when(F.col("s_suppkey") % 2 == 0, "personal").otherwise("small_business").alias("account_type"),
        F.col("s_name").alias("owner_name"),
        F.lit("USD").alias("currency"),
        F.col("s_acctbal").cast(MONEY).alias("opening_balance"),
    )


def category_group(category="category_name"):
    group = F.lit(None).cast("string")
    for prefix, name in GROUP_OF_TYPE.items():
        group = F.when(F.col(category).startswith(prefix), name).otherwise(group)
    return group


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("category_name")).distinct()
    return names.select(
        F.md5("category_name").alias("category_id"),
        "category_name",
        category_group().alias("category_group"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand with its most frequent product type as default category."""
    pairs = (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("merchant_name"), F.col("p_type").alias("category_name"))
        .agg(F.count("*").alias("n"))
    )
    # Highest count first; the alphabetically first category breaks a tie.
    best = F.min_by("category_name", F.struct(-F.col("n"), F.col("category_name")))
    return pairs.groupBy("merchant_name").agg(best.alias("default_category")).select(
        F.md5("merchant_name").alias("merchant_id"), "merchant_name", "default_category"
    )


def _movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("l_extendedprice").cast(MONEY)
    return table(spark, sf_dir, "lineitem").select(
        # The line's own key columns identify it, so the id needs no shuffle.
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount.cast("string"))
        .alias("transaction_id"),
        F.col("l_suppkey").alias("account_id"),
        F.col("l_shipdate").cast("date").alias("txn_date"),
        amount.alias("amount"),
        F.when(F.col("l_linestatus") == "F", "credit").otherwise("debit").alias("txn_type"),
        (F.col("l_returnflag") == "R").alias("is_recurring"),
        F.col("l_partkey"),
    )


def cash_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions without merchant and category: no join, one scan."""
    return _movements(spark, sf_dir).drop("l_partkey")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full ledger. part may outgrow a broadcast, so the optimizer picks the join."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("merchant_name"),
        F.col("p_type").alias("category_name"),
    )
    return (
        _movements(spark, sf_dir)
        .join(part, "l_partkey", "left")
        .select(
            "transaction_id", "account_id", "txn_date", "merchant_name", "category_name",
            "amount", "txn_type",
            F.concat_ws(" - ", "merchant_name", "category_name").alias("description"),
            "is_recurring",
        )
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, bursty ledger: every event is a debit of its user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").cast("date").alias("txn_date"),
        F.get_json_object("props", "$.k").alias("merchant_name"),
        F.col("event_type").alias("category_name"),
        F.col("value").cast(MONEY).alias("amount"),
        F.lit("debit").alias("txn_type"),
    )


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("account_ref"),
        F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("account_name"),
        F.when(F.col("s_suppkey") % 2 == 0, " personal").otherwise("small_business ").alias("account_type"),
        F.concat("s_name", F.lit("  ")).alias("owner_name"),
        F.when(F.col("s_nationkey") < 5, "  ")
        .when(F.col("s_nationkey") < 10, F.lit(None))
        .when(F.col("s_nationkey") < 15, " EUR ")
        .otherwise("USD").alias("currency"),
        F.col("s_acctbal").cast(MONEY).cast("string").alias("opening_balance"),
    )


def raw_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(spark, sf_dir).select(
        F.concat(F.lit(" "), "category_name", F.lit("  ")).alias("category_name"),
        F.concat("category_group", F.lit(" ")).alias("category_group"),
    )


def raw_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants as text; one brand points at a category that does not exist."""
    return merchants(spark, sf_dir).select(
        F.concat("merchant_name", F.lit(" ")).alias("merchant_name"),
        F.when(F.col("merchant_name") == "Brand#1", "Uncharted")
        .otherwise(F.concat(F.lit(" "), "default_category")).alias("default_category"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a raw text row; discount and line number decide which fault it carries."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand"), F.col("p_type")
    )
    line = table(spark, sf_dir, "lineitem").join(part, "l_partkey", "left")
    amount = F.col("l_extendedprice").cast(MONEY).cast("string")

    def fault(discount, number):
        return (F.col("l_discount") == discount) & (F.col("l_linenumber") == number)

    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount).alias("source_txn_id"),
        F.when(fault(0.1, 1), "x").when(fault(0.1, 2), "-1").when(fault(0.1, 3), "999999999999")
        .when(fault(0.01, 1), "y").otherwise(F.col("l_suppkey").cast("string")).alias("account_ref"),
        F.when(fault(0.0, 3), "").when(fault(0.0, 4), "2026-13-01")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("txn_date"),
        F.when(fault(0.0, 6), "Nameless Kiosk").when(fault(0.01, 5), F.lit(None))
        .otherwise(F.concat("p_brand", F.lit(" "))).alias("merchant_name"),
        F.when(fault(0.1, 4), "Uncharted").otherwise(F.concat(F.lit(" "), "p_type")).alias("category_name"),
        F.when(fault(0.1, 5) | fault(0.01, 1), "abc")
        .when(fault(0.1, 6), F.concat(F.lit("-"), amount))
        .when(fault(0.1, 7), "0")
        .when(fault(0.0, 7), "1e3")
        .when(fault(0.01, 2), F.concat(F.lit(" "), amount, F.lit(" ")))
        .when(fault(0.01, 3), "NaN")
        .when(fault(0.01, 4), "1.2.3")
        .when(fault(0.01, 6), "19.999")
        .otherwise(amount).alias("amount"),
        F.when(fault(0.0, 1), "refund").when(fault(0.0, 2), " Debit ")
        .when(F.col("l_linestatus") == "F", "credit").otherwise("debit").alias("txn_type"),
        F.when(fault(0.01, 7), "   ").otherwise(F.concat_ws(" - ", "p_brand", "p_type")).alias("description"),
        F.when(fault(0.0, 5), "true").when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("is_recurring"),
    )


def raw_budgets(budgets: DataFrame) -> DataFrame:
    """A budget feed as text: a first and a revised load of every budget, plus unknown categories."""
    base = budgets.select(
        F.col("account_id").cast("string").alias("account_ref"),
        F.concat("category_name", F.lit(" ")).alias("category_name"),
        "month",
        "budgeted_amount",
    )
    loads = F.array(
        F.struct(F.lit(1).alias("load_seq"), F.col("category_name"), F.col("budgeted_amount")),
        F.struct(F.lit(2).alias("load_seq"), F.col("category_name"),
                 (F.col("budgeted_amount") + 100).cast(MONEY).alias("budgeted_amount")),
        F.struct(F.lit(3).alias("load_seq"), F.lit("Uncharted").alias("category_name"), F.col("budgeted_amount")),
    )
    return base.select("account_ref", "month", F.inline(loads)).select(
        "account_ref", "category_name", "month",
        F.col("budgeted_amount").cast("string").alias("budgeted_amount"), "load_seq",
    )
