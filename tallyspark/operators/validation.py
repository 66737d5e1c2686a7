"""The strict loader: one ordered set of rules, a reason for every rejected row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import clean_text
from tallyspark.operators.joins import join_dimension
from tallyspark.schemas import MONEY, TXN_TYPES

# Order of the rules; the first that fails names the row's reason.
RULES = (
    "malformed_row",
    "account_ref",
    "category",
    "amount_numeric",
    "amount_positive",
    "amount_too_large",
    "txn_type",
    "txn_date",
    "is_recurring",
)


def check_transactions(raw: DataFrame, accounts: DataFrame, categories: DataFrame, merchants: DataFrame,
                       on_unknown_category: str = "reject") -> DataFrame:
    """Every raw row with its typed columns, `reason_code` and `reason`; both NULL when accepted.

    An unknown merchant is no fault: its id and name stay NULL. With
    `on_unknown_category="keep"` a row of an unknown category is accepted too.
    A row that the reader marked in `_corrupt_record` is malformed, whatever
    its fields hold. Amounts beyond the money type are numbers, but too large.
    """
    corrupt = F.col("_corrupt_record") if "_corrupt_record" in raw.columns else F.lit(None).cast("string")
    typed = raw.select(
        corrupt.alias("_corrupt"),
        F.col("source_txn_id").alias("transaction_id"),
        F.col("account_ref").try_cast("bigint").alias("_ref"),
        "account_ref",
        F.trim("category_name").alias("_category"),
        "category_name",
        F.trim("merchant_name").alias("_merchant"),
        F.col("amount").alias("raw_amount"),
        # Wide enough to see the sign before the amount is rounded to cents.
        F.col("amount").try_cast("decimal(38,10)").alias("_amount"),
        F.col("amount").try_cast("double").alias("_size"),
        F.lower(F.trim("txn_type")).alias("txn_type"),
        F.col("txn_type").alias("raw_txn_type"),
        F.col("txn_date").alias("raw_txn_date"),
        F.col("txn_date").try_cast("date").alias("txn_date"),
        F.coalesce("is_recurring", F.lit("0")).try_cast("int").alias("_recurring"),
        F.col("is_recurring").alias("raw_is_recurring"),
        "description",
    )
    known_accounts = accounts.select(F.col("account_id").alias("_ref"), F.col("account_id"))
    # One row per name, so that a name listed twice cannot double a transaction.
    known_categories = categories.select(F.col("category_name").alias("_category"), "category_id")
    known_merchants = merchants.select(
        F.col("merchant_name").alias("_merchant"), "merchant_id", "merchant_name"
    )
    looked_up = join_dimension(typed, known_accounts, "_ref")
    looked_up = join_dimension(looked_up, known_categories, "_category")
    looked_up = join_dimension(looked_up, known_merchants, "_merchant")

    amount = F.col("_amount").try_cast(MONEY)
    finite = F.coalesce(F.abs("_size") < float("inf"), F.lit(False)) & ~F.isnan("_size")
    positive = F.coalesce(F.col("_amount") > 0, F.col("_size") > 0)
    unknown_category = F.col("category_id").isNull() & F.lit(on_unknown_category == "reject")
    faults = [
        ("malformed_row", F.col("_corrupt").isNotNull(), F.format_string("malformed row: %s", "_corrupt")),
        ("account_ref", F.col("account_id").isNull(), F.format_string("unknown account_ref: %s", "account_ref")),
        ("category", unknown_category, F.format_string("unknown category: %s", "category_name")),
        ("amount_numeric", F.col("_amount").isNull() & ~finite,
         F.format_string("amount is not a number: %s", "raw_amount")),
        ("amount_positive", ~positive, F.format_string("non-positive amount: %s", "raw_amount")),
        ("amount_too_large", amount.isNull(), F.format_string("amount too large: %s", "raw_amount")),
        ("txn_type", ~F.coalesce(F.col("txn_type").isin(*TXN_TYPES), F.lit(False)),
         F.format_string("bad txn_type: %s", "raw_txn_type")),
        ("txn_date", F.col("txn_date").isNull(),
         F.when(clean_text("raw_txn_date").isNull(), "missing txn_date")
         .otherwise(F.format_string("bad txn_date: %s", "raw_txn_date"))),
        ("is_recurring", F.col("_recurring").isNull(), F.format_string("bad is_recurring: %s", "raw_is_recurring")),
    ]
    code = text = F.lit(None).cast("string")
    for name, failed, message in reversed(faults):
        code = F.when(failed, name).otherwise(code)
        text = F.when(failed, message).otherwise(text)
    return looked_up.select(
        "transaction_id", "account_id", "txn_date", "merchant_id", "merchant_name",
        F.col("_category").alias("category_name"), amount.alias("amount"), "txn_type", "description",
        (F.col("_recurring") != 0).alias("is_recurring"),
        code.alias("reason_code"), text.alias("reason"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason_code").isNull()).drop("reason_code", "reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason_code").isNotNull()).select("transaction_id", "reason_code", "reason")


def rejected_by(checked: DataFrame, rule: str) -> DataFrame:
    """The rows a single rule turned away."""
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    return rejected(checked).filter(F.col("reason_code") == rule)


def validation_report(checked: DataFrame) -> DataFrame:
    """Row counts by outcome, with the alphabetically first reason text as an example."""
    return checked.groupBy(F.coalesce("reason_code", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n"), F.min("reason").alias("example")
    )


def reject_sample(checked: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` rejected rows by transaction id, with their reasons."""
    return rejected(checked).orderBy("transaction_id", "reason").limit(n)
