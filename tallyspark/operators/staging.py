"""Typing and cleaning of raw text tables, and resolution of their keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import clean_text
from tallyspark.operators.joins import join_dimension
from tallyspark.schemas import MONEY


def stage_accounts(raw: DataFrame) -> DataFrame:
    """Typed accounts; blank currency becomes USD."""
    return raw.select(
        F.col("account_ref").try_cast("bigint").alias("account_id"),
        F.trim("account_name").alias("account_name"),
        F.trim("account_type").alias("account_type"),
        F.trim("owner_name").alias("owner_name"),
        F.coalesce(clean_text("currency"), F.lit("USD")).alias("currency"),
        F.col("opening_balance").try_cast(MONEY).alias("opening_balance"),
    )


def stage_categories(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.md5(F.trim("category_name")).alias("category_id"),
        F.trim("category_name").alias("category_name"),
        F.trim("category_group").alias("category_group"),
    )


def stage_merchants(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.md5(F.trim("merchant_name")).alias("merchant_id"),
        F.trim("merchant_name").alias("merchant_name"),
        F.trim("default_category").alias("default_category"),
    )


def stage_transactions(raw: DataFrame) -> DataFrame:
    """The lenient cleaner: drops rows without a plain amount, a known type or a date.

    Text such as `1.2.3` passes the character test but is no number; it is
    dropped rather than failing the job. `staging_report` counts what goes.
    """
    typed = raw.filter(raw_fault().isNull()).select(
        F.col("source_txn_id").alias("transaction_id"),
        F.col("account_ref").try_cast("bigint").alias("account_id"),
        F.col("txn_date").try_cast("date").alias("txn_date"),
        F.trim("merchant_name").alias("merchant_name"),
        F.trim("category_name").alias("category_name"),
        F.col("amount").try_cast(MONEY).alias("amount"),
        F.lower(F.trim("txn_type")).alias("txn_type"),
        "description",
        (F.col("is_recurring") == "1").alias("is_recurring"),
    )
    return typed


def raw_fault():
    """Why the lenient cleaner drops a raw row; NULL for rows that stay."""
    plain = F.coalesce(F.col("amount").rlike("^[0-9.]+$"), F.lit(False))
    return (
        F.when(~plain | F.col("amount").try_cast("double").isNull(), "amount")
        .when(F.col("amount").try_cast(MONEY).isNull(), "amount_too_large")
        .when(~F.coalesce(F.lower(F.trim("txn_type")).isin("credit", "debit"), F.lit(False)), "txn_type")
        .when(F.col("txn_date").try_cast("date").isNull(), "txn_date")
    )


def staging_report(raw: DataFrame) -> DataFrame:
    """Raw transactions by what the lenient cleaner does with them."""
    return raw.groupBy(F.coalesce(raw_fault(), F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def stage_budgets(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("account_ref").try_cast("bigint").alias("account_id"),
        F.trim("category_name").alias("category_name"),
        "month",
        F.col("budgeted_amount").try_cast(MONEY).alias("budgeted_amount"),
    )


def load_accounts(raw: DataFrame) -> DataFrame:
    """Accounts as loaded: the row's reference is the id, the balance is money."""
    return raw.select(
        F.col("account_ref").try_cast("bigint").alias("account_id"),
        "account_name", "account_type", "owner_name", "currency",
        F.col("opening_balance").try_cast(MONEY).alias("opening_balance"),
    )


def load_categories(raw: DataFrame) -> DataFrame:
    """Category name to id."""
    return stage_categories(raw).select("category_name", "category_id", "category_group")


def load_merchants(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Merchants with the id of their default category, NULL when it is unknown; a category listed twice counts once."""
    ids = categories.select(
        F.col("category_name").alias("default_category"), F.col("category_id").alias("default_category_id")
    )
    return (
        join_dimension(stage_merchants(raw), ids, "default_category")
        .select("merchant_id", "merchant_name", "default_category_id")
    )


class UnknownAccountError(ValueError):
    """A budget feed names an account that does not exist."""


def load_budgets(raw: DataFrame, categories: DataFrame, accounts: DataFrame | None = None,
                 existing: DataFrame | None = None) -> DataFrame:
    """Budgets with known categories; the last load of an (account, category, month) wins.

    `load_seq`, of any type that sorts, orders the rows of the feed. Rows of `existing` budgets lose to
    any row of the feed. With `accounts` given, a reference to a missing account
    aborts the load.
    """
    typed = _typed_budgets(raw)
    known = join_dimension(typed, categories.select("category_name", "category_id"), "category_name", "inner")
    if accounts is not None:
        orphans = typed.select("account_id").distinct().join(accounts.select("account_id"), "account_id", "left_anti")
        first = orphans.limit(1).collect()
        if first:
            raise UnknownAccountError(f"budget for unknown account: {first[0].account_id}")
    if existing is not None:
        earlier = existing.join(categories.select("category_name", "category_id"), "category_name", "inner")
        known = known.unionByName(
            earlier.select("category_name", "category_id", "account_id", "month", "budgeted_amount")
            .withColumn("load_seq", F.lit(None).cast(raw.schema["load_seq"].dataType))
        )
    # max_by skips nothing and combines before the shuffle; rows without a sequence come first.
    order = F.struct(F.col("load_seq").isNotNull(), F.col("load_seq"), F.col("budgeted_amount"))
    return known.groupBy("account_id", "category_id", "category_name", "month").agg(
        F.max_by("budgeted_amount", order).alias("budgeted_amount")
    )


def _typed_budgets(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("account_ref").try_cast("bigint").alias("account_id"),
        F.trim("category_name").alias("category_name"),
        "month",
        F.col("budgeted_amount").try_cast(MONEY).alias("budgeted_amount"),
        "load_seq",
    )


def suggest_category(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """Adds the merchant's default category as a suggestion and uses it where none is set."""
    defaults = merchants.select("merchant_name", F.col("default_category").alias("suggested_category"))
    return join_dimension(transactions, defaults, "merchant_name").withColumn(
        "effective_category", F.coalesce(clean_text("category_name"), "suggested_category")
    )
