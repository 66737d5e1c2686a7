"""Change sets: batches of new, changed and deleted rows applied to the ledger."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.columns import clean_text
from tallyspark.operators.joins import join_dimension
from tallyspark.schemas import MONEY
from tallyspark.session import materialize, scratch
from tallyspark.sources import files


def normalise_rows(rows: DataFrame) -> DataFrame:
    """Amounts positive and in cents, texts trimmed, blanks NULL."""
    return rows.withColumns({
        "amount": F.round(F.abs("amount"), 2).cast(MONEY),
        "merchant_name": clean_text("merchant_name"),
        "description": clean_text("description"),
    })


def append_rows(ledger: DataFrame, new_rows: DataFrame) -> DataFrame:
    return ledger.unionByName(normalise_rows(new_rows).select(*ledger.columns))


def changes_per_id(ledger: DataFrame, updates: DataFrame, deletes: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(transaction_id, _new, _gone): one change per id. `ledger` gives the columns and their types."""
    columns = [c for c in ledger.columns if c != "transaction_id"]
    new = F.struct(*[F.col(c).cast(ledger.schema[c].dataType).alias(c) for c in columns])
    updated = normalise_rows(updates).select(
        "transaction_id", F.struct(F.col(sequence).alias("_at"), new.alias("_row")).alias("_new"), F.lit(False).alias("_gone"))
    gone = deletes.select(
        "transaction_id", F.lit(None).cast(updated.schema["_new"].dataType).alias("_new"), F.lit(True).alias("_gone"))
    return updated.unionByName(gone).groupBy("transaction_id").agg(
        F.max("_new").alias("_new"), F.max("_gone").alias("_gone"))


def _changed(ledger: DataFrame, per_id: DataFrame) -> DataFrame:
    columns = [c for c in ledger.columns if c != "transaction_id"]
    merged = ledger.join(per_id, "transaction_id", "left").filter(~F.coalesce("_gone", F.lit(False)))
    pick = {c: F.when(F.col("_new").isNotNull(), F.col("_new._row")[c]).otherwise(F.col(c)) for c in columns}
    return merged.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in ledger.columns])


def apply_changes(ledger: DataFrame, updates: DataFrame, deletes: DataFrame, sequence: str = "sequence") -> DataFrame:
    """The ledger after updates and deletes by transaction id; a delete wins over an update.

    Of several updates of one id, the one with the highest `sequence`, a column
    of `updates`, is the last and wins. Updates and deletes become one change
    per id, so the ledger is read and joined once. Changes of ids that the
    ledger does not hold have no effect. Write the result to a new path: the
    ledger's own path is an input of this plan.
    """
    return _changed(ledger, changes_per_id(ledger, updates, deletes, sequence))


def change_stored_ledger(spark: SparkSession, path: str, updates: DataFrame, deletes: DataFrame,
                         sequence: str = "sequence") -> list[str]:
    """Apply changes to the ledger stored at `path` and return the months that were written anew.

    The same result as `apply_changes`, at the cost of what is changed: the ids of the ledger are read to find the months
    that hold changed rows, together with the months that changed dates move rows to; only those are read whole, joined
    and replaced, and the files of all others stay. A month is put into place at once; a failure puts the old ones back.
    A change set is matched with the ids by the planner's choice of join, so a small one is broadcast.
    """
    ledger = files.read_ledger(spark, path)
    rows = ledger.drop(*files.LEDGER_PARTITION)
    with scratch(spark):
        per_id = materialize(changes_per_id(rows, updates, deletes, sequence), "changes")
        month, = files.LEDGER_PARTITION
        found = ledger.select("transaction_id", month).join(per_id, "transaction_id")
        target = F.when(~F.col("_gone"), F.date_format("_new._row.txn_date", "yyyy-MM"))
        # A list of months is as short as the ledger's list of folders.
        months = [r.m for r in found.select(F.explode(F.array(month, target)).alias("m")).filter(
            "m IS NOT NULL").distinct().orderBy("m").collect()]
        if months:
            touched = _changed(ledger.filter(F.col(month).isin(months)).drop(month), per_id)
            files.replace_partitions(files.ledger_layout(touched), path, month, months)
    return months


def add_merchants(merchants: DataFrame, rows: DataFrame) -> DataFrame:
    """Merchants first seen in `rows`, with the category used there as their default.

    When a new merchant appears in several rows the one with the lowest
    transaction id decides. Known merchants keep their default.
    """
    seen = rows.select(
        clean_text("merchant_name").alias("merchant_name"), "category_name", "transaction_id"
    ).filter(F.col("merchant_name").isNotNull())
    first = seen.groupBy("merchant_name").agg(F.min_by("category_name", "transaction_id").alias("default_category"))
    new = first.join(merchants.select("merchant_name"), "merchant_name", "left_anti").select(
        F.md5("merchant_name").alias("merchant_id"), "merchant_name", "default_category")
    return merchants.unionByName(new)


def apply_category_rules(merchants: DataFrame, rules: DataFrame) -> DataFrame:
    """New default categories by merchant name. Past transactions stay as they are."""
    new = rules.select("merchant_name", F.col("default_category").alias("_new"))
    return join_dimension(merchants, new, "merchant_name").withColumn(
        "default_category", F.coalesce("_new", "default_category")).drop("_new")
