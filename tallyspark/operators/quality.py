"""Data tests as DataFrames, and the gate that stops a run when one fails."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schemas import ACCOUNT_TYPES, CATEGORY_GROUPS, TXN_TYPES
from tallyspark.session import materialize, wide


@dataclass(frozen=True)
class Unique:
    """`large` says that the table grows with the ledger; its keys are searched by packed hashes first."""

    table: str
    columns: tuple[str, ...]
    large: bool = False


@dataclass(frozen=True)
class NotNull:
    table: str
    column: str


@dataclass(frozen=True)
class Accepted:
    table: str
    column: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Relationship:
    table: str
    column: str
    parent: str
    parent_column: str


# The declared data tests, eleven on staging, seven on marts.
STAGING_TESTS = (
    Unique("stg_accounts", ("account_id",)), NotNull("stg_accounts", "account_id"),
    Unique("stg_categories", ("category_id",)), NotNull("stg_categories", "category_id"),
    Unique("stg_merchants", ("merchant_id",)), NotNull("stg_merchants", "merchant_id"),
    Unique("stg_transactions", ("transaction_id",), large=True), NotNull("stg_transactions", "transaction_id"),
    NotNull("stg_transactions", "account_id"),
    Relationship("stg_transactions", "account_id", "stg_accounts", "account_id"),
    Accepted("stg_transactions", "txn_type", TXN_TYPES),
)
MART_TESTS = (
    Unique("dim_accounts", ("account_id",)), NotNull("dim_accounts", "account_id"),
    Unique("fct_transactions", ("transaction_id",), large=True), NotNull("fct_transactions", "transaction_id"),
    Relationship("fct_transactions", "account_id", "dim_accounts", "account_id"),
    Unique("account_health", ("account_id",)), NotNull("account_health", "account_id"),
)

# The constraints of the table definitions, as tests over typed tables.
SCHEMA_TESTS = (
    Accepted("accounts", "account_type", ACCOUNT_TYPES),
    Accepted("categories", "category_group", CATEGORY_GROUPS),
    Accepted("transactions", "txn_type", TXN_TYPES),
    Unique("categories", ("category_name",)),
    Unique("merchants", ("merchant_name",)),
    Unique("budgets", ("account_id", "category_name", "month")),
    Relationship("merchants", "default_category", "categories", "category_name"),
    Relationship("transactions", "account_id", "accounts", "account_id"),
    Relationship("transactions", "category_name", "categories", "category_name"),
    Relationship("transactions", "merchant_name", "merchants", "merchant_name"),
    Relationship("budgets", "account_id", "accounts", "account_id"),
    Relationship("budgets", "category_name", "categories", "category_name"),
    NotNull("accounts", "account_name"), NotNull("accounts", "account_type"),
    NotNull("accounts", "owner_name"), NotNull("accounts", "currency"),
    NotNull("accounts", "opening_balance"),
    NotNull("categories", "category_name"), NotNull("categories", "category_group"),
    NotNull("merchants", "merchant_name"),
    NotNull("transactions", "account_id"), NotNull("transactions", "category_name"),
    NotNull("transactions", "txn_date"), NotNull("transactions", "amount"),
    NotNull("transactions", "txn_type"), NotNull("transactions", "is_recurring"),
    NotNull("budgets", "account_id"), NotNull("budgets", "category_name"),
    NotNull("budgets", "month"), NotNull("budgets", "budgeted_amount"),
)


def duplicated(df: DataFrame, columns) -> DataFrame:
    """The values that occur more than once, NULLs aside, and how often."""
    present = df.dropna(subset=list(columns))
    return present.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def duplicated_in_large(df: DataFrame, columns) -> DataFrame:
    """The same for a table of ledger size, whose keys would be shuffled in full.

    A first pass looks for hashes that occur twice; only rows with such a hash are shuffled and counted by their real
    values. Keys that are unique, as they should be, cost PACKED bytes each and nothing in the second pass.
    """
    present = df.dropna(subset=list(columns))
    bits = bucket_bits(df.sparkSession)
    keyed = present.select(*columns, F.shiftrightunsigned(F.xxhash64(*columns), 16 - bits).alias("_hash"))
    suspects = materialize(repeated_hashes(keyed.select("_hash"), bits), "suspects")
    return keyed.join(suspects, "_hash", "left_semi").groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


PACKED = 6
HELD_HASHES = 1 << 22


def bucket_bits(spark: SparkSession) -> int:
    """Four buckets a shuffle partition, which is sized for the table: a bucket's hashes are a few megabytes."""
    return min(15, max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def repeated_hashes(hashes: DataFrame, bits: int) -> DataFrame:
    """The values of a column of hashes (below 2**(48 + bits)) that occur more than once.

    Tasks sort their hashes and hand on their low 48 bits by bucket, the top ones, two of a value at most. A bucket's
    packs are put together and sorted again; equal neighbours are repeated.
    """
    name = hashes.columns[0]

    def pack(batches):
        held, number = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0)))
            number += batch.num_rows
            if number >= HELD_HASHES:
                yield _packed(held)
                held, number = [], 0
        if number:
            yield _packed(held)

    def _packed(held):
        x = np.sort(np.concatenate(held))
        x = x[np.append([True, True], x[2:] != x[:-2])[:len(x)]]
        buckets, first = np.unique(x >> 48, return_index=True)
        low = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED]).reshape(-1)
        ends = np.append(first[1:], len(x))
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets.astype(np.int32)), pa.array([low[PACKED * a:PACKED * b].tobytes() for a, b in zip(first, ends)], pa.binary())],
            names=["bucket", "pack"])

    def repeated(batches):
        bucket, held = None, []
        for batch in batches:
            for number, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != bucket:
                    yield from _found(bucket, held)
                    bucket, held = number, []
                held.append(piece)
        yield from _found(bucket, held)

    def _found(bucket, held):
        if held:
            low = np.zeros((sum(map(len, held)) // PACKED, 8), np.uint8)
            low[:, :PACKED] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, PACKED)
            x = np.sort(low.reshape(-1).view("<u8")).astype(np.int64)
            again = np.unique(x[1:][x[1:] == x[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(again | (bucket << 48))], names=[name])

    packed = hashes.mapInArrow(pack, "bucket int, pack binary")
    dealt = packed.repartition(wide(hashes.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(repeated, f"{name} long")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def outside(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is none of the accepted ones; NULL is for `nulls` to find."""
    return df.filter(~F.col(column).isin(*values))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent and how many rows carry each.

    Children are counted per value before the join, so a value that most rows
    share is one row in it.
    """
    counted = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")
    )
    return counted.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


def run_tests(tables: dict[str, DataFrame], tests) -> DataFrame:
    """One row per test: (test, table_name, column_name, failures), 0 when it passes.

    All row-wise tests of a table share a single scan of it. `failures` counts
    duplicated values for uniqueness and rows for everything else.
    """
    parts = []
    row_tests: dict[str, list] = {}
    large = [t for t in tests if isinstance(t, Unique) and t.large]
    # The searches for repeated hashes are jobs of their own, which run side by side.
    with ThreadPoolExecutor(max(1, len(large))) as pool:
        searches = {t: pool.submit(duplicated_in_large, tables[t.table], t.columns) for t in large}
        repeated = {t: search.result() for t, search in searches.items()}
    for test in tests:
        if isinstance(test, (NotNull, Accepted)):
            row_tests.setdefault(test.table, []).append(test)
        elif isinstance(test, Unique):
            found = repeated[test] if test.large else duplicated(tables[test.table], test.columns)
            bad = found.agg(F.count("*").alias("failures"))
            parts.append(_labelled(bad, "unique", test.table, ",".join(test.columns)))
        else:
            bad = orphans(tables[test.table], test.column, tables[test.parent], test.parent_column)
            total = bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures"))
            parts.append(_labelled(total, "relationships", test.table, test.column))
    for name, group in row_tests.items():
        parts.append(_row_tests(tables[name], name, group))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def _row_tests(df: DataFrame, table: str, tests) -> DataFrame:
    counts, labels = [], []
    for i, test in enumerate(tests):
        column = F.col(test.column)
        if isinstance(test, NotNull):
            kind, failed = "not_null", column.isNull()
        else:
            kind, failed = "accepted_values", ~column.isin(*test.values)
        counts.append(F.count_if(failed).alias(f"c{i}"))
        labels.append((kind, test.column))
    one_row = df.agg(*counts)
    rows = F.array(*[
        F.struct(F.lit(kind).alias("test"), F.lit(table).alias("table_name"),
                 F.lit(column).alias("column_name"), F.col(f"c{i}").cast("bigint").alias("failures"))
        for i, (kind, column) in enumerate(labels)
    ])
    return one_row.select(F.inline(rows))


def _labelled(one_row: DataFrame, test: str, table: str, column: str) -> DataFrame:
    return one_row.select(
        F.lit(test).alias("test"), F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"), F.col("failures").cast("bigint").alias("failures"),
    )


class QualityGateError(RuntimeError):
    """At least one data test failed."""


def assert_gate(report: DataFrame) -> None:
    """Raise when any test failed. The report has one row per test."""
    failed = report.filter("failures > 0").orderBy("table_name", "column_name", "test").collect()
    if failed:
        lines = [f"{r.test} {r.table_name}.{r.column_name}: {r.failures}" for r in failed]
        raise QualityGateError("data tests failed: " + "; ".join(lines))
