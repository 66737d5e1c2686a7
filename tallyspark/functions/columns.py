"""Column expressions shared by the operators. All of them stay in codegen."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(amount="amount", txn_type="txn_type") -> Column:
    """Amounts are stored positive; anything that is not a credit counts as negative."""
    return F.when(F.col(txn_type) == "credit", F.col(amount)).otherwise(-F.col(amount))


def amount_if(txn_type: str, amount="amount") -> Column:
    return F.when(F.col("txn_type") == txn_type, F.col(amount)).otherwise(F.lit(0).cast("decimal(12,2)"))


def month_start(date="txn_date") -> Column:
    """First day of the month: the cheap form to group by."""
    return F.trunc(F.col(date), "MM")


def month_text(date) -> Column:
    """`yyyy-MM`, for results; formatting every input row would cost more than the aggregate."""
    return F.date_format(F.col(date), "yyyy-MM")


def month_range(start_month: str | None, end_month: str | None, date="txn_date") -> Column:
    """`start_month <= month(date) <= end_month` as a plain date range.

    Comparing the date itself, not its month text, lets Parquet skip row groups.
    Ends given in reverse order are swapped; a missing end leaves that side open.
    """
    start_month, end_month = ordered_months(start_month, end_month)
    condition = F.lit(True)
    if start_month is not None:
        condition = condition & (F.col(date) >= F.to_date(F.lit(f"{start_month}-01")))
    if end_month is not None:
        condition = condition & (F.col(date) < F.add_months(F.to_date(F.lit(f"{end_month}-01")), 1))
    return condition


def ordered_months(start_month: str | None, end_month: str | None):
    if start_month is not None and end_month is not None and start_month > end_month:
        return end_month, start_month
    return start_month, end_month


def clean_text(name) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(_col(name)), F.lit(""))


def slug(name) -> Column:
    """Lower-case file-name fragment: runs of other characters become one underscore."""
    return F.trim(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def cents(amount) -> Column:
    """A decimal(…,2) amount as a whole number of cents."""
    return (_col(amount) * 100).cast("bigint")


def cents_mean(sum_cents, count) -> Column:
    """Mean in money, rounded half up at the cent with whole numbers only.

    Rounding a binary or a six-digit quotient a second time can move an exact
    half cent; this cannot.
    """
    total, n = _col(sum_cents), _col(count)
    rounded = F.call_function("div", 2 * total + n, 2 * n)
    return (rounded.cast("decimal(20,0)") / 100).cast("decimal(12,2)")


def _col(name) -> Column:
    return F.col(name) if isinstance(name, str) else name
