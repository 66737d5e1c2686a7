"""The reports as SQL table functions, for callers that bind parameters.

    register(spark, tables)
    spark.sql("SELECT * FROM category_drilldown(:category, :start, :end, :account) ORDER BY txn_date DESC",
              args={"category": "Groceries", "start": "2026-01", "end": None, "account": 7})

A function is a query over temporary views of the marts. The optimizer puts it in the place of its call, so that bound
values become filters of the scans. A NULL account stands for every account, a NULL month for an open end; months in
reverse order are swapped. Order is the caller's matter.
"""

from pyspark.sql import DataFrame, SparkSession

_OF_ACCOUNT = "account BIGINT DEFAULT NULL"
_ONE_ACCOUNT = "(account IS NULL OR t.account_id = account)"


def _plain(view: str) -> tuple[str, tuple[str, ...], str]:
    return _OF_ACCOUNT, (view,), f"SELECT t.* FROM {{{view}}} t WHERE {_ONE_ACCOUNT}"


#: Parameters, the views that are read, and the query, by name. No parameter has the name of a column.
FUNCTIONS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "health_of": _plain("account_health"),
    "monthly_cashflow_of": _plain("monthly_cashflow"),
    "category_spend_of": _plain("category_spend_monthly"),
    "budget_vs_actual_of": _plain("budget_vs_actual"),
    "recurring_of": _plain("recurring_transactions"),
    "forecast_of": _plain("cashflow_forecast"),
    "anomalies_of": (
        _OF_ACCOUNT, ("anomaly_flags", "fct_transactions"),
        "SELECT f.transaction_id, f.anomaly_score, f.reason, t.account_id, t.txn_date, t.amount, t.category_name "
        f"FROM {{anomaly_flags}} f JOIN {{fct_transactions}} t ON t.transaction_id = f.transaction_id WHERE {_ONE_ACCOUNT}"),
    "category_drilldown": (
        "category STRING, start_month STRING DEFAULT NULL, end_month STRING DEFAULT NULL, " + _OF_ACCOUNT,
        ("fct_transactions",),
        "SELECT t.account_id, t.transaction_id, t.txn_date, t.merchant_name, t.amount, t.is_recurring "
        "FROM {fct_transactions} t WHERE t.category_name = category AND t.txn_type = 'debit' "
        "AND (start_month IS NULL OR t.txn_date >= to_date(concat(CASE WHEN start_month > end_month THEN end_month ELSE start_month END, '-01'))) "
        "AND (end_month IS NULL OR t.txn_date < add_months("
        "to_date(concat(CASE WHEN start_month > end_month THEN start_month ELSE end_month END, '-01')), 1)) "
        f"AND {_ONE_ACCOUNT}"),
    "newest_transactions": (
        _OF_ACCOUNT, ("fct_transactions",),
        "SELECT * FROM (SELECT t.transaction_id, t.account_id, t.txn_date, t.merchant_name, t.category_name, t.amount, "
        "t.txn_type, t.description, t.is_recurring, row_number() OVER (PARTITION BY t.account_id "
        "ORDER BY t.txn_date DESC, t.transaction_id DESC) AS place FROM {fct_transactions} t "
        f"WHERE {_ONE_ACCOUNT}) WHERE place <= 300"),
    "accounts_visible_to": (
        "reader STRING", ("accounts", "access"),
        # A name and "*" are both keys of an account, so the join stays one by equality.
        "SELECT DISTINCT t.account_id, t.account_name, t.account_type FROM (SELECT account_id, account_name, account_type, "
        "explode(array(account_name, '*')) AS seen_by FROM {accounts}) t JOIN {access} a ON a.account_name = t.seen_by "
        "WHERE a.username = reader"),
}


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Create a view for every table and each function whose tables are there; returns the functions' names.

    Views and functions belong to the session and are replaced by the next call. `prefix` keeps those of several ledgers
    apart.
    """
    views = {name: f"{prefix}v_{name}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(views[name])
    made = []
    for name, (parameters, needed, query) in FUNCTIONS.items():
        if all(n in tables for n in needed):
            body = query.format(**views)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE RETURN {body}")
            made.append(prefix + name)
    return made
