"""Reports as SQL table functions with bound parameters."""

import datetime as dt
import re
from decimal import Decimal

import pytest

from tallyspark.operators import serving
from tallyspark.plans import sql_functions
from tallyspark.sources import files

LEDGER = ("transaction_id string, account_id long, txn_date date, merchant_name string, category_name string, "
          "amount decimal(12,2), txn_type string, description string, is_recurring boolean")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sql") / "ledger")
    rows = [(str(i), i % 4, dt.date(2026, 1, 1) + dt.timedelta(days=i % 120), "m", ("Food", "Fun")[i % 2],
             Decimal(i), "debit" if i % 5 else "credit", "d", False) for i in range(600)]
    files.write_ledger(spark.createDataFrame(rows, LEDGER), path)
    ledger = files.read_ledger(spark, path)
    made = sql_functions.register(spark, {"fct_transactions": ledger}, prefix="t_")
    assert made == ["t_category_drilldown", "t_newest_transactions"]
    return ledger


def drilled(spark, **args):
    args = {"category": "Food", "start": None, "end": None, "account": None} | args
    return spark.sql("SELECT * FROM t_category_drilldown(:category, :start, :end, :account)", args=args)


@pytest.mark.parametrize("start, end, account", [
    (None, None, None), ("2026-02", "2026-03", None), ("2026-03", "2026-02", 2), ("2026-03", None, None), (None, "2026-01", 0)])
def test_drill_down_equals_the_report(spark, stored, start, end, account):
    got = drilled(spark, start=start, end=end, account=account)
    want = serving.category_drilldown(stored, "Food", start, end, account)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_bound_values_reach_the_scan(spark, stored, capsys):
    drilled(spark, start="2026-02", end="2026-03", account=2).explain("formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", capsys.readouterr().out)[1]
    assert "EqualTo(category_name,Food)" in pushed and "EqualTo(account_id,2)" in pushed
    assert "GreaterThanOrEqual(txn_date,2026-02-01)" in pushed and "LessThan(txn_date,2026-04-01)" in pushed


def test_values_are_never_text_of_the_query(spark, stored):
    assert drilled(spark, category="Food' OR '1'='1").count() == 0


def test_newest_transactions_are_300_an_account(spark, stored):
    got = spark.sql("SELECT * FROM t_newest_transactions(:account) WHERE place <= 3 ORDER BY place", args={"account": 1}).collect()
    want = serving.newest_per_account(stored, 1, 3).collect()
    assert {r.transaction_id for r in got} == {r.transaction_id for r in want} and [r.place for r in got] == [1, 2, 3]


def test_users_see_their_accounts(spark):
    accounts = spark.createDataFrame([(1, "A", "personal"), (2, "B", "personal")],
                                     "account_id long, account_name string, account_type string")
    access = spark.createDataFrame([("ann", "A"), ("ann", "A"), ("root", "*")], "username string, account_name string")
    sql_functions.register(spark, {"accounts": accounts, "access": access}, prefix="u_")

    def seen(user):
        rows = spark.sql("SELECT * FROM u_accounts_visible_to(:user)", args={"user": user}).collect()
        return sorted(r.account_id for r in rows)

    assert (seen("ann"), seen("root"), seen("nobody")) == ([1], [1, 2], [])


def test_status_of_the_stored_ledger_reads_little(spark, stored):
    status = serving.data_status(stored)
    assert tuple(status.first()) == (600, dt.date(2026, 4, 30))
    plan = status._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) <= {"struct<>", "struct<txn_date:date>"}
    read = [p for p in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters.*?ReadSchema: struct<txn_date", plan)]
    assert all("txn_month" in p for p in read)
