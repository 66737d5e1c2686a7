"""Report rules, marts, quality gate, change sets and access."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import analytics, changes, marts, quality, reports, serving

D = Decimal
LEDGER = ("transaction_id string, account_id long, txn_date date, merchant_name string, category_name string, "
          "category_group string, amount decimal(12,2), txn_type string, description string, is_recurring boolean")


def ledger(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(account_id=1, txn_date="2026-01-01", merchant_name="M", category_name="C",
                    category_group="discretionary", amount="10", txn_type="debit", is_recurring=False)
        base.update(r)
        full.append((r.get("transaction_id", f"t{i:03d}"), base["account_id"], dt.date.fromisoformat(base["txn_date"]),
                     base["merchant_name"], base["category_name"], base["category_group"], D(base["amount"]),
                     base["txn_type"], None, base["is_recurring"]))
    return spark.createDataFrame(full, LEDGER)


def accounts(spark, *opening):
    return spark.createDataFrame(
        [(i + 1, f"Account {i + 1}", "personal", "o", "USD", D(str(o))) for i, o in enumerate(opening)], schemas.ACCOUNTS)


def test_burn_window_counts_both_ends(spark):
    rows = ledger(spark, [
        {"txn_date": "2026-01-01", "amount": "100"}, {"txn_date": "2026-01-02", "amount": "30"},
        {"txn_date": "2026-02-01", "amount": "60", "txn_type": "credit"}])
    health = {r.account_id: r for r in marts.account_health(accounts(spark, 1000, 5), rows).collect()}
    # Last row 2026-02-01: the window starts on 2026-01-02.
    assert health[1].avg_daily_burn == D("1.000000") and health[1].current_balance == D("930.00")
    assert health[2].avg_daily_burn == 0 and health[2].current_balance == D("5.00")


def test_recurring_takes_the_latest_amount_and_rounds_half_up(spark):
    rows = ledger(spark, [
        {"is_recurring": True, "amount": "10.01", "txn_date": "2026-01-01"},
        {"is_recurring": True, "amount": "10.02", "txn_date": "2026-02-01", "transaction_id": "a"},
        {"is_recurring": True, "amount": "10.03", "txn_date": "2026-02-01", "transaction_id": "b"},
        {"is_recurring": True, "amount": "10.00", "txn_date": "2026-01-03"},
        {"is_recurring": True, "merchant_name": None}, {"is_recurring": True, "txn_type": "credit"}])
    row, = marts.recurring_transactions(rows).collect()
    assert (row.occurrence_count, row.last_amount, row.typical_amount) == (4, D("10.03"), D("10.02"))


def test_unbudgeted_spend_does_not_appear(spark):
    budgets = spark.createDataFrame([(1, "C", "2026-01", D("5")), (1, "Other", "2026-01", D("7"))], schemas.BUDGETS)
    rows = ledger(spark, [{}, {"category_name": "X"}, {"txn_type": "credit"}])
    got = {r.category_name: r.actual_amount for r in marts.budget_vs_actual(budgets, marts.category_spend_monthly(rows)).collect()}
    assert got == {"C": D("10.00"), "Other": D("0.00")}


def test_budget_months_follow_thirty_day_steps(spark):
    rows = ledger(spark, [{"txn_date": "2026-03-31", "amount": "10"}, {"txn_date": "2026-02-01", "amount": "21.01"}])
    got = sorted((r.month, r.budgeted_amount) for r in marts.budget_baseline(marts.category_spend_monthly(rows), rows).collect())
    # 31 March less 30 days is 1 March, less 60 is 30 January: February is skipped, March comes once.
    assert [m for m, _ in got] == ["2025-11", "2025-12", "2026-01", "2026-03"]
    assert {a for _, a in got} == {D("15.51")}


def test_unknown_category_keeps_its_row(spark):
    categories = spark.createDataFrame([("x", "C", "transfer")], schemas.CATEGORIES)
    rows = ledger(spark, [{}, {"category_name": "Q"}]).drop("category_group")
    got = {r.category_name: r.category_group for r in marts.fct_transactions(rows, categories).collect()}
    assert got == {"C": "transfer", "Q": None}


def test_rank_keeps_ties(spark):
    spend = spark.createDataFrame(
        [(1, "2026-01", c, D(a)) for c, a in (("a", 9), ("b", 5), ("c", 5), ("d", 5), ("e", 1))],
        "account_id long, month string, category_name string, total_amount decimal(12,2)")
    assert sorted(r.category_name for r in analytics.top_categories(spend).collect()) == ["a", "b", "c", "d"]


def kpi(spark, *rows):
    return spark.createDataFrame(rows, "account_id long, runway_days double, last_month_net decimal(12,2)")


def test_runway_words(spark):
    rows = reports.runway_status(kpi(spark, (1, None, D("0")), (2, 59.9, D("-1")), (3, 60.0, D("1")), (4, -5.0, D("1"))))
    got = {r.account_id: (r.runway_status, r.net_flow_status, r.warn) for r in rows.collect()}
    assert got == {
        1: ("no burn detected", "inflow", False), 2: ("below 60-day buffer", "outflow", True),
        3: ("healthy buffer", "inflow", False), 4: ("below 60-day buffer", "inflow", True)}


def test_month_range_defaults_to_the_latest_and_swaps_ends(spark):
    df = spark.createDataFrame([(1, "2026-01"), (1, "2026-02"), (2, "2025-12")], "account_id long, month string")
    months = lambda d: sorted((r.account_id, r.month) for r in d.collect())
    assert months(reports.in_months(df)) == [(1, "2026-02"), (2, "2025-12")]
    assert months(reports.in_months(df, "2026-01", "2025-12")) == [(1, "2026-01"), (2, "2025-12")]
    assert months(reports.in_months(df, start_month="2026-02")) == [(1, "2026-02")]


SPEND = ("account_id long, month string, category_name string, category_group string, "
         "total_amount decimal(12,2), txn_count long")
BVA = ("account_id long, month string, category_name string, budgeted_amount decimal(12,2), "
       "actual_amount decimal(22,2)")
HEALTH = "account_id long, current_balance decimal(22,2), avg_daily_burn decimal(22,6)"
NAIVE = "account_id long, forecast_date date, predicted_balance decimal(22,2)"


def recommend(spark, balance, burn, cut=15, forecast=True, spend=None, budget=None):
    spend = spend or [
        (1, "2026-01", "Old", "discretionary", D("999"), 1), (1, "2026-02", "Food", "variable_expense", D("200"), 3),
        (1, "2026-02", "Fun", "discretionary", D("300"), 3), (1, "2026-02", "Rent", "fixed_expense", D("900"), 1),
        (1, "2026-02", "Toys", "discretionary", D("100"), 1), (1, "2026-02", "Bar", "discretionary", D("50"), 1)]
    budget = budget if budget is not None else [
        (1, "2026-02", "Food", D("150"), D("200")), (1, "2026-02", "Fun", D("400"), D("300")),
        (1, "2026-01", "Old", D("1"), D("999"))]
    ends = [(1, dt.date(2026, 3, d), D(str(100 * d))) for d in (1, 2)] if forecast else []
    rows = reports.recommendations(
        spark.createDataFrame(spend, SPEND), spark.createDataFrame(budget, BVA),
        spark.createDataFrame([(1, D(str(balance)), D(str(burn)))], HEALTH), spark.createDataFrame(ends, NAIVE), cut)
    return rows.orderBy("position").collect()


def test_recommendations_put_over_budget_first_and_keep_three(spark):
    rows = recommend(spark, 6000, 100)
    assert [r.category_name for r in rows] == ["Food", "Fun", "Toys"]
    assert [r.monthly_savings for r in rows] == [50.0, 45.0, 15.0]
    assert rows[0].action == "Get back to budget" and rows[1].action == "Hypothetical: cut it by 15%"
    assert rows[0].old_runway == 60 and rows[0].new_runway == pytest.approx(6000 / (100 - 50 / 30))
    assert rows[0].runway_change == "+1 days"
    assert (rows[0].old_forecast_balance, rows[0].new_forecast_balance) == (200.0, 250.0)
    assert rows[0].headline == "Food is $50 over its $150 budget this month ($200 spent)."


def test_a_larger_cut_saves_more(spark):
    assert recommend(spark, 6000, 100, cut=30)[1].monthly_savings == 90.0
    with pytest.raises(ValueError):
        recommend(spark, 6000, 100, cut=17)


def test_no_runway_for_a_negative_balance_or_no_burn(spark):
    rows = recommend(spark, -10, 100, forecast=False)
    assert all(r.old_runway is None and r.new_runway is None and r.runway_change is None for r in rows)
    assert rows[0].runway_na_reason == "not meaningful with a negative balance"
    assert rows[0].new_forecast_balance is None
    assert recommend(spark, 10, 0)[0].runway_na_reason == "no burn detected"


def test_savings_above_the_burn_end_it(spark):
    rows = recommend(spark, 100, 1)
    assert rows[0].new_runway is None and rows[0].runway_change == "no longer burning cash"
    assert recommend(spark, 100, 1000)[2].runway_change == "no meaningful change"


def test_access(spark):
    acc = accounts(spark, 1, 2, 3, 4, 5)
    access = spark.createDataFrame([("demo", "*"), ("nina", "Account 2"), ("nina", "Account 2")],
                                   "username string, account_name string")
    names = lambda user: [r.account_name for r in serving.visible_accounts(acc, access, user).collect()]
    assert len(names("demo")) == 5 and names("nina") == ["Account 2"] and names("nobody") == []


def test_drilldown_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger(spark, [{"txn_date": "2026-01-31"}, {"txn_date": "2026-02-01"}, {"txn_date": "2026-02-28"}]).write.parquet(path)
    rows = serving.category_drilldown(spark.read.parquet(path), "C", "2026-02", "2026-02", account_id=1)
    assert rows.count() == 2
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = rows.filter("true")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(txn_date,2026-02-01)" in plan and "LessThan(txn_date,2026-03-01)" in plan
    assert "EqualTo(account_id,1)" in plan


def gate_tables(spark):
    acc = spark.createDataFrame([(1,), (2,), (2,)], "account_id long")
    txn = spark.createDataFrame([(1, 1, "debit"), (2, 9, "odd"), (None, None, None), (3, 9, "credit")],
                                "transaction_id long, account_id long, txn_type string")
    return {"a": acc, "t": txn}


def test_failures_are_counted_and_stop_the_run(spark):
    tests = (quality.Unique("a", ("account_id",)), quality.NotNull("t", "transaction_id"),
             quality.Accepted("t", "txn_type", schemas.TXN_TYPES), quality.NotNull("a", "account_id"),
             quality.Relationship("t", "account_id", "a", "account_id"))
    report = quality.run_tests(gate_tables(spark), tests)
    got = {(r.test, r.table_name, r.column_name): r.failures for r in report.collect()}
    assert got == {
        ("unique", "a", "account_id"): 1, ("not_null", "t", "transaction_id"): 1,
        ("accepted_values", "t", "txn_type"): 1, ("not_null", "a", "account_id"): 0,
        ("relationships", "t", "account_id"): 2}
    with pytest.raises(quality.QualityGateError, match="unique a.account_id: 1"):
        quality.assert_gate(report)
    quality.assert_gate(report.filter("failures = 0"))


def test_eighteen_declared_tests():
    assert len(quality.STAGING_TESTS) == 11 and len(quality.MART_TESTS) == 7


def test_changes(spark):
    base = ledger(spark, [{"transaction_id": x} for x in "abcd"])
    updates = ledger(spark, [{"transaction_id": "a", "amount": "-5.56", "merchant_name": " New "},
                             {"transaction_id": "b"}, {"transaction_id": "zzz"}]).withColumn("sequence", F.lit(2))
    earlier = ledger(spark, [{"transaction_id": "a", "amount": "99", "merchant_name": "Zz"}]).withColumn("sequence", F.lit(1))
    updates = updates.unionByName(earlier)
    deletes = spark.createDataFrame([("b",), ("c",)], "transaction_id string")
    got = {r.transaction_id: r for r in changes.apply_changes(base, updates, deletes).collect()}
    assert sorted(got) == ["a", "d"]
    assert got["a"].amount == D("5.56") and got["a"].merchant_name == "New" and got["d"].amount == D("10.00")


def test_new_merchants_learn_the_first_category(spark):
    merchants = spark.createDataFrame([("1", "Known", "Own")], schemas.MERCHANTS)
    rows = ledger(spark, [{"merchant_name": " New", "category_name": "X"}, {"merchant_name": "New", "category_name": "Y"},
                          {"merchant_name": "Known", "category_name": "Z"}, {"merchant_name": " "}])
    got = {r.merchant_name: r.default_category for r in changes.add_merchants(merchants, rows).collect()}
    assert got == {"Known": "Own", "New": "X"}
