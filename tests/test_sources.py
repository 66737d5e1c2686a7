"""Files in and out, and the whole run."""

import datetime as dt
import os
import random
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schemas, session
from tallyspark.operators import changes, quality, serving, staging
from tallyspark.plans.pipeline import run_pipeline
from tallyspark.sources import csv_records, files


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_is_text_with_blanks_and_short_rows_marked(spark, tmp_path):
    path = write(tmp_path / "budgets.csv",
                 'account_ref,category_name,month,budgeted_amount\n0,"A, B",2026-01,007\n1,,2026-02,\n2,C\n')
    rows = files.read_raw_csv(spark, path, schemas.RAW_TABLES["budgets"]).orderBy("account_ref").collect()
    assert rows[0].category_name == "A, B" and rows[0].budgeted_amount == "007"
    assert rows[1].category_name == "" and rows[1].budgeted_amount == ""
    assert [r._corrupt_record is None for r in rows] == [True, True, False]


def test_columns_go_by_name_and_extra_ones_are_left_out(spark, tmp_path):
    path = write(tmp_path / "c.csv", "note,category_group,category_name\nn,income,Pay\n")
    row = files.read_raw_csv(spark, path, schemas.RAW_TABLES["categories"]).first()
    assert row.asDict() == {"category_name": "Pay", "category_group": "income", "_corrupt_record": None}
    with pytest.raises(ValueError, match="category_group"):
        files.read_raw_csv(spark, write(tmp_path / "d.csv", "category_name\nPay\n"), schemas.RAW_TABLES["categories"])


def test_absent_flag_column_is_zero(spark, tmp_path):
    names = [n for n in schemas.RAW_TABLES["transactions"].names if n != "is_recurring"]
    path = write(tmp_path / "t.csv", ",".join(names) + "\n" + ",".join("x" * len(names)) + "\n")
    assert files.read_raw_csv(spark, path, schemas.RAW_TABLES["transactions"]).first().is_recurring == "0"


def test_files_with_another_header_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", "category_name,category_group\nPay,income\n")
    write(tmp_path / "b.csv", "category_group,category_name\nincome,Pay\n")
    with pytest.raises(Exception, match="CSV header does not conform|CSV header"):
        files.read_raw_csv(spark, str(tmp_path), schemas.RAW_TABLES["categories"]).collect()


def test_line_breaks_inside_quotes_stay_in_the_field(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'merchant_name,default_category\n"A\nB",Food\n"say ""x""",Pay\nC,D,E\n')
    rows = files.read_raw_csv(spark, path, schemas.RAW_TABLES["merchants"]).collect()
    assert [(r.merchant_name, r._corrupt_record is None) for r in rows] == [("A\nB", True), ('say "x"', True), ("C", False)]
    by_line = files.read_raw_csv(spark, path, schemas.RAW_TABLES["merchants"], multi_line=False).collect()
    assert not any(r._corrupt_record is None and "B" in r.merchant_name for r in by_line)


def test_feed_order_is_that_of_paths_not_of_sizes(spark, tmp_path):
    head = "account_ref,category_name,month,budgeted_amount\n"
    feed = tmp_path / "feed"
    feed.mkdir()
    write(feed / "1.csv", head + "0,Food,2026-03,300\n")
    write(feed / "2.csv", head + "0,Nope,2026-01,1\n" * 500 + "0,Food,2026-03,400\n0,Food,2026-03,450\n")
    rows = files.read_raw_csv(spark, str(feed), schemas.RAW_TABLES["budgets"], order="load_seq")
    categories = spark.createDataFrame([("Food", "1")], "category_name string, category_id string")
    row, = staging.load_budgets(rows, categories).collect()
    assert row.budgeted_amount == Decimal("450.00")


def test_positions_in_several_files_are_refused(spark, tmp_path):
    text = "account_name,account_type,owner_name,currency,opening_balance\nB,personal,x,USD,1\n"
    for name in "ab":
        write(tmp_path / f"{name}.csv", text)
    with pytest.raises(ValueError, match="several files"):
        files.read_accounts_csv(spark, str(tmp_path))


def test_account_ref_is_the_row_position(spark, tmp_path):
    text = "account_name,account_type,owner_name,currency,opening_balance\nB,personal,x,USD,1\nA,personal,y,USD,2\n"
    rows = files.read_accounts_csv(spark, write(tmp_path / "accounts.csv", text)).collect()
    assert [(r.account_ref, r.account_name) for r in rows] == [("0", "B"), ("1", "A")]


def test_account_ref_of_the_file_is_kept(spark, tmp_path):
    text = "account_ref,account_name\n7,B\n3,A\n"
    rows = files.read_accounts_csv(spark, write(tmp_path / "accounts.csv", text)).collect()
    assert [(r.account_ref, r.account_name) for r in rows] == [("7", "B"), ("3", "A")]


def test_replacing_twice_leaves_one_copy(spark, tmp_path):
    df = spark.range(5)
    for _ in range(2):
        files.replace_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def failing(spark):
    return spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))


def test_a_failing_overwrite_keeps_the_old_tables(spark, tmp_path):
    old, path, other = spark.range(5), str(tmp_path / "t"), str(tmp_path / "u")
    files.replace_tables({path: old, other: old})
    with pytest.raises(Exception, match="broken"):
        files.replace_table(failing(spark), path)
    with pytest.raises(Exception, match="broken"):
        files.land_raw({"x": spark.range(2), "y": failing(spark)}, str(tmp_path))
    with pytest.raises(Exception, match="broken"):
        files.replace_tables({path: spark.range(9), other: failing(spark)})
    assert spark.read.parquet(path).count() == spark.read.parquet(other).count() == 5
    assert sorted(os.listdir(tmp_path)) == ["t", "u"]


def test_a_table_can_be_replaced_by_a_change_of_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(5), path)
    files.replace_table(spark.read.parquet(path).filter("id > 1"), path)
    assert spark.read.parquet(path).count() == 3


def test_scratch_tables_go_with_their_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    kept = session.materialize(spark.range(3), "kept")
    with session.scratch(spark):
        with session.scratch(spark):
            session.materialize(spark.range(4), "inner")
        assert len(os.listdir(tmp_path / "tallyspark")) == 1
        assert session.materialize(spark.range(4), "outer").count() == 4
    assert kept.count() == 3 and len(os.listdir(tmp_path / "tallyspark")) == 1


def test_a_table_can_outlive_its_block_but_not_the_one_around(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    with session.scratch(spark):
        with session.scratch(spark):
            session.materialize(spark.range(4), "step")
            result = session.materialize(spark.range(3), "result", outlives=True)
        assert result.count() == 3 and len(os.listdir(tmp_path / "tallyspark")) == 1
    assert not os.listdir(tmp_path / "tallyspark")
    with session.scratch(spark):
        result = session.materialize(spark.range(3), "result", outlives=True)
    assert result.count() == 3
    assert session.materialize(spark.range(3), "no block", outlives=True).count() == 3


def test_drill_down_lists_only_the_months_asked_for(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(300).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(1).cast("long").alias("account_id"),
        F.expr("date_add(date'2026-01-01', cast(id % 90 as int))").alias("txn_date"), F.lit("Food").alias("category_name"),
        F.lit("debit").alias("txn_type"), F.lit("m").alias("merchant_name"), F.lit(1).alias("amount"),
        F.lit(False).alias("is_recurring"))
    files.write_ledger(rows, path)
    stored = spark.read.schema(rows.schema.add("txn_month", "string")).parquet(path)
    found = serving.category_drilldown(stored, "Food", "2026-02", "2026-02")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan and "2026-02" in plan.split("PartitionFilters")[1][:200]
    assert found.count() == serving.category_drilldown(stored.drop("txn_month"), "Food", "2026-02", "2026-02").count() > 0


def test_ledger_is_stored_by_month_and_split_within_one_account(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(2000).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(1).cast("long").alias("account_id"),
        F.expr("date_add(date'2026-01-01', cast(id % 60 as int))").alias("txn_date"))
    files.write_ledger(rows, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("txn_month")) == [
        "txn_month=2026-01", "txn_month=2026-02", "txn_month=2026-03"]
    assert spark.read.parquet(path).count() == 2000


def test_either_filter_touches_few_files(spark, tmp_path):
    """A month of 64 accounts and 64 categories in about 64 files; a value of either is in about the root of them."""
    path = str(tmp_path / "ledger")
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("transaction_id"), (F.xxhash64("id") % 64 + 64).cast("long").alias("account_id"),
        F.lit(dt.date(2026, 1, 5)).alias("txn_date"),
        F.format_string("Category %02d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64))).alias("category_name"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_ledger(rows, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(map(tuple, files.read_ledger(spark, path).drop("txn_month").collect())) == sorted(map(tuple, rows.collect()))
    folder = os.path.join(path, "txn_month=2026-01")
    parts = [f for f in os.listdir(folder) if f.endswith(".parquet")]

    def touched(column, value):
        found = 0
        for f in parts:
            meta = pq.ParquetFile(os.path.join(folder, f)).metadata
            at = meta.schema.names.index(column)
            stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
            found += any(s.min <= value <= s.max for s in stats)
        return found

    assert 50 <= len(parts) <= 80
    for column, value in (("account_id", 70), ("account_id", 100), ("category_name", "Category 05"), ("category_name", "Category 40")):
        assert touched(column, value) <= len(parts) / 3


def test_export_writes_one_folder_per_account(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("1", Decimal("0.5"), "Tove's Purse"), ("2", Decimal("0.9"), "Tove's Purse"), ("3", Decimal("0.7"), "B&B")]
    flags = spark.createDataFrame(rows, "transaction_id string, anomaly_score decimal(6,4), account_name string")
    files.export_flags_csv(flags, path)
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["account_slug=b_b", "account_slug=tove_s_purse"]
    assert spark.read.option("header", True).csv(path).count() == 3


def test_export_folders_are_written_by_many_tasks(spark, tmp_path):
    """However few bytes the rows have, no task writes most of the folders."""
    path = str(tmp_path / "out")
    flags = spark.range(400).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(0.5).alias("anomaly_score"),
        F.concat(F.lit("Account "), (F.col("id") % 100).cast("string")).alias("account_name"))
    files.export_flags_csv(flags, path)
    by_task = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.startswith("part-"):
                by_task.setdefault(name.split("-")[1], set()).add(folder)
    assert len(by_task) > 4 and max(map(len, by_task.values())) < 50
    back = spark.read.option("header", True).csv(path)
    assert back.count() == back.select("transaction_id").distinct().count() == 400
    assert back.select("account_slug").distinct().count() == 100


def test_views_and_stored_layers(spark, tmp_path):
    df = spark.range(3)
    assert files.materialize_layer({"x": df}, str(tmp_path), "staging", as_views=True)["x"] is df
    assert spark.table("staging_x").count() == 3
    stored = files.materialize_layer({"x": df}, str(tmp_path), "analytics", as_views=False)["x"]
    assert stored.count() == 3 and (tmp_path / "analytics" / "x").is_dir()


def test_shared_dir_follows_the_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_dir(spark) == configured.rstrip("/")
    assert session.materialize(spark.range(4), "t").count() == 4


RAW = {
    "categories": "category_name,category_group\nFood,variable_expense\nPay,income\nFun,discretionary\n",
    "merchants": "merchant_name,default_category\nShop,Food\nJob,Pay\nClub,Fun\n",
}


def raw_files(folder, accounts=2, doubled=False):
    for name, text in RAW.items():
        (folder / f"{name}.csv").write_text(text)
    lines = [f"Account {i},personal,Owner,USD,{100 * i}.00" for i in range(accounts)]
    (folder / "accounts.csv").write_text(
        "account_name,account_type,owner_name,currency,opening_balance\n" + "\n".join(lines) + "\n")
    rows, n = [], 0
    for a in range(accounts):
        for d in range(90):
            day = (dt.date(2026, 1, 1) + dt.timedelta(days=d)).isoformat()
            for cat, shop, amount, kind in (("Food", "Shop", 10 + d % 7, "debit"), ("Pay", "Job", 20, "credit")):
                n += 1
                rows.append(f"{n},{a},{day},{shop},{cat},{amount}.5,{kind},x,{int(cat == 'Pay')}")
    rows.append("900001,0,2026-01-01,Shop,Nope,5,debit,x,0")
    rows.append("900002,0,2026-01-01,Shop,Food,-5,debit,x,0")
    rows.append("900003,0,2026-03-31,Shop,Food,4000,debit,x,0")
    if doubled:
        rows.append("900003,0,2026-03-31,Shop,Food,4000,debit,x,0")
    (folder / "transactions.csv").write_text(
        "source_txn_id,account_ref,txn_date,merchant_name,category_name,amount,txn_type,description,is_recurring\n"
        + "\n".join(rows) + "\n")
    (folder / "budgets.csv").write_text(
        "account_ref,category_name,month,budgeted_amount\n0,Food,2026-03,300\n0,Food,2026-03,450\n0,Nope,2026-03,1\n")
    return n


def test_pipeline_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    n = raw_files(source)
    run = run_pipeline(spark, str(source), str(tmp_path / "out"))
    t = run.tables
    assert t["fct_transactions"].count() == n + 1
    assert sorted(r.reason_code for r in t["rejected"].collect()) == ["amount_positive", "category"]
    assert t["data_tests"].count() == 18 and t["data_tests"].filter("failures > 0").count() == 0
    budget, = t["budget_vs_actual"].collect()
    assert budget.budgeted_amount == Decimal("450.00") and budget.actual_amount > 4000
    assert t["anomaly_flags"].first().transaction_id == "900003"
    assert t["cashflow_forecast"].groupBy("account_id").count().filter("count = 30").count() == 2
    assert t["forecast_metrics"].count() == 2
    assert list(run.seconds)[:4] == ["load raw", "stage and validate", "marts", "quality gate"]
    assert sorted(run.seconds)[0] == "anomalies" and "forecast" in run.seconds
    assert t["malformed_rows"].count() == 0 and t["skipped_accounts"].count() == 0


def test_gate_stops_before_the_models(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    raw_files(source, doubled=True)
    with pytest.raises(quality.QualityGateError, match="transaction_id: 1"):
        run_pipeline(spark, str(source), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "anomaly_flags").exists()


# --- records over split borders -----------------------------------------------------------

FIELDS = ["x", "", '"q"', '"a\nb"', '"say ""hi"""', '"\n\n"', '5" pipe', '"x"y', '"x" ', ' "x"', '"m\n""l"",\n,end"', "é", '"a,b"',
          '"\r\nz"', '"""\n"""']


def messy_csv(seed, records, newline):
    rng = random.Random(seed)
    lines = [",".join(rng.choice(FIELDS) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(records)]
    return "a,b,c" + newline + newline.join(lines) + newline * (seed % 2)


ABC = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def by_multi_line(spark, path):
    """Spark's own reader, one task a file."""
    schema = T.StructType([*ABC, T.StructField(files.CORRUPT, T.StringType())])
    rows = spark.read.options(header=True, enforceSchema=False, columnNameOfCorruptRecord=files.CORRUPT, multiLine=True,
                              **files.QUOTED).schema(schema).csv(path)
    return [tuple(r) for r in rows.select(*[F.coalesce(c, F.lit("")) for c in "abc"], files.CORRUPT).collect()]


def in_splits(spark, path, size):
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = files.read_raw_csv(spark, path, ABC, order="place")
        found = sorted(rows.collect(), key=lambda r: tuple(r.place))
        return [(r.a, r.b, r.c, r[files.CORRUPT]) for r in found], rows.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("seed, newline", [(0, "\n"), (1, "\n"), (3, "\r\n"), (5, "\r\n")])
def test_records_equal_the_whole_file_reader_for_any_split(spark, tmp_path, seed, newline):
    path = tmp_path / "m.csv"
    path.write_bytes(messy_csv(seed, 20, newline).encode())
    # The text that a malformed record is kept with has one kind of line break here.
    want = [(*r[:3], r[3] and r[3].replace("\r\n", newline[-1] if len(newline) > 1 else "\r\n"))
            for r in by_multi_line(spark, str(path))]
    for size in (7, 64, 10_000):
        got, tasks = in_splits(spark, str(path), size)
        assert got == want and (tasks > 1 or size == 10_000)


def test_a_file_cut_at_every_offset(spark, tmp_path):
    """Splits of n bytes put a border at every multiple of n; all sizes together meet every offset."""
    text = 'a,b,c\n1,"x\n",2\n5" p,"\n""\n",\n'
    path = tmp_path / "m.csv"
    path.write_text(text)
    want = by_multi_line(spark, str(path))
    assert len(want) == 2
    for size in range(1, len(text) + 1):
        assert in_splits(spark, str(path), size)[0] == want


def test_a_field_never_closed_takes_the_rest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b,c\n1,"x\ny",2\n3,"open,4\n5,6,7\n')
    want = [("1", "x\ny", "2", None), ("3", "open,4\n5,6,7", "", '3,"open,4\n5,6,7')]
    assert [tuple(v and v.rstrip() for v in r) for r in by_multi_line(spark, str(path))] == want
    for size in (4, 9, 1000):
        assert in_splits(spark, str(path), size)[0] == want


def test_several_files_with_line_breaks_keep_their_order_and_headers(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for name in ("1.csv", "2.csv"):
        (feed / name).write_text(f'a,b,c\n"{name}\nx",1,2\nplain,3,4\n\n')
    got, _ = in_splits(spark, str(feed), 6)
    assert [r[0] for r in got] == ["1.csv\nx", "plain", "2.csv\nx", "plain"]
    (feed / "3.csv").write_text('b,a,c\n"x\ny",1,2\n')
    with pytest.raises(Exception, match="CSV header does not conform"):
        in_splits(spark, str(feed), 6)


def test_line_states_of_a_column_equal_those_of_single_lines():
    rng = random.Random(4)
    for i in range(3000):
        some = ["".join(rng.choice('"",,ax') for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]
        kind = pa.large_string() if i % 2 else pa.string()
        quotes = csv_records._Quotes(pa.array(['z,"', *some, '"'], kind).slice(1, len(some)))
        for quoted in (False, True):
            want, state = [], quoted
            for line in some:
                want.append(state := not csv_records.ends_record(line, state))
            assert quotes.open_after(quoted).tolist() == want


def test_lines_of_well_formed_records_are_not_matched_one_by_one(monkeypatch):
    monkeypatch.delattr(csv_records, "ends_record")
    column = pa.array(['1,"a', '""b"",', 'c",2', "", '3,"x ""y""",""', '"', '""",4', "5,6"])
    assert csv_records._Quotes(column).open_after(False).tolist() == [True, True, False, False, False, True, False, False]


def test_a_record_is_parsed_once_whatever_filters_its_columns(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'merchant_name,default_category\n"A\nB",Food\nC,D,E\n')
    rows = files.read_raw_csv(spark, path, schemas.RAW_TABLES["merchants"])
    whole = rows.filter(F.col(files.CORRUPT).isNull() & (F.col("merchant_name") != ""))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv(") == 1
    assert [r.merchant_name for r in whole.collect()] == ["A\nB"]


def test_blank_and_returned_lines_by_column(spark, tmp_path):
    """Blank lines of any white space go, one carriage return ends a line, and those inside quotes stay without it."""
    path = tmp_path / "m.csv"
    path.write_bytes('a,b,c\r\n"x\r\ny",1,2\r\n\r\n\u00a0 \r\n\t\né,3,4\r\n"z\r\n",5,6\n'.encode())
    want = [("x\ny", "1", "2"), ("é", "3", "4"), ("z\r\n", "5", "6")]
    for size in (5, 11, 1000):
        assert [r[:3] for r in in_splits(spark, str(path), size)[0]] == want


def test_account_positions_of_a_split_file(spark, tmp_path):
    text = "account_name,account_type,owner_name,currency,opening_balance\n" + "".join(
        f'"A{i}\n{i}",personal,x,USD,{i}\n' if i % 5 else f"A{i},personal,x,USD,{i}\n" for i in range(60))
    for name, body in (("broken", text), ("plain", text.replace('\n', ' ').replace(' A', '\nA').replace(' "A', '\n"A'))):
        path = write(tmp_path / f"{name}.csv", body)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
        try:
            rows = files.read_accounts_csv(spark, path)
            got = {int(r.account_ref): r.opening_balance for r in rows.collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {k: int(v) for k, v in got.items()} == {i: i for i in range(60)}


# --- publication and stored changes ---------------------------------------------------------

def listing(folder):
    """Every file below a folder and when it was written, but for folders that readers pass over."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names
            if "/_" not in os.path.join(d, f)[len(str(folder)):]}


def test_a_failing_gate_leaves_every_published_table(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    raw_files(source)
    run = run_pipeline(spark, str(source), str(out))
    rows = run.tables["fct_transactions"].count()
    before = listing(out)
    raw_files(source, accounts=3, doubled=True)
    with pytest.raises(quality.QualityGateError):
        run_pipeline(spark, str(source), str(out))
    assert listing(out) == before and spark.read.parquet(str(out / "fct_transactions")).count() == rows
    kept, = [d for d in os.listdir(out) if d.startswith("_run-")]
    assert spark.read.parquet(str(out / kept / "data_tests")).filter("failures > 0").count() > 0
    raw_files(source, accounts=3)
    again = run_pipeline(spark, str(source), str(out))
    assert again.tables["accounts"].count() == 3 and again.tables["fct_transactions"].count() == rows * 3 // 2
    parts = [{f for f in x if f.endswith(".parquet")} for x in (before, listing(out))]
    assert parts[0] and not parts[0] & parts[1]


def test_a_failing_ledger_or_export_leaves_the_old_one(spark, tmp_path):
    ledger = spark.range(40).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(1).cast("long").alias("account_id"),
        F.expr("date_add(date'2026-01-01', cast(id as int))").alias("txn_date"))
    path, export = str(tmp_path / "ledger"), str(tmp_path / "export")
    files.write_ledger(ledger, path)
    flags = ledger.select("transaction_id", F.lit(0.5).alias("anomaly_score"), F.lit("B&B").alias("account_name"))
    files.export_flags_csv(flags, export)
    before = listing(tmp_path)
    broken = F.when(F.col("transaction_id") == "7", F.raise_error(F.lit("broken"))).otherwise(F.col("transaction_id"))
    for write_it in (lambda: files.write_ledger(ledger.withColumn("transaction_id", broken), path),
                     lambda: files.export_flags_csv(flags.withColumn("transaction_id", broken), export)):
        with pytest.raises(Exception, match="broken"):
            write_it()
    assert listing(tmp_path) == before
    files.write_ledger(ledger.limit(3), path)
    assert spark.read.parquet(path).count() == 3


def stored_ledger(spark, path):
    rows = spark.range(120).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(1).cast("long").alias("account_id"),
        F.expr("date_add(date'2026-01-01', cast(id as int))").alias("txn_date"), F.lit("m").alias("merchant_name"),
        F.lit("Food").alias("category_name"), (F.col("id") + 1).cast(schemas.MONEY).alias("amount"),
        F.lit("debit").alias("txn_type"), F.lit(" d ").alias("description"), F.lit(False).alias("is_recurring"))
    files.write_ledger(rows, path)
    return files.read_ledger(spark, path)


def test_stored_changes_write_only_touched_months(spark, tmp_path):
    """One row moves from January to April, February loses all its rows, March stays as it is."""
    path = str(tmp_path / "ledger")
    old = session.materialize(stored_ledger(spark, path), "old")
    before = listing(path)
    rows = old.drop("txn_month")
    updates = rows.filter("transaction_id = '5'").withColumns({
        "txn_date": F.lit(dt.date(2026, 4, 2)), "amount": F.lit(-7), "sequence": F.lit(1)})
    unknown = updates.withColumn("transaction_id", F.lit("no such row")).withColumn("txn_date", F.lit(dt.date(2030, 1, 1)))
    deletes = rows.filter("month(txn_date) = 2").select("transaction_id")
    want = changes.apply_changes(rows, updates.unionByName(unknown), deletes)
    assert changes.change_stored_ledger(spark, path, updates.unionByName(unknown), deletes) == [
        "2026-01", "2026-02", "2026-04"]
    now = files.read_ledger(spark, path)
    assert sorted(map(tuple, now.drop("txn_month").collect())) == sorted(map(tuple, want.collect()))
    assert now.filter("txn_month <> date_format(txn_date, 'yyyy-MM')").count() == 0
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["txn_month=2026-01", "txn_month=2026-03", "txn_month=2026-04"]
    march = {f: t for f, t in before.items() if "2026-03" in f}
    assert march and march.items() <= listing(path).items()
    assert not [f for f in listing(path) if f in before and f not in march and "=" in f]
    assert changes.change_stored_ledger(spark, path, unknown, deletes.limit(0)) == []
    assert not [d for d in os.listdir(path) if d.startswith("_new")]


def test_a_failing_change_leaves_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = stored_ledger(spark, path).drop("txn_month")
    before = listing(path)
    broken = rows.filter("transaction_id = '5'").withColumns({"sequence": F.lit(1)})
    real = session.rename
    moved = []

    def failing_rename(spark_, source, target):
        moved.append(target)
        if len(moved) == 3:
            raise OSError("lost")
        real(spark_, source, target)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(files, "rename", failing_rename)
        with pytest.raises(OSError):
            changes.change_stored_ledger(
                spark, path, broken, rows.filter("transaction_id = '50'").select("transaction_id"))
    assert listing(path) == before


def test_a_large_ledger_is_dealt_to_more_tasks_than_the_session_shuffles(spark, monkeypatch):
    ledger = spark.range(200).selectExpr(
        "id AS transaction_id", "id % 7 AS account_id", "date_add(DATE'2026-01-01', CAST(id AS INT)) AS txn_date",
        "concat('c', id % 3) AS category_name")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(files, "LEDGER_ROWS_PER_TASK", 10)
    assert most < 20 and files.ledger_layout(ledger).rdd.getNumPartitions() == 20
    assert sorted(files.ledger_layout(ledger).drop("txn_month").collect()) == sorted(ledger.collect())


def test_the_ledger_layout_deals_no_rows_by_category(spark):
    """Categories get the steps that their share of rows gives them, without a join that puts each into one task."""
    names = ["b", "a", "zz", None, "m", "b", "é"]
    ledger = spark.createDataFrame(
        [(i, i % 5, dt.date(2026, 1, 1), names[i % 7]) for i in range(700)],
        "transaction_id long, account_id long, txn_date date, category_name string")
    assert "Join" not in files.ledger_layout(ledger)._jdf.queryExecution().optimizedPlan().toString()
    steps = {r.category_name: r._step for r in files._category_steps(ledger).collect()}
    rows = ledger.withColumn("step", files._category_step(ledger)).select("category_name", "step").distinct().collect()
    assert {r.category_name: r.step for r in rows} == {**steps, None: 0}
