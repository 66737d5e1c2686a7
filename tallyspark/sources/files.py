"""Reading raw CSV files and writing result tables."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark import schemas
from tallyspark.functions.columns import slug
from tallyspark.session import exists, remove, rename, wide
from tallyspark.sources import csv_records

CORRUPT = "_corrupt_record"
PLACE = "_place"
QUOTED = {"quote": '"', "escape": '"'}


def read_raw_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = True,
                 order: str | None = None) -> DataFrame:
    """CSV files with a header, the columns of `schema` by name, every column text, blank where a field is empty.

    A missing column fails, but for those with a default in `schemas.RAW_DEFAULTS`; other columns of the files are left
    out. All files must have the first one's header. Rows with too few or too many fields keep their text in
    `_corrupt_record`. Line breaks inside quotes belong to the field, and large files are split between tasks all the
    same: `csv_records` looks for such breaks first, which is a job of its own. Feeds known to have none can be read with
    `multi_line=False`; there an unclosed quote ends with its line, and the row is marked as corrupt. Blank lines are no
    records.

    `order` names a column to add that sorts rows by file path and then by place in the file.
    """
    header = spark.read.option("header", True).options(**QUOTED).csv(path).columns
    missing = [c for c in schema.names if c not in header and c not in schemas.RAW_DEFAULTS]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    in_file = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    broken = csv_records.records(spark, path) if multi_line else None
    if broken is not None:
        rows = _parsed(broken, in_file)
    else:
        rows = (
            spark.read.option("header", True)
            .option("enforceSchema", False)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .options(**QUOTED)
            .schema(in_file)
            .csv(path)
        ).withColumn(PLACE, F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row")))
    corrupt = F.col(CORRUPT)
    if not multi_line:
        odd_quotes = F.concat_ws(",", *[F.col(f"`{c}`") for c in header])
        corrupt = F.when(F.regexp_count(odd_quotes, F.lit('"')) % 2 == 1, odd_quotes).otherwise(corrupt)
    # Spark reads an empty field as NULL; here NULL would hide a blank flag or date.
    columns = [
        F.coalesce(F.col(f"`{c}`") if c in header else F.lit(schemas.RAW_DEFAULTS[c]), F.lit("")).alias(c)
        for c in schema.names
    ]
    if order:
        columns.append(F.col(PLACE).alias(order))
    return rows.select(*columns, corrupt.alias(CORRUPT))


def _parsed(records: DataFrame, in_file: T.StructType) -> DataFrame:
    """Records as columns; each file's first one must be the header, as Spark's reader demands."""
    options = {**QUOTED, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    names = [f.name for f in in_file if f.name != CORRUPT]
    columns = ", ".join("`{}` STRING".format(f.name.replace("`", "``")) for f in in_file)
    # As a generator's output a record is parsed once; filters on its columns would each parse it again below a projection.
    row = [F.col(f"`_{i}`") for i in range(len(in_file))]
    parsed = records.select("file", "start", "row", F.inline(F.array(F.from_csv("record", columns, options))).alias(
        *[f"_{i}" for i in range(len(in_file))]))
    same = F.lower(F.concat_ws("\n", *row[:len(names)])) == "\n".join(names).lower()
    refused = F.raise_error(F.concat(F.lit("CSV header does not conform to the first file's: "), F.col("file")))
    data = F.when((F.col("start") > 0) | (F.col("row") > 0), True).otherwise(F.when(same, False).otherwise(refused))
    return parsed.filter(data.cast("boolean")).select(
        *[c.alias(f.name) for c, f in zip(row, in_file)], F.struct("file", "start", "row").alias(PLACE))


def read_accounts_csv(spark: SparkSession, path: str) -> DataFrame:
    """accounts.csv with its 0-based row position as `account_ref`.

    Position only means something within one file, so several files without an `account_ref` column are refused. Rows
    are numbered by counting those of each split and adding up the counts in the order of the splits.
    """
    reader = spark.read.option("header", True).csv(path)
    if "account_ref" in reader.columns:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in reader.columns])
        return read_raw_csv(spark, path, schema)
    if len(reader.inputFiles()) > 1:
        raise ValueError(f"{path} holds several files without account_ref; row positions have no meaning across them")
    rows = numbered(read_raw_csv(spark, path, schemas.RAW_TABLES["accounts"], order=PLACE), PLACE, "account_ref")
    return rows.select(F.col("account_ref").cast("string").alias("account_ref"), *[c for c in rows.columns if c != "account_ref"])


def numbered(rows: DataFrame, place: str, name: str) -> DataFrame:
    """`rows` of `read_raw_csv` with their position over all files, from 0, as `name` instead of `place`.

    Within a split rows are numbered without gaps; the driver adds up one count for each split.
    """
    splits = rows.groupBy(f"{place}.file", f"{place}.start").agg(
        F.min(f"{place}.row").alias("first"), F.count("*").alias("n")).orderBy("file", "start").collect()
    before, bases = 0, []
    for split in splits:
        bases.append((split["file"], split["start"], before - split["first"]))
        before += split["n"]
    base = rows.sparkSession.createDataFrame(bases, "_file string, _start long, _base long")
    # As short as the list of splits, which the driver holds anyway.
    at_split = (F.col(f"{place}.file") == F.col("_file")) & (F.col(f"{place}.start") == F.col("_start"))
    found = rows.join(F.broadcast(base), at_split, "left")
    return found.withColumn(name, F.col("_base") + F.col(f"{place}.row")).drop("_file", "_start", "_base", place)


def stamp_loaded_at(df: DataFrame) -> DataFrame:
    """Ingestion time on every raw row."""
    return df.withColumn("loaded_at", F.current_timestamp())


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a whole table with `df`; running it twice leaves one copy.

    The new rows are written beside the table and moved into its place after
    they are complete, so a job that fails leaves the old table as it was, and
    `df` may read the table that it replaces.
    """
    replace_tables({path: df}, partition_by)


def replace_tables(tables: dict[str, DataFrame], partition_by: list[str] | None = None) -> None:
    """Replace several tables, by path, as one: none is touched before all are written."""
    spark = next(iter(tables.values())).sparkSession
    new = {path: f"{path.rstrip('/')}.new-{uuid.uuid4().hex}" for path in tables}
    try:
        for path, df in tables.items():
            _writer(df, partition_by).parquet(new[path])
    except Exception:
        for path in new.values():
            remove(spark, path)
        raise
    switch(spark, new)


def _writer(df: DataFrame, partition_by: list[str] | None):
    return df.write.partitionBy(*partition_by) if partition_by else df.write


def switch(spark: SparkSession, new: dict[str, str | None]) -> None:
    """Put folders into the places that they are to have; a place without a new folder is emptied.

    Folders are switched by renames, which a file system does at once. If one fails, the old folders are put back.
    """
    switched = []
    try:
        for path, source in new.items():
            old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}" if exists(spark, path) else None
            if old:
                rename(spark, path, hidden(old))
            switched.append((path, old and hidden(old)))
            if source:
                rename(spark, source, path)
    except Exception:
        for path, old in reversed(switched):
            if old and exists(spark, path):
                remove(spark, path)
            if old:
                rename(spark, old, path)
        raise
    for _, old in switched:
        if old:
            remove(spark, old)


def hidden(path: str) -> str:
    """A name beside `path` that readers of the folder pass over."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name}"


class Publication:
    """Tables of a run, written to a folder of their own and put into place together.

    `write` stores a table below the run's folder and reads it back, so later steps and audits work on what would be
    published. `publish` switches all tables at once; without it the published ones stay as they were, and the run's
    folder stays for a look at what went wrong. Its name begins with an underscore, which readers pass over.
    """

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir = spark, out_dir.rstrip("/")
        self.folder = f"{self.out_dir}/_run-{uuid.uuid4().hex}"
        self._schemas: dict[str, T.StructType] = {}

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        _writer(df, partition_by).parquet(f"{self.folder}/{name}")
        self._schemas[name] = df.schema
        return self._read(self.folder, name)

    def _read(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.schema(self._schemas[name]).parquet(f"{folder}/{name}")

    def publish(self) -> dict[str, DataFrame]:
        """The published tables, by name."""
        switch(self.spark, {f"{self.out_dir}/{name}": f"{self.folder}/{name}" for name in self._schemas})
        remove(self.spark, self.folder)
        return {name: self._read(self.out_dir, name) for name in self._schemas}


def replace_partitions(df: DataFrame, path: str, column: str, values: list[str]) -> None:
    """Replace the partitions `values` of a table stored by `column`; `df` has their new rows and may read the table.

    A partition that gets no rows is removed. Files of other partitions are not touched.
    """
    spark, new = df.sparkSession, f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(column).parquet(new)
        folders = {value: f"{column}={value}" for value in values}
        switch(spark, {
            f"{path.rstrip('/')}/{name}": f"{new}/{name}" if exists(spark, f"{new}/{name}") else None
            for name in folders.values()})
    finally:
        remove(spark, new)


def land_raw(tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Replace the raw zone as one, every row stamped; a feed without rows leaves an empty table.

    Returns the path of each table.
    """
    paths = {name: f"{out_dir}/raw_{name}" for name in tables}
    replace_tables({paths[name]: stamp_loaded_at(df) for name, df in tables.items()})
    return paths


LEDGER_PARTITION = ["txn_month"]
#: Steps of each clustered column, as a power of two.
CLUSTER_BITS = 6
#: Rows that one task sorts and writes, about 100 MB; a larger ledger gets more tasks than the session's shuffles.
LEDGER_ROWS_PER_TASK = 1 << 20


def ledger_layout(ledger: DataFrame) -> DataFrame:
    """The ledger as it is stored by month, clustered by account and category inside each month.

    Accounts and categories are numbered by the share of rows up to them, in equal steps, and the bits of both numbers
    interleave. Ranges of that value are small rectangles of both columns, so a filter on either finds few files by their
    statistics. The range includes the transaction id: one account's rows of one category are cut into several files,
    never one task's output. A ledger without categories is clustered by account.
    """
    placed, clustered = ledger, ["account_id"]
    account_step, n_rows = _account_step(ledger)
    if "category_name" in ledger.columns:
        placed = ledger.withColumn("_square", interleaved(account_step, _category_step(ledger), CLUSTER_BITS))
        clustered = ["_square", "account_id"]
    n_tasks = -(-n_rows // LEDGER_ROWS_PER_TASK)
    # A stated number is kept as it is, so only a ledger too large for the session's number gets one.
    stated = [n_tasks] if n_tasks > int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return (
        placed.withColumn("txn_month", F.date_format("txn_date", "yyyy-MM"))
        .repartitionByRange(*stated, "txn_month", *clustered, "transaction_id")
        .sortWithinPartitions("txn_month", *clustered, "txn_date")
        .select(*ledger.columns, "txn_month")
    )


def _account_step(ledger: DataFrame) -> tuple[Column, int]:
    """The step of an account, and the number of rows; the bounds of steps are approximate quantiles, a literal of fixed length."""
    steps = 1 << CLUSTER_BITS
    bounds, n_rows = ledger.agg(
        F.percentile_approx("account_id", [i / steps for i in range(1, steps)]), F.count("*")).first()
    found = F.array(*map(F.lit, sorted(set(bounds or [])))).cast("array<bigint>")
    return F.size(F.filter(found, lambda x: x < F.col("account_id"))), n_rows


def _category_steps(ledger: DataFrame) -> DataFrame:
    """(category_name, _step) for every category of the ledger, which is a lookup's number of rows."""
    counted = ledger.groupBy("category_name").agg(F.count("*").alias("n")).filter(F.col("category_name").isNotNull())
    by_name, every = Window.orderBy("category_name"), Window.partitionBy()
    before = F.sum("n").over(by_name) - F.col("n")
    step = F.floor(before * (1 << CLUSTER_BITS) / F.sum("n").over(every)).cast("int")
    return counted.select("category_name", step.alias("_step"))


def _category_step(ledger: DataFrame) -> Column:
    """The step of a category, 0 where it is NULL.

    Steps rise with the names, so the first name of each, a literal of fixed length, tells them all; a join by category
    would put all rows of one into one task.
    """
    firsts = _category_steps(ledger).groupBy("_step").agg(F.min("category_name").alias("first")).orderBy("first").collect()
    if not firsts:
        return F.lit(0)
    names, steps = F.array(*[F.lit(r["first"]) for r in firsts]), F.array(*[F.lit(r["_step"]) for r in firsts])
    return F.coalesce(F.get(steps, F.size(F.filter(names, lambda x: x <= F.col("category_name"))) - 1), F.lit(0))


def interleaved(a: Column, b: Column, bits: int) -> Column:
    """The bits of two numbers in turn, a's before b's."""
    value = F.lit(0)
    for i in range(bits):
        value = value + F.shiftleft(F.shiftright(a, i).bitwiseAND(1), 2 * i + 1)
        value = value + F.shiftleft(F.shiftright(b, i).bitwiseAND(1), 2 * i)
    return value


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Replace the stored ledger; a job that fails leaves the old one."""
    replace_table(ledger_layout(ledger), path, LEDGER_PARTITION)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger with its month as text."""
    schema = spark.read.parquet(path).schema
    month, = LEDGER_PARTITION
    fields = [T.StructField(month, T.StringType()) if f.name == month else f for f in schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def materialize_layer(frames: dict[str, DataFrame], out_dir: str, layer: str, as_views: bool) -> dict[str, DataFrame]:
    """Staging frames become views (plans only), mart frames become stored tables."""
    result = {}
    for name, df in frames.items():
        if as_views:
            df.createOrReplaceTempView(f"{layer}_{name}")
            result[name] = df
        else:
            path = f"{out_dir}/{layer}/{name}"
            replace_table(df, path)
            result[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return result


def export_flags_csv(flags: DataFrame, path: str) -> None:
    """Flagged transactions as CSV, one folder per account slug.

    Rows are spread by account and transaction, so a single account's export
    may be several files but never one task's work. A folder costs far more than its bytes, so the number of tasks does
    not follow from these. A job that fails leaves the old export.
    """
    spark, new = flags.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        (
            flags.withColumn("account_slug", slug("account_name"))
            .repartitionByRange(wide(spark), "account_slug", "transaction_id")
            .sortWithinPartitions("account_slug", F.desc("anomaly_score"), "transaction_id")
            .write.partitionBy("account_slug").option("header", True).csv(new)
        )
    except Exception:
        remove(spark, new)
        raise
    switch(spark, {path: new})
