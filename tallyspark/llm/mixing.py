"""Operator 8, mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

The levels (domain, language, source) make a tree; a leaf's supply is its tokens, its capacity that times `max_epochs`.
The token budget goes from the root to the leaves. At each node the children share it by weight; a child whose capacity
is below its share gets its capacity, and what it leaves goes to its siblings by weight, again up to their capacity. As a
node's budget never exceeds the sum of its leaves' capacities, a shortage is made up among siblings first and reaches a
node's siblings only when the whole node falls short. Shares are whole tokens that add up exactly; left-over single
tokens go to the first unsaturated siblings.

A leaf takes whole epochs of its documents, then the longest prefix of the next epoch that fits. An epoch's order is that
of a hash of seed, epoch and id. The prefix ends at one key per leaf, found from sums over 4,096 key ranges and the rows
of a single range, so a leaf with a third of all rows is never sorted.

Nulls in a level are a value of their own. A text without words has no tokens and rides along where the prefix reaches
it. Equal ids in a leaf are taken together. Values without a weight get `default_weight`; weight 0 takes nothing. A null
text has no tokens. An existing column `epoch` is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.session import materialize

RANGE_DIGITS = 3
KEY_DIGITS = 15
WORD = r"[^ \t\n\x0B\f\r]+"


def n_tokens(text_col: str = "text") -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source_col: str = "source") -> Column:
    """Four invented domains, by the number at the end of the source's name."""
    number = F.regexp_extract(F.coalesce(source_col, F.lit("")), r"(\d+)$", 1)
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("99999999")), F.lit(0)).cast("long") % 4)


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], budget: int,
            max_epochs: int, default_weight: int = 1) -> DataFrame:
    """(levels, supply, budget) of (levels, supply)."""
    rows = leaves.withColumn("_cap", F.col("supply") * max_epochs)
    for level in levels:
        weight = _weight(level, weights.get(level, {}), default_weight)
        rows = rows.withColumn("_cap", F.when(weight > 0, F.col("_cap")).otherwise(0)).withColumn(
            f"_w_{level}", F.greatest(weight, F.lit(1)))
    total = F.sum("_cap").over(Window.partitionBy(F.lit(0)))
    nodes = None
    for depth in range(len(levels)):
        path = levels[:depth + 1]
        children = rows.groupBy(*path, f"_w_{path[-1]}").agg(F.sum("_cap").alias("_cap"))
        if nodes is None:
            children = children.withColumn("_budget", F.least(F.lit(budget).cast("long"), total))
        else:
            children = children.join(nodes, path[:-1])
        nodes = _share(children, path, f"_w_{path[-1]}")
    return rows.select(*levels, "supply").join(nodes.withColumnRenamed("_budget", "budget"), levels)


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    weight = F.lit(None).cast("int")
    for value, w in weights.items():
        weight = F.when(F.col(level) == value, w).otherwise(weight)
    return F.coalesce(weight, F.lit(default))


def _share(children: DataFrame, path: list[str], weight: str) -> DataFrame:
    """The budget of each child, from that of its parent, its weight and its capacity."""
    parent, name = [F.lit(0), *path[:-1]], path[-1]
    by_fill = Window.partitionBy(*parent).orderBy(F.col("_cap") / F.col(weight), name)
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    cap, w = F.col("_cap").cast("decimal(18,0)"), F.col(weight).cast("decimal(9,0)")
    rows = children.withColumns({
        "_left": (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("decimal(18,0)"),
        "_weights": F.sum(weight).over(after).cast("decimal(9,0)"),
    }).withColumn("_full", cap * F.col("_weights") <= w * F.col("_left"))
    # The first child that is not full sees what all the full ones left, and all the weight it shares that with.
    whole = Window.partitionBy(*parent)
    rows = rows.withColumns({
        "_pool": F.coalesce(F.max(F.when(~F.col("_full"), F.col("_left"))).over(whole), F.lit(0)).cast("decimal(18,0)"),
        "_sharing": F.coalesce(F.max(F.when(~F.col("_full"), F.col("_weights"))).over(whole), F.lit(1)).cast("decimal(9,0)"),
    }).withColumn("_part", F.when(F.col("_full"), F.col("_cap")).otherwise(
        F.floor(w * F.col("_pool") / F.col("_sharing")).cast("long")))
    open_before = F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(before)
    spare = F.col("_budget") - F.sum("_part").over(whole)
    extra = F.when(~F.col("_full") & (F.coalesce(open_before, F.lit(0)) < spare), 1).otherwise(0)
    return rows.withColumn("_extra", extra).select(*path, (F.col("_part") + F.col("_extra")).alias("_budget"))


def selection(narrow: DataFrame, levels: list[str], *, weights: Mapping[str, Mapping[str, int]], budget_percent: int,
              max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: `_whole` epochs, and where the prefix of the next one ends (`_range`, `_key`, `_last`).

    `narrow` has _id (text), the levels and tokens. The budget is a share of all tokens.
    """
    leaves = narrow.groupBy(*levels).agg(F.sum("tokens").alias("supply"))
    supply = leaves.agg(F.sum("supply").alias("supply")).first()["supply"] or 0
    budget = supply * budget_percent // 100
    planned = materialize(budgets(leaves, levels, weights, budget, max_epochs), "budgets").withColumns({
        "_whole": F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("long"),
    }).withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("supply"))
    keyed = narrow.join(planned, levels).withColumn("_key", epoch_key(seed)).withColumn("_range", key_range("_key"))
    sums = keyed.groupBy(*levels, "_rest", "_range").agg(F.sum("tokens").alias("tokens"))
    ranges = Window.partitionBy(*levels).orderBy("_range")
    ends = sums.withColumn("_end", F.sum("tokens").over(ranges)).filter("_end > _rest")
    cut = ends.groupBy(*levels).agg(F.min(F.struct("_range", (F.col("_end") - F.col("tokens")).alias("_before"))).alias("c"))
    cut = cut.select(*levels, F.col("c._range").alias("_range"), F.col("c._before").alias("_before"))
    in_range = Window.partitionBy(*levels).orderBy("_key", "_id")
    last = (
        keyed.join(cut, [*levels, "_range"])
        .withColumn("_sum", F.col("_before") + F.sum("tokens").over(in_range)).filter("_sum <= _rest")
        .groupBy(*levels).agg(F.max(F.struct("_key", "_id")).alias("_last"))
    )
    return planned.join(cut.select(*levels, "_range"), levels, "left").join(last, levels, "left")


def epoch_key(seed: int) -> Column:
    """Place of a row in the epoch after the leaf's whole ones, as hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("_whole"), F.col("_id"))), 1, KEY_DIGITS)


def key_range(key: str) -> Column:
    return F.substring(key, 1, RANGE_DIGITS)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", levels: Mapping[str, Column],
        weights: Mapping[str, Mapping[str, int]], budget_percent: int, max_epochs: int = 1, seed: int = 0) -> DataFrame:
    """The chosen rows of `docs`, one for each epoch that takes it, with `epoch` from 1."""
    names = [f"_level_{name}" for name in levels]
    keys = [F.coalesce(c.cast("string"), F.lit("(null)")).alias(n) for n, c in zip(names, levels.values())]
    row_id = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id")
    narrow = materialize(docs.select(row_id, *keys, n_tokens(text_col).alias("tokens")), "tokens")
    chosen = selection(narrow, names, weights={f"_level_{k}": v for k, v in weights.items()},
                       budget_percent=budget_percent, max_epochs=max_epochs, seed=seed)
    chosen = materialize(chosen.withColumnRenamed("_range", "_cut"), "chosen").select(*names, "_whole", "_cut", "_last")
    packed = docs.drop("epoch").select(F.struct(*[c for c in docs.columns if c != "epoch"]).alias("doc"), row_id, *keys)
    keyed = packed.join(chosen, names).withColumn("_key", epoch_key(seed)).withColumn("_range", key_range("_key"))
    in_prefix = (
        F.col("_cut").isNull() | (F.col("_range") < F.col("_cut"))
        | ((F.col("_range") == F.col("_cut")) & (F.struct("_key", "_id") <= F.col("_last")))
    )
    # A leaf without a cut that has used up its epochs takes no more of the next one.
    copies = F.col("_whole") + F.when(F.coalesce(in_prefix, F.lit(False)), 1).otherwise(0)
    copies = F.least(copies, F.lit(max_epochs))
    return keyed.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(
        "doc.*", "epoch")
