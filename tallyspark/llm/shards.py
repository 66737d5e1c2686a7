"""Operator 2, sharding by a hypergeometric communication matrix. DataFrame functions only.

Rows fall into source partitions by a hash of their content. The driver draws how many rows of each partition go to each
shard: the multivariate hypergeometric distribution, so the matrix is distributed as that of a uniform shuffle and every
shard's size is exact. Each partition is permuted locally (by a second hash) and cut at its row of the matrix, rows are
exchanged, and each shard is permuted again (by a third hash).

So that no task holds a whole shard, a shard is a run of blocks of exact sizes, and the matrix has a column for each
block; a row's slot is its block's start, known beforehand, and its rank in the block. Partitions and blocks have about
ROWS rows, and more only where there would be over MOST of either, which bounds the matrix.

Everything follows from row content and seed, so a lost task repeats its result. Equal rows are interchangeable. Columns
named shard or slot are replaced; columns of map or variant type take no part in the hash.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS = 50_000
LEAST, MOST = 64, 2_000
FINE = 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items, taken without replacement, are good.

    Exact, in a few steps whatever the numbers, by Devroye's rejection for log-concave distributions: flat around the
    mode, exponential beyond.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1)
                 + math.lgamma(bad - draws + k + 1))

    at_mode = log_weight(mode)
    total = (math.lgamma(good + 1) - math.lgamma(good + bad + 1) + math.lgamma(bad + 1) + math.lgamma(draws + 1)
             + math.lgamma(good + bad - draws + 1))
    top = min(1.0, math.exp(total + at_mode))
    flat = 1 + top / 2
    while True:
        v = 1 - rng.random()
        apart = (v * flat if rng.random() <= flat / (1 + flat) else flat - math.log(v)) / top
        k = mode + (round(apart) if rng.random() < 0.5 else -round(apart))
        if low <= k <= high:
            accept = rng.random() * min(1.0, math.exp(flat - top * apart))
            if accept <= math.exp(log_weight(k) - at_mode):
                return k


def communication_matrix(part_sizes: list[int], block_sizes: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, drawn as a uniform shuffle would make them."""
    rng = random.Random(seed)
    room, rest = list(block_sizes), sum(block_sizes)
    matrix = []
    for size in part_sizes:
        row, left, others = [], size, rest
        for j, free in enumerate(room):
            others -= free
            n = hypergeometric(rng, free, others, left) if left else 0
            row.append(n)
            room[j] -= n
            left -= n
        rest -= size
        matrix.append(row)
    return matrix


def even(total: int, parts: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_to_shards(rows: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """`rows` with `shard` (int, from 0; sizes at most one apart) and `slot` (long, from 0 without gaps in a shard)."""
    rows = rows.drop("shard", "slot")
    content = [F.col(f.name) for f in rows.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]

    def hashed(step: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(step), *content)

    fine = F.pmod(hashed(1), F.lit(FINE)).cast("int")
    counted = {r["fine"]: r["n"] for r in rows.groupBy(fine.alias("fine")).agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    n_parts = min(MOST, max(LEAST, -(-total // ROWS)))
    sizes = [0] * n_parts
    for value, n in counted.items():
        sizes[value * n_parts // FINE] += n

    shard_sizes = even(total, n_shards)
    per_shard = max(1, -(-shard_sizes[0] // max(ROWS, total // MOST)))
    blocks = [b for size in shard_sizes for b in even(size, per_shard)]
    plan = rows.sparkSession.range(1).select(F.posexplode(F.from_json(
        F.lit(json.dumps([_ends(row, per_shard) for row in communication_matrix(sizes, blocks, seed)])),
        "array<array<array<bigint>>>")).alias("_part", "_ends"))

    place = [F.col(c) for c in ("_order",)] + content
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy(*place))
    in_block = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(*place))
    permuted = (
        rows.withColumns({"_part": F.floor(fine * n_parts / FINE).cast("int"), "_order": hashed(2)})
        .withColumn("_at", in_part)
    )
    dealt = (
        permuted.join(plan, "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: F.element_at(e, -1) < F.col("_at"))))
        .withColumn("_block", F.size(F.filter(F.get("_ends", F.col("shard")), lambda e: e < F.col("_at"))))
    )
    size = F.lit(total // n_shards) + F.when(F.col("shard") < total % n_shards, 1).otherwise(0)
    start = F.col("_block") * F.floor(size / per_shard) + F.least(F.col("_block"), size % per_shard)
    again = dealt.withColumn("_order", hashed(3)).withColumn("slot", start.cast("long") + in_block - 1)
    return again.select(*rows.columns, F.col("shard").cast("int").alias("shard"), "slot")


def _ends(row: list[int], per_shard: int) -> list[list[int]]:
    """Where each block of each shard ends in a permuted partition."""
    ends, at = [], 0
    for first in range(0, len(row), per_shard):
        ends.append([])
        for n in row[first:first + per_shard]:
            at += n
            ends[-1].append(at)
    return ends


def digest_rows(docs: DataFrame) -> DataFrame:
    """Id, size and checksum of every document; what a manifest of shards holds."""
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
