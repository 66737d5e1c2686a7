"""Operator 1, embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector passes it when their inner product is at least alpha, that is, when the vector lies in
the cap around it. The directions form three random product codes or more: after a random rotation the vector is cut into two
halves, each half has `width` random directions, and every pair of them is one of width * width filters. A vector's filters
are listed from the scores of the halves: first directions that no second one can complete are dropped, the others are
extended. alpha is such that a vector passes FILTERS filters of a code on the average; as rotations treat all directions
alike, that holds for any data. The width grows with the root of the number of vectors, so cells stay small, and wider codes find
a pair less often, so the number of codes grows with the width. At cosine 0.93 and more, two vectors share a filter with
probability 0.97 or more at every width (the tests measure widths of 64 to 8192).

Vectors of a label that share a filter meet in a cell and are verified there by their cosine in double precision. Equal
vectors of a label are one representative with a weight first. Cells of more than CHUNK vectors are cut into chunks, and
each pair of chunks is a task's unit, so that no cell must fit one task and no pair is lost. A pair counts in its first common filter only. Cells return sums of weights
and the edges of local components, never pairs.

A vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor does one with a null
label or id; such rows are their own components (null for a null id). Vectors of different lengths never link. Labels are
of any type and equal or not by a 64-bit hash. Other columns are left out, whatever their names; empty tables give empty
results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.components import connected_components
from tallyspark.session import materialize, wide

CODES = 3
FILTERS = 12
CELL = 64
LEAST_WIDTH = 64
CHUNK = 512
SEED = 20240607


def n_codes(width: int) -> int:
    """CODES up to a width of 256, one more for every two doublings begun from there."""
    doublings = max(0, (width // 256).bit_length() - 1)
    return CODES + (doublings + 1) // 2


class ProductCode:
    """One random product code for vectors of `length` components."""

    def __init__(self, length: int, width: int, number: int):
        rng = np.random.Generator(np.random.PCG64([SEED, length, width, number]))
        self.length, self.width = length, width
        self.padded = max(8, length)
        half = self.padded // 2
        self.rotation = np.linalg.qr(rng.normal(size=(self.padded, self.padded)))[0]
        self.first, self.second = _directions(rng, half, width), _directions(rng, self.padded - half, width)
        self.half = half
        self.alpha = self._alpha(rng)

    def _alpha(self, rng) -> float:
        """The score that FILTERS filters reach for a random vector on the average."""
        trial = rng.normal(size=(512, self.padded))
        a, b = self.scores(trial / np.linalg.norm(trial, axis=1, keepdims=True))
        b = np.sort(b, 1)
        low, high = 0.0, 2.0
        for _ in range(30):
            middle = (low + high) / 2
            passed = sum(self.width * self.width - np.searchsorted(y, middle - x).sum() for x, y in zip(a, b))
            low, high = (middle, high) if passed > FILTERS * len(a) else (low, middle)
        return high

    def scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if unit.shape[1] < self.padded:
            unit = np.pad(unit, ((0, 0), (0, self.padded - unit.shape[1])))
        turned = unit @ self.rotation
        return turned[:, :self.half] @ self.first, turned[:, self.half:] @ self.second

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter a row passes, by row."""
        a, b = self.scores(unit)
        row, i = np.nonzero(a + b.max(1, keepdims=True) >= self.alpha)
        at, j = np.nonzero(b[row] >= self.alpha - a[row, i][:, None])
        return row[at], i[at] * self.width + j


def _directions(rng, size: int, count: int) -> np.ndarray:
    d = rng.normal(size=(size, count))
    return d / np.linalg.norm(d, axis=0) / np.sqrt(2)


def unit_vectors(flat: np.ndarray, length: int) -> np.ndarray:
    v = np.asarray(flat, np.float64).reshape(-1, length)
    # Scaling by the largest component first keeps the squares of extreme values finite.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def filters_of(unit: np.ndarray, codes: list[ProductCode]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) over all codes; filters of different codes are different numbers."""
    rows, cells = [], []
    for number, code in enumerate(codes):
        # Scores of a slice grow with the width.
        step = max(16, min(1024, (1 << 18) // code.width))
        for start in range(0, len(unit), step):
            row, cell = code.decode(unit[start:start + step])
            rows.append(row + start)
            cells.append(cell + number * code.width * code.width)
    return np.concatenate(rows), np.concatenate(cells)


def codes_for(width: int):
    @lru_cache(maxsize=8)
    def codes(length: int) -> list[ProductCode]:
        return [ProductCode(length, width, number) for number in range(n_codes(width))]
    return codes


def same_length(lengths: np.ndarray):
    """(length, rows) for each length in a batch."""
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def cells_of(reps: DataFrame, width: int) -> DataFrame:
    """(id, label, length, cell, vector, weight): a row for every filter that a representative passes."""
    def expand(batches):
        codes = codes_for(width)
        for batch in batches:
            ids, labels, vectors, weights = (batch.column(i) for i in range(4))
            lengths = np.diff(np.asarray(vectors.offsets))
            for length, rows in same_length(lengths):
                part = vectors.take(pa.array(rows))
                row, cell = filters_of(unit_vectors(part.flatten(), length), codes(length))
                for start in range(0, len(row), 4096):
                    some = pa.array(row[start:start + 4096])
                    at = pa.array(rows).take(some)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), labels.take(at), pa.array(np.full(len(some), length, np.int32)),
                         pa.array(cell[start:start + 4096].astype(np.int64)), part.take(some), weights.take(at)],
                        names=["id", "label", "length", "cell", "vector", "weight"])

    kind = reps.schema["vector"].dataType.simpleString()
    return reps.select("id", "label", "vector", "weight").mapInArrow(
        expand, f"id long, label long, length int, cell long, vector {kind}, weight long")


class Cell:
    """The vectors of one pair of chunks; `left` and `right` mark which chunk a row is of."""

    def __init__(self, ids, weights, unit, left, right, same):
        self.ids, self.weights, self.unit, self.left, self.right, self.same = ids, weights, unit, left, right, same

    def links(self, cosine: float, cell: int, codes: list[ProductCode]):
        """(links per row counted here, component number per row)."""
        n = len(self.ids)
        near = self.unit @ self.unit.T >= cosine
        near[np.diag_indices(n)] = False
        if not self.same:
            near &= (self.left[:, None] & self.right) | (self.right[:, None] & self.left)
        touched = np.flatnonzero(near.any(1))
        if not len(touched):
            return np.zeros(n, np.int64), np.arange(n)
        near = near[np.ix_(touched, touched)]
        part = np.arange(len(touched))
        while True:
            better = np.minimum(part, np.where(near, part, len(part)).min(1))
            better = better[better]
            if (better == part).all():
                break
            part = better
        row, passed = filters_of(self.unit[touched], codes)
        earlier = passed < cell
        row, passed = row[earlier], passed[earlier]
        seen, column, often = np.unique(passed, return_inverse=True, return_counts=True)
        shared = often > 1
        keep = shared[column]
        number = np.cumsum(shared) - 1
        marks = np.zeros((len(touched), int(shared.sum())), np.float32)
        marks[row[keep], number[column[keep]]] = 1
        near &= ~(marks @ marks.T > 0)
        counted = np.zeros(n, np.int64)
        counted[touched] = np.where(near, self.weights[touched], 0).sum(1)
        parts = np.arange(n)
        parts[touched] = touched[part]
        return counted, parts


KEYS = ["label", "length", "cell", "first", "second"]
SMALL = 24


def verify_cells(cells: DataFrame, cosine: float, width: int) -> DataFrame:
    """(id, links, other): links counted in a cell, and an id of the same local component, where there are any.

    `cells` is dealt by cell and chunk pair and sorted by them, so that units come as runs. Most units are small and hold
    no near pair; those are told at once for all units of a batch.
    """
    def verify(batches):
        codes = codes_for(width)
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            starts = _starts(held)
            # The last unit may go on in the next batch.
            whole = int(starts[-1])
            if whole:
                yield from _verify_units(held.slice(0, whole), starts, cosine, codes)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _verify_units(held, np.append(_starts(held), held.num_rows), cosine, codes)

    dealt = cells.repartition(wide(cells.sparkSession), *KEYS).sortWithinPartitions(*KEYS, "id")
    return dealt.mapInArrow(verify, "id long, links long, other long")


def _starts(table: pa.Table) -> np.ndarray:
    keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in KEYS])
    return np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])


def _verify_units(table: pa.Table, starts: np.ndarray, cosine: float, codes):
    """The results of whole units, which begin at `starts`; its last entry is the end."""
    table = table.combine_chunks()
    sizes = np.diff(starts)
    keys = {k: table.column(k).to_numpy()[starts[:-1]] for k in KEYS}
    ids, weights, chunk = (table.column(k).to_numpy() for k in ("id", "weight", "chunk"))
    vectors = table.column("vector").combine_chunks()
    for length, units in same_length(keys["length"]):
        units = units[sizes[units] > 1]
        if not len(units):
            continue
        size = sizes[units]
        rows = np.repeat(starts[units] - np.cumsum(size) + size, size) + np.arange(size.sum())
        vector = unit_vectors(vectors.take(pa.array(rows)).flatten(), length)
        unit = np.repeat(np.arange(len(units)), size)
        near = np.zeros(len(units), bool)
        near[size > SMALL] = True
        for apart in range(1, int(size[size <= SMALL].max(initial=1))):
            left = np.flatnonzero((unit[:-apart] == unit[apart:]) & ~near[unit[:-apart]])
            # A little below the limit, as another order of summing may differ in the last digits.
            close = np.einsum("ij,ij->i", vector[left], vector[left + apart]) >= cosine - 1e-9
            near[unit[left[close]]] = True
        ends = np.cumsum(size)
        for u in np.flatnonzero(near):
            mine = slice(ends[u] - size[u], ends[u])
            at = rows[mine]
            first, second = keys["first"][units[u]], keys["second"][units[u]]
            cell = Cell(ids[at], weights[at], vector[mine], chunk[at] == first, chunk[at] == second, first == second)
            counted, parts = cell.links(cosine, int(keys["cell"][units[u]]), codes(length))
            keep = np.flatnonzero((counted > 0) | (parts != np.arange(len(parts))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.ids[keep]), pa.array(counted[keep]), pa.array(cell.ids[parts[keep]])],
                names=["id", "links", "other"])


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`."""
    raw = F.col(vector_col)
    # Single precision is kept as it is, and any other number is taken as a double.
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "double"
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite & F.exists(raw, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("label"),
        raw.cast(f"array<{kind}>").alias("vector"), usable.alias("usable"))
    # Two hashes name a vector; zero of either sign is one value.
    named = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    name = ["label", "name_a", "name_b"]
    named = named.withColumns({"name_a": F.xxhash64("vector"), "name_b": F.xxhash64(F.lit(1), "vector")})
    reps = materialize(
        named.filter("usable").groupBy(*name).agg(
            F.min_by(F.struct("id", "vector"), "id").alias("r"), F.count("*").alias("weight"))
        .select(F.col("r.id").alias("id"), *name, F.col("r.vector").alias("vector"), "weight"), "vectors")
    width = LEAST_WIDTH
    while width * width * CELL < reps.count() * FILTERS:
        width *= 2
    cells = cells_of(reps, width)
    unit = ["label", "length", "cell"]
    large = cells.groupBy(*unit).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    large = materialize(large, "large-cells")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = (
        cells.join(large, unit, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
        .withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"first": F.least("chunk", "other_chunk"), "second": F.greatest("chunk", "other_chunk")})
        .drop("other_chunk", "chunks")
    )
    verified = materialize(verify_cells(dealt, cosine, width), "links")
    counts = verified.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(verified.select(F.col("id").alias("a"), F.col("other").alias("b")).filter("a <> b"))
    of_rep = (
        reps.select("id", *name, "weight").join(counts, "id", "left")
        .join(parts, F.col("id") == F.col("node"), "left")
        .select(*name, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
                F.coalesce("component", "id").alias("component"))
    )
    rows_named = named.select("id", "label", "name_a", "name_b", "usable")
    joined = rows_named.join(of_rep.withColumn("usable", F.lit(True)), [*name, "usable"], "left")
    return joined.select(
        "id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
