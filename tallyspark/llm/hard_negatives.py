"""Operator 11, hard negatives by an exact inverted multi-index.

Rows are dealt to shards by a hash of their id, so that equal vectors and large labels spread evenly. A shard of at most
about SHARD rows is a task's unit and an inverted multi-index of its own: vectors are cut into two halves, each half has a
codebook (k-means on the shard's first SAMPLE rows in hash order; every row is indexed), and a pair of codewords is a
cell. A half's inner product with a row is at most that with its codeword plus the half's length times the codeword's
radius, the largest distance of a row to it. A multi-sequence heap visits an anchor's cells by the sum of both bounds,
largest first, without listing the others; rows of visited cells are scored exactly. A search stops when its window is
certified: it holds its number of rows, each scoring above every unvisited cell, or the bounds have fallen below it.

Anchors are sent to all shards and stream past the index; each shard returns a few rows an anchor, which are merged. That
is done twice: for an anchor's positives, and then for the windows that the positives' scores open. Nothing is
approximate. Only anchors are copied, once a shard; no row is, and nothing passes through the driver.

Components are first multiplied by `scale` and rounded down; scores are integers and exact, but for those beyond 64 bits,
which count as the largest such number. A row takes part if its id, label and vector are not null, its vector is not empty
and its components are finite. Of rows with one id the smallest by label and vector takes part, so repeated rows count
once. Vectors of different lengths never meet. Ties go to the smaller id. Windows of negative scores are empty, as no
number lies between a share of a negative number and itself. Other columns are left out; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.session import materialize, wide

SHARD = 65_536
SAMPLE = 2_048
CELL = 32
MOST_WORDS = 64
ROUNDS = 4
#: Rows to gather from cells before they are scored together, at first and at most.
FIRST, LAST = 128, 4_096
EXACT = 2.0**53
LARGEST = 2**63 - 1


def quantised(vector: Column, scale: float) -> Column:
    """Whole numbers as doubles, which hold any size."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


class Half:
    """Codewords of one half of the vectors, each row's codeword, and the radius of each codeword."""

    def __init__(self, part: np.ndarray, sample: np.ndarray, size: int):
        self.words = part[sample[:size]].copy()
        trial = part[sample]
        for _ in range(ROUNDS):
            nearest = self._nearest(trial)
            number = np.bincount(nearest, minlength=len(self.words))
            total = np.zeros_like(self.words)
            np.add.at(total, nearest, trial)
            used = number > 0
            self.words[used] = total[used] / number[used, None]
        self.code = self._nearest(part)
        away = np.sqrt(((part - self.words[self.code]) ** 2).sum(1))
        self.radius = np.zeros(len(self.words))
        np.maximum.at(self.radius, self.code, away)

    def _nearest(self, part: np.ndarray) -> np.ndarray:
        square = (self.words**2).sum(1)
        return np.concatenate([
            (square - 2 * (part[a:a + 4096] @ self.words.T)).argmin(1) for a in range(0, len(part), 4096)])

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The most that a row of each codeword can score, rounded up."""
        bound = self.words @ query + self.radius * np.sqrt(query @ query)
        return bound + 1e-9 * (np.abs(bound) + np.abs(self.words) @ np.abs(query) + 1)


class MultiIndex:
    """The rows of a shard by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        n, length = vectors.shape
        self.cut = (length + 1) // 2
        size = int(np.clip(np.sqrt(n / CELL), 1, MOST_WORDS))
        sample = np.random.Generator(np.random.PCG64(11)).permutation(n)[:SAMPLE]
        self.first, self.second = Half(vectors[:, :self.cut], sample, size), Half(vectors[:, self.cut:], sample, size)
        cell = self.first.code * size + self.second.code
        order = np.argsort(cell, kind="stable")
        self.size, self.starts = size, np.searchsorted(cell[order], np.arange(size * size + 1))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.most = float(np.abs(vectors).max())

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of all cells, largest bound first."""
        u, w = self.first.bounds(query[:self.cut]), self.second.bounds(query[self.cut:])
        by_u, by_w = np.argsort(-u, kind="stable"), np.argsort(-w, kind="stable")
        u, w = u[by_u].tolist(), w[by_w].tolist()
        heap = [(-(u[0] + w[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, int(by_u[i]) * self.size + int(by_w[j])
            # Each cell is entered from the one before it in its row, and rows from their first cell.
            if j + 1 < self.size:
                heapq.heappush(heap, (-(u[i] + w[j + 1]), i, j + 1))
            if j == 0 and i + 1 < self.size:
                heapq.heappush(heap, (-(u[i + 1] + w[0]), i + 1, 0))

    def groups(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """(rows, largest score of any row still to come); groups grow from FIRST rows to LAST."""
        held, count, enough = [], 0, FIRST
        for bound, cell in self.cells(query):
            if count >= enough:
                yield np.concatenate(held), bound
                held, count, enough = [], 0, min(2 * enough, LAST)
            a, b = self.starts[cell], self.starts[cell + 1]
            if b > a:
                held.append(np.arange(a, b))
                count += b - a
        if held:
            yield np.concatenate(held), -np.inf

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if len(query) * self.most * float(np.abs(query).max()) < EXACT:
            return (self.vectors[rows] @ query).astype(np.int64)
        whole = [int(x) for x in query]
        exact = (sum(int(x) * q for x, q in zip(row, whole)) for row in self.vectors[rows].tolist())
        return np.array([max(-LARGEST, min(LARGEST, x)) for x in exact], np.int64)

    def top(self, query: np.ndarray, take: int, fits, lows=(-np.inf,), highs=(np.inf,)) -> list[tuple]:
        """(ids, scores) of the `take` best rows that fit, for each window of scores from a low to a high.

        All windows share one visit of the cells, which ends when each is certified.
        """
        lows, highs = np.asarray(lows, float), np.asarray(highs, float)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows, rest in self.groups(query):
            rows = rows[fits(rows)]
            score = self.scores(rows, query)
            near = (score >= lows.min()) & (score <= highs.max())
            if near.any():
                ids, scores = np.append(ids, self.ids[rows[near]]), np.append(scores, score[near])
                order = np.lexsort((ids, -scores))
                ids, scores = ids[order], scores[order]
                # Of the rows by falling score, a window can need the first few from its high on.
                begin = np.searchsorted(-scores, -highs)
                kept = np.unique((begin[:, None] + np.arange(take)).ravel())
                kept = kept[kept < len(ids)]
                ids, scores = ids[kept], scores[kept]
            sure = ((scores[:, None] <= highs) & (scores[:, None] > rest)).sum(0) >= take
            if (sure | (rest < lows)).all():
                break
        out = []
        for low, high in zip(lows, highs):
            inside = np.flatnonzero((scores >= low) & (scores <= high))[:take]
            out.append((ids[inside], scores[inside]))
        return out


def least_score(high: int, low_percent: int) -> int:
    """The smallest whole score that is `low_percent` of `high` or more."""
    return -((-low_percent * high) // 100)


def answer(index: MultiIndex, anchor: int, label: int, query: np.ndarray, highs, take: int, low_percent: int):
    """(window, ids, scores): the best rows of the anchor's label, or of the other labels for each window."""
    if highs is None:
        (ids, scores), = index.top(query, take, lambda r: (index.labels[r] == label) & (index.ids[r] != anchor))
        yield 0, ids, scores
        return
    windows = [(least_score(high, low_percent), high) for high in highs]
    windows = [w for w in windows if w[0] <= w[1]]
    if windows:
        found = index.top(query, take, lambda r: index.labels[r] != label, *zip(*windows))
        for (_, high), (ids, scores) in zip(windows, found):
            yield high, ids, scores


COLUMNS = ["shard", "length", "kind", "id", "label", "vector", "highs"]
FOUND = "anchor_id long, high long, id long, score long"


def search(rows: DataFrame, anchors: DataFrame, shards: int, take: int, low_percent: int) -> DataFrame:
    """FOUND rows of each shard for (id, label, vector, highs) of `anchors`; null highs ask for the same label."""
    own = rows.withColumns({
        "shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "kind": F.lit(0),
        "highs": F.lit(None).cast("array<long>")})
    asked = anchors.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "kind": F.lit(1)})
    both = own.withColumn("length", F.size("vector")).select(*COLUMNS).union(
        asked.withColumn("length", F.size("vector")).select(*COLUMNS))

    def run(batches):
        unit, held, index = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if b == a:
                    continue
                if tuple(keys[:2, a]) != unit:
                    unit, held, index = tuple(keys[:2, a]), [], None
                part = batch.slice(a, b - a)
                if keys[2, a] == 0:
                    held.append(part)
                    continue
                if held:
                    index, held = _index(held, int(unit[1])), []
                if index is not None:
                    yield from _answers(index, part, int(unit[1]), take, low_percent)

    dealt = both.repartition(shards, "shard").sortWithinPartitions(*COLUMNS[:-1])
    return dealt.mapInArrow(run, FOUND)


def _vectors(part: pa.RecordBatch, length: int) -> np.ndarray:
    return np.asarray(part.column(5).flatten()).reshape(-1, length)


def _index(parts: list[pa.RecordBatch], length: int) -> MultiIndex:
    ids, labels = (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in (3, 4))
    vectors = np.concatenate([_vectors(p, length) for p in parts])
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return MultiIndex(ids[first], labels[first], vectors[first])


def _answers(index: MultiIndex, part: pa.RecordBatch, length: int, take: int, low_percent: int):
    ids, labels, highs = np.asarray(part.column(3)), np.asarray(part.column(4)), part.column(6).to_pylist()
    for i, query in enumerate(_vectors(part, length)):
        found = [(np.full(len(got), high), got, scores) for high, got, scores in answer(
            index, int(ids[i]), int(labels[i]), query, highs[i], take, low_percent) if len(got)]
        if found:
            high, got, scores = (np.concatenate(c).astype(np.int64) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(got), ids[i])), pa.array(high), pa.array(got), pa.array(scores)],
                names=["anchor_id", "high", "id", "score"])


def _best(found: DataFrame, take: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= take)


def mine(vectors: DataFrame, *, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", scale: float = 256, positives: int = 5, negatives: int = 5,
         low_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the `positives` best other rows of its label. For each, the `negatives` best rows of other
    labels that score at least `low_percent` of the positive's score and at most that score. `is_anchor` is a condition
    on the columns of `vectors`.
    """
    raw = F.col(vector_col)
    usable = (
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(raw) > 0)
        & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = materialize(vectors.filter(usable).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        quantised(raw, scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "quantised")
    anchors = rows.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    rows = rows.drop("anchor")
    shards = max(wide(vectors.sparkSession), -(-rows.count() // SHARD))
    near = search(rows, anchors.withColumn("highs", F.lit(None).cast("array<long>")), shards, positives, low_percent)
    near = materialize(_best(near, positives, ["anchor_id"]).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("highs"))
    far = search(rows, anchors.join(windows, "id"), shards, negatives, low_percent)
    far = _best(far, negatives, ["anchor_id", "high"]).select(
        "anchor_id", F.col("high").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
