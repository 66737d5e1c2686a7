"""Operator 12, toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of ASCII letters in lower case, digits and all characters beyond ASCII) by a 64-bit hash. The
vocabulary is the TERMS words whose presence depends most on the label, by chi-square over all labelled texts that may
teach, of those with LEAST_CHI or more (five deviations); ties go to the smaller hash. A text's vector holds (1 + log count) * log(1 + documents / documents with the term),
counted over all documents, and has length one. Vectors hold few terms and are stored once; all later steps read them.

Examples are distinct vectors of teaching rows, with the smallest id of each: a bounded sample of at most EXAMPLES / 2 for
each label, the first by a hash of the id. So the index is bounded too, by EXAMPLES * TERMS postings, and goes to every
task. It keeps, for each term, postings by blocks of BLOCK examples, and the largest weight in each block. For a text,
these maxima bound the cosine with any example of a block; blocks are scored by falling bound until none can hold one of
the NEAREST examples, so neighbours are exact; ties go to the smaller place in the index. An example is never its own
neighbour.

Neighbours vote by their squared cosine, with a steadying vote for the share of toxic texts; a text without any term has
just that. A logistic curve over the votes of all teaching rows, each without itself, turns them into probabilities. The
neighbours are returned as evidence.

Null and empty texts have a score like any other. Rows without an id, a label of 0 or 1 or a partner teach nothing; a
document with several labels counts once for each. If only one class has labels, every score is that class; without labels
it is 0. One row out per row in, also for repeated ids. Columns other than id and text are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.words import ALPHANUMERIC, slices, text_batches
from tallyspark.session import materialize

TERMS = 512
LEAST_CHI = 25.0
EXAMPLES = 4_096
BLOCK = 64
NEAREST = 15
THRESHOLD = 0.5
#: The steadying vote, in squared cosines.
STEADY = 0.3
BINS = 400
#: Counted terms that a task holds before it hands them on.
HELD_TERMS = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the ids, by hash, that never teaches."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _row_terms(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of some texts, by row and term."""
    hashes = words.hashes().view(np.int64)
    row = np.repeat(np.arange(words.rows), np.diff(words.first))
    terms, which = np.unique(hashes, return_inverse=True)
    code, count = np.unique(row * max(1, len(terms)) + which, return_counts=True)
    return code // max(1, len(terms)), terms[code % max(1, len(terms))], count


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, n, ones): labelled texts that hold a term, and those of label 1 among them, over `rows` (text, label)."""
    def count(batches):
        held = [np.zeros((3, 0), np.int64)]
        for batch in batches:
            label = np.asarray(batch.column(1), np.int64)
            for at, words in slices(batch.column(0), ALPHANUMERIC):
                row, term, _ = _row_terms(words)
                held.append(np.stack([term, np.ones(len(term), np.int64), label[at + row]]))
            if sum(h.shape[1] for h in held) > HELD_TERMS:
                held = [_summed(held)]
                if held[0].shape[1] > HELD_TERMS // 2:
                    yield from _batches(held.pop())
                    held = [np.zeros((3, 0), np.int64)]
        yield from _batches(_summed(held))

    def _summed(parts):
        every = np.concatenate(parts, 1)
        term, which = np.unique(every[0], return_inverse=True)
        n, ones = (np.bincount(which, weights=c, minlength=len(term)).astype(np.int64) for c in every[1:])
        return np.stack([term, n, ones])

    def _batches(counts):
        for a in range(0, counts.shape[1], 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 65_536]) for c in counts], names=["term", "n", "ones"])

    counted = text_batches(rows.select("text", "label")).mapInArrow(count, "term long, n long, ones long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def telling_terms(rows: DataFrame, n_rows: int, n_ones: int, take: int = TERMS) -> np.ndarray:
    """The `take` terms with the largest chi-square against the label, ascending; few texts are no evidence."""
    a = F.col("ones").cast("double")
    b = F.col("n") - a
    c, d = F.lit(float(n_ones)) - a, F.lit(float(n_rows - n_ones)) - b
    chi = F.try_divide(n_rows * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))
    best = term_counts(rows).select("term", chi.alias("chi")).filter(F.col("chi") >= LEAST_CHI).orderBy(
        F.desc("chi"), "term").limit(take)
    return np.sort(np.array([r.term for r in best.collect()], np.int64))


def with_vectors(docs: DataFrame, terms: np.ndarray, id_col: str) -> DataFrame:
    """(id, terms, counts) of every text: places in `terms`, ascending, and how often they occur."""
    schema = T.StructType([
        docs.schema[id_col], T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def measure(batches):
        for batch in batches:
            row, place, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, words in slices(batch.column(1), ALPHANUMERIC):
                r, term, n = _row_terms(words)
                spot = np.searchsorted(terms, term)
                known = np.flatnonzero(terms[np.minimum(spot, len(terms) - 1)] == term) if len(terms) else spot[:0]
                row.append(at + r[known]), place.append(spot[known]), count.append(n[known])
            number = np.bincount(np.concatenate(row), minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c).astype(np.int32))) for c in (place, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=schema.names)

    return text_batches(docs.select(id_col, "text")).mapInArrow(measure, schema)


def _spread(start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place) for number[i] places from start[i] on."""
    i = np.repeat(np.arange(len(start)), number)
    return i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(number) - number, number)


class Vectors:
    """Sparse TF-IDF vectors of length one."""

    def __init__(self, terms: pa.ListArray, counts: pa.ListArray, idf: np.ndarray):
        self.offsets = np.asarray(terms.offsets, np.int64) - terms.offsets[0].as_py()
        self.term = np.asarray(terms.flatten(), np.int64)
        weight = (1 + np.log(np.asarray(counts.flatten(), np.float64))) * idf[self.term]
        self.row = np.repeat(np.arange(len(terms)), np.diff(self.offsets))
        square = np.bincount(self.row, weights=weight**2, minlength=len(terms))
        self.weight = weight / np.sqrt(square)[self.row]


class BlockMaxIndex:
    """Postings of the examples by term and block, with the largest weight of each term in each block."""

    def __init__(self, terms: pa.ListArray, counts: pa.ListArray, idf: np.ndarray):
        vectors = Vectors(terms, counts, idf)
        self.idf, self.examples = idf, len(terms)
        self.blocks = -(-self.examples // BLOCK)
        order = np.lexsort((vectors.row, vectors.term))
        self.example, self.weight = vectors.row[order], vectors.weight[order]
        slot = vectors.term[order] * self.blocks + self.example // BLOCK
        self.starts = np.searchsorted(slot, np.arange(len(idf) * self.blocks + 1))
        most = np.zeros(len(idf) * self.blocks)
        np.maximum.at(most, slot, self.weight)
        self.most = most.reshape(len(idf), self.blocks)

    def _score(self, vectors: Vectors, rows: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of each row with the BLOCK examples of its block."""
        pair, at = _spread(vectors.offsets[rows], vectors.offsets[rows + 1] - vectors.offsets[rows])
        slot = vectors.term[at] * self.blocks + blocks[pair]
        which, posting = _spread(self.starts[slot], self.starts[slot + 1] - self.starts[slot])
        place = pair[which] * BLOCK + self.example[posting] % BLOCK
        return np.bincount(place, weights=vectors.weight[at[which]] * self.weight[posting],
                           minlength=len(rows) * BLOCK).reshape(len(rows), BLOCK)

    def nearest(self, vectors: Vectors, own: np.ndarray, take: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the `take` nearest examples of each row, best first; cosine 0 where there are fewer.

        `own` is the row's own place among the examples, or -1.
        """
        n = len(vectors.offsets) - 1
        best, cosine = np.full((n, take), self.examples), np.zeros((n, take))
        if not self.blocks or not n:
            return best, cosine
        dense = np.zeros((n, len(self.idf)))
        dense[vectors.row, vectors.term] = vectors.weight
        bound = dense @ self.most
        order = np.argsort(-bound, axis=1, kind="stable")
        at, step = 0, 1
        active = np.arange(n)
        while at < self.blocks and len(active):
            blocks = order[active, at:at + step]
            width = blocks.shape[1]
            # A little below the worst kept, as sums in another order may differ in the last digits.
            worth = bound[active[:, None], blocks]
            open_ = (worth > 0) & (worth >= cosine[active, -1:] - 1e-9)
            going = open_.any(1)
            active, blocks, open_ = active[going], blocks[going], open_[going]
            if not len(active):
                break
            row, column = np.nonzero(open_)
            scores = np.zeros((len(active), width, BLOCK))
            scores[row, column] = self._score(vectors, active[row], blocks[row, column])
            example = blocks[:, :, None] * BLOCK + np.arange(BLOCK)
            scores[example == own[active, None, None]] = 0
            scores, example = (np.concatenate([old, new.reshape(len(active), -1)], 1) for old, new in (
                (cosine[active], scores), (best[active], example)))
            top = np.lexsort((example, -scores), axis=1)[:, :take]
            best[active], cosine[active] = np.take_along_axis(example, top, 1), np.take_along_axis(scores, top, 1)
            at, step = at + step, min(2 * step, 16)
        return best, cosine


@dataclass(frozen=True)
class Model:
    """The index, its examples' ids and labels, the share of label 1, and the curve that calibrates votes."""

    index: BlockMaxIndex
    ids: list
    labels: np.ndarray
    share: float
    slope: float = 1.0
    shift: float = 0.0

    def neighbours(self, ids: pa.Array, terms: pa.ListArray, counts: pa.ListArray):
        number = {x: i for i, x in enumerate(self.ids)}
        own = np.array([number.get(x, -1) for x in ids.to_pylist()], np.int64)
        return self.index.nearest(Vectors(terms, counts, self.index.idf), own)

    def votes(self, example: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        weight = cosine**2
        ones = np.append(self.labels, 0)[example]
        return ((weight * ones).sum(1) + STEADY * self.share) / (weight.sum(1) + STEADY)

    def score(self, votes: np.ndarray) -> np.ndarray:
        if not 0 < self.share < 1:
            return np.full(len(votes), float(self.share))
        odds = np.log(votes / (1 - votes))
        return 1 / (1 + np.exp(-(self.slope * odds + self.shift)))


def _curve(votes: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the votes' log-odds, held near slope one; targets stay off 0 and 1."""
    odds = np.log(votes / (1 - votes))
    total = ones + zeros
    target = (ones * (ones.sum() + 1) / (ones.sum() + 2) + zeros / (zeros.sum() + 2)) / np.maximum(total, 1)
    x = np.stack([odds, np.ones(len(odds))])
    found = np.array([1.0, 0.0])
    pull = np.array([1.0, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(found @ x, -500, 500)))
        gradient = x @ (total * (p - target)) + pull * (found - [1.0, 0.0])
        curvature = (x * (total * p * (1 - p))) @ x.T + np.diag(pull)
        step = np.linalg.solve(curvature, gradient)
        found = found - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(max(found[0], 1e-3)), float(found[1])


def _voted(vectors: DataFrame, model: Model, id_col: str) -> DataFrame:
    """`vectors` (id, terms, counts, label) as (votes, label), votes in BINS steps."""
    def run(batches):
        for batch in batches:
            example, cosine = model.neighbours(*(batch.column(i) for i in range(3)))
            votes = np.round(model.votes(example, cosine) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(votes), batch.column(3)], names=["votes", "label"])

    return vectors.select(id_col, "terms", "counts", "label").mapInArrow(run, "votes long, label int")


def document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; a task hands on one number a term."""
    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=n_terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms)), pa.array(total)], names=["term", "n"])

    found = np.zeros(n_terms, np.int64)
    counted = vectors.select("terms").mapInArrow(count, "term long, n long")
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[r.term] = r.n
    return found


def fit(vectors: DataFrame, known: DataFrame, n_terms: int, n_rows: int, n_ones: int, id_col: str) -> Model:
    """The model of stored `vectors` of all documents and `known` (id, label), of which `n_rows` and `n_ones` matter."""
    n_docs = vectors.count()
    idf = np.log1p(n_docs / np.maximum(document_counts(vectors, n_terms), 1))
    labelled = vectors.join(known, id_col)
    distinct = labelled.filter(F.size("terms") > 0).groupBy("terms", "counts", "label").agg(F.min(id_col).alias(id_col))
    chosen = []
    for label in (0, 1):
        chosen += distinct.filter(F.col("label") == label).orderBy(F.xxhash64(id_col), id_col).limit(EXAMPLES // 2).collect()
    # Alike examples share blocks, which keeps the bounds of the others low.
    chosen.sort(key=lambda r: (max(r.terms, key=lambda t: (idf[t], t)), str(r[id_col]), r.label))
    kind = pa.list_(pa.int32())
    index = BlockMaxIndex(pa.array([r.terms for r in chosen], kind), pa.array([r.counts for r in chosen], kind), idf)
    share = n_ones / n_rows if n_rows else 0.0
    model = Model(index, [r[id_col] for r in chosen], np.array([r.label for r in chosen], np.int64), share)
    if not 0 < share < 1:
        return model
    voted = _voted(labelled, model, id_col).groupBy("votes").agg(
        F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros")).orderBy("votes").collect()
    votes = np.clip(np.array([r.votes for r in voted]) / BINS, 0.5 / BINS, 1 - 0.5 / BINS)
    slope, shift = _curve(votes, np.array([r.ones for r in voted], float), np.array([r.zeros for r in voted], float))
    return Model(index, model.ids, model.labels, share, slope, shift)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted, evidence) for every document; evidence has (id, cosine, label), nearest first."""
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & ~held_out(id_col))
    # Labels grow with the documents, so texts and labels meet by a shuffle at every size; that is done once.
    taught = docs.filter(~held_out(id_col)).join(known.hint("merge"), id_col).select("text", "label")
    n_rows, n_ones = docs.select(id_col).join(known, id_col).agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    terms = telling_terms(taught, n_rows, n_ones)
    vectors = materialize(with_vectors(docs, terms, id_col), "vectors")
    model = fit(vectors, known, len(terms), n_rows, n_ones, id_col)
    return apply(vectors, model, id_col, threshold)


def apply(vectors: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    one = T.StructType([
        T.StructField("id", vectors.schema[id_col].dataType), T.StructField("cosine", T.DoubleType()),
        T.StructField("label", T.IntegerType())])
    schema = T.StructType([
        vectors.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(one))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            example, cosine = model.neighbours(ids, batch.column(1), batch.column(2))
            score = model.score(model.votes(example, cosine))
            near = cosine > 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32))
            picked = example[near]
            evidence = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                [pa.array([model.ids[i] for i in picked], ids.type), pa.array(cosine[near]),
                 pa.array(model.labels[picked].astype(np.int32))], names=["id", "cosine", "label"]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(score), pa.array((score >= threshold).astype(np.int32)), evidence], names=schema.names)

    scored = vectors.select(id_col, "terms", "counts").mapInArrow(run, schema)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
