"""Operator 9, quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text (word and letter make-up, repetition, punctuation) are moved to a scale on which they are
closer to normal: logarithms for sizes, square roots for shares. For each class Spark sums first and second moments over
all labelled rows; the driver turns them into a mean and a covariance, shrinks the covariance towards its own diagonal
(`shrinkage`) with a floor, and keeps its Cholesky factor. A row's score is the posterior of class 1 from the two
Mahalanobis distances, log determinants and class shares; the log-odds are compressed beyond about 35 so that extreme
documents do not tie at 0 or 1.

Null and empty texts have all statistics 0 and a score like any other. Rows without a label, or with a null label or id,
teach nothing; a document with several labels counts once for each. If only one class has labels, every score is that
class; without labels it is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.words import NOT_BLANK, Words, shingle_sets, slices, text_batches
from tallyspark.session import materialize

NAMES = ("size", "word_length", "length_spread", "upper", "symbols", "same_as_before", "distinct", "bare_marks",
         "odd_ends", "stops", "commas", "lines", "digits", "repeated_trigrams")
THRESHOLD = 0.3
SHRINKAGE = 0.1
FLOOR = 4e-3
CALM = 30
SOFT_LIMIT = 35.0


def _flags(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_UPPER = _flags(bytes(range(65, 91)))
_LETTER = _UPPER | _flags(bytes(range(97, 123)))
_DIGIT = _flags(b"0123456789")
_SOLID = _LETTER | _DIGIT | (np.arange(256) >= 128)
_PROSE = _flags(b".,;:?'\"()-")
_SYMBOL = ~_SOLID & ~_PROSE & (np.arange(256) > 32)


def statistics(words: Words) -> np.ndarray:
    """One row of transformed statistics per text."""
    at, first = words.row_offsets, words.first
    n = np.diff(first).astype(float)

    def in_rows(per_byte: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(per_byte)])[at]).astype(float)

    def of_words(per_word: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(per_word)])[first]).astype(float)

    raw, lengths = words.raw, words.end - words.start
    hashes = words.hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][n > 0]] = False
    solid = np.concatenate([[0], np.cumsum(_SOLID[raw])])
    last = raw[words.end - 1] if len(hashes) else raw[:0]
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], float)
    trigrams = np.array([len(s) for s in shingle_sets(words, 3)], float)
    repeated = np.where(n >= 3, n - 2, np.minimum(n, 1)) - trigrams

    def share(count: np.ndarray, usual: float) -> np.ndarray:
        """Count per word, on the scale of its root; CALM words with the usual count steady short texts."""
        return np.sqrt((count + CALM * usual) / (n + CALM))

    mean = (of_words(lengths) + CALM * 6) / (n + CALM)
    square = (of_words(lengths.astype(float) ** 2) + CALM * 50) / (n + CALM)
    columns = [
        np.log1p(n), np.log(mean), np.log(np.maximum(square - mean**2, 0) + 1),
        share(in_rows(_UPPER[raw]), 0.1), share(in_rows(_SYMBOL[raw]), 0), share(of_words(same), 0),
        np.log((distinct + CALM) / (n + CALM)),
        share(of_words(solid[words.end] == solid[words.start]), 0), share(of_words(_SYMBOL[last]), 0),
        share(in_rows(raw == 46), 0.09), share(in_rows(raw == 44), 0.05), share(in_rows(raw == 10), 0.015),
        share(in_rows(_DIGIT[raw]), 0), share(repeated, 0),
    ]
    return np.stack(columns, 1) * (n > 0)[:, None]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of `docs` with `stats`, an array of doubles in the order of NAMES."""
    kept = [f for f in docs.schema if f.name not in (text_col, "stats")]
    schema = T.StructType([*kept, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            rows = [statistics(w) for _, w in slices(text, NOT_BLANK)]
            values = np.concatenate([np.zeros((0, len(NAMES))), *rows])
            offsets = np.arange(len(values) + 1, dtype=np.int32) * len(NAMES)
            stats = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [stats],
                names=[f.name for f in kept] + ["stats"])

    return text_batches(docs).mapInArrow(measure, schema)


@dataclass(frozen=True)
class Discriminant:
    """Share, mean, inverse Cholesky factor and log determinant of the classes that have labels, by class."""

    classes: dict[int, tuple[float, np.ndarray, np.ndarray, float]]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            only = next(iter(self.classes), None)
            return np.full(len(x), 0.0 if only is None else np.inf if only else -np.inf)
        density = {
            label: np.log(share) - 0.5 * (logdet + (((x - mean) @ inverse.T) ** 2).sum(1))
            for label, (share, mean, inverse, logdet) in self.classes.items()
        }
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = self.log_odds(x)
        with np.errstate(invalid="ignore"):
            odds = np.where(np.isinf(odds), odds, odds / (1 + np.abs(odds) / SOFT_LIMIT))
        return 1 / (1 + np.exp(-odds))


def fit(rows: DataFrame, label: str, stats: str = "stats", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit to all rows whose label is 0 or 1. Only the moments of two classes reach the driver."""
    size = len(NAMES)
    x = [F.get(stats, i) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    moments = rows.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("sums"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("products")).collect()
    total = sum(m["n"] for m in moments)
    classes = {}
    for m in moments:
        mean = np.array(m["sums"]) / m["n"]
        cov = np.zeros((size, size))
        for (i, j), value in zip(pairs, m["products"]):
            cov[i, j] = cov[j, i] = value / m["n"] - mean[i] * mean[j]
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov))
        cov[np.diag_indices(size)] = np.maximum(np.diag(cov), 0) + FLOOR
        root = np.linalg.cholesky(cov)
        classes[int(m["label"])] = (
            m["n"] / total, mean, np.linalg.inv(root), 2 * float(np.log(np.diag(root)).sum()))
    return Discriminant(classes)


def apply(rows: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """`rows` with `score` and `predicted` instead of their statistics."""
    kept = [f for f in rows.schema if f.name not in ("stats", "score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        for batch in batches:
            x = np.asarray(batch.column(batch.schema.get_field_index("stats")).flatten()).reshape(-1, len(NAMES))
            scores = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                + [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[f.name for f in kept] + ["score", "predicted"])

    return rows.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the ids, by hash, that never teaches."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality",
          shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit to the labelled rows that are not held out; only ids and statistics are joined, never texts."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter(~held_out("_id"))
    rows = measured.select(F.col(id_col).alias("_id"), "stats").join(known, "_id")
    return fit(rows, "_label", shrinkage=shrinkage)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    measured = materialize(
        with_statistics(docs.select(F.col(id_col), F.col(text_col).alias("text"))), "statistics")
    model = train(measured, labels, id_col=id_col)
    scored = apply(measured, model, threshold)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score `threshold` or more, with their own columns."""
    measured = with_statistics(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    model = train(measured, labels, id_col=id_col)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    scored = apply(with_statistics(packed), model, threshold)
    return scored.filter("predicted = 1").select("doc.*")
