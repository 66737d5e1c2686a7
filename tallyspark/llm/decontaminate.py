"""Operator 10, benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of `width` consecutive words of a benchmark item; an item with fewer words is one pattern. The
patterns of one length m are searched together:

- every block of two neighbouring words in a pattern has a shift: how far the block is from the pattern's end. A shift
  table indexed by a hash of the block holds the least shift; blocks of no pattern shift by m - 1 words.
- where the shift is 0, the window may end a pattern. A hash of its last words names a bucket of patterns, and the
  window's words are compared with the pattern's directly.

The scan moves many lanes of text through the table at once. A lane owns a stretch of end positions, so every position
is owned once however long the text is. Patterns travel to the tasks in blocks of `block_patterns` windows at most, which
bounds what is broadcast; a larger benchmark takes more passes over the documents.

Nulls and empty texts have no words and no hits. A null item id never counts as an item, and its windows mark words all
the same. Repeated rows are scored each on its own; equal item ids count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.words import ALPHANUMERIC, Words, mix, slices, text_batches

WIDTH = 10
BLOCK_PATTERNS = 1 << 20
LANE = 256
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class PatternTable:
    """Shift table and suffix buckets of patterns that all have `length` words.

    `owners[p]` lists the items of pattern p as positions in `items`.
    """

    def __init__(self, length: int, texts: list[bytes], word_hashes: np.ndarray, owners: list[list[int]]):
        self.length, self.texts, self.owners = length, texts, owners
        self.block = min(2, length)
        self.farthest = length - self.block + 1
        bits = max(12, int(np.ceil(np.log2(len(texts) * length + 1))) + 3)
        self.shift_by = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.farthest, np.int64)
        for i in range(self.farthest):
            at = self._slot(word_hashes[:, i:i + self.block])
            np.minimum.at(self.shift, at, self.farthest - 1 - i)
        suffix = suffix_hash(word_hashes)
        order = np.argsort(suffix, kind="stable")
        self.suffixes, self.pattern_at = suffix[order], order

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (mix(block_sum(blocks)) >> self.shift_by).astype(np.int64)

    def slots(self, word: np.ndarray) -> np.ndarray:
        """Slot of the block that ends at every word; the first words of the batch have none that is used."""
        if self.block == 1:
            return self._slot(word[:, None])
        before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])
        return self._slot(np.stack([before, word], 1))


def block_sum(blocks: np.ndarray) -> np.ndarray:
    total = blocks[:, -1].copy()
    if blocks.shape[1] == 2:
        total += blocks[:, 0] * _SECOND
    return total


def suffix_hash(rows: np.ndarray) -> np.ndarray:
    """Hash of the words of each row, the last three at most."""
    total = np.zeros(len(rows), np.uint64)
    for i in range(min(3, rows.shape[1])):
        total = mix(total + rows[:, -1 - i])
    return total


def windows(column: pa.Array, items: list, width: int) -> dict[int, tuple[list[bytes], np.ndarray, list[list[int]]]]:
    """The distinct patterns of some items by length."""
    found: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    for row, words in slices(column, ALPHANUMERIC):
        word = words.hashes()
        for r in range(words.rows):
            a, b = int(words.first[r]), int(words.first[r + 1])
            length = min(width, b - a)
            for at in range(a, b - length + 1) if length else ():
                entry = found.setdefault(length, {}).setdefault(words.text(at, length), (word[at:at + length], set()))
                if items[row + r] is not None:
                    entry[1].add(row + r)
    return {
        length: (list(patterns), np.array([h for h, _ in patterns.values()], np.uint64).reshape(-1, length),
                 [sorted(o) for _, o in patterns.values()])
        for length, patterns in found.items()
    }


def occurrences(table: PatternTable, words: Words, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence as (last word, pattern), found by moving all lanes through the shift table."""
    none = np.zeros(0, np.int64)
    counts = np.diff(words.first)
    fit = np.flatnonzero(counts >= table.length)
    if not len(fit):
        return none, none
    first_end = words.first[fit] + table.length - 1
    last_end = words.first[fit + 1]
    lanes = -(-(last_end - first_end) // LANE)
    at = np.repeat(first_end, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(at + LANE, np.repeat(last_end, lanes))
    slot = table.slots(word)
    maybe = []
    while len(at):
        step = table.shift[slot[at]]
        maybe.append(at[step == 0])
        at = at + np.maximum(step, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    maybe = np.concatenate(maybe)
    tail = word[maybe[:, None] + np.arange(-min(3, table.length) + 1, 1)] if len(maybe) else np.zeros((0, 1), np.uint64)
    suffix = suffix_hash(tail)
    low, high = np.searchsorted(table.suffixes, suffix, "left"), np.searchsorted(table.suffixes, suffix, "right")
    ends, patterns = [], []
    for k in np.flatnonzero(high > low):
        text = words.text(int(maybe[k]) - table.length + 1, table.length)
        for p in table.pattern_at[low[k]:high[k]]:
            if table.texts[p] == text:
                ends.append(int(maybe[k]))
                patterns.append(int(p))
    return np.array(ends, np.int64), np.array(patterns, np.int64)


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_patterns: int):
    """Tables of `block_patterns` windows at most, with the ids their owners have; items stream through the driver."""
    rows, size = [], 0

    def tables():
        column, ids = pa.array([t for _, t in rows], pa.large_string()), [i for i, _ in rows]
        return [PatternTable(length, *parts) for length, parts in windows(column, ids, width).items()], ids

    for row in benchmark.select(item_col, text_col).toLocalIterator():
        # A text of n characters has n / 2 + 1 words at most.
        most = len(row[1] or "") // 2 + 1
        if rows and size + most > block_patterns:
            yield tables()
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += most
    if rows:
        yield tables()


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", width: int = WIDTH,
                      block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """`docs` with `n_words`, `hit_words` (indexes of the words inside an occurrence, ascending) and `hit_items`
    (ids of the items with occurring windows, as strings, sorted). Columns of the same names are replaced."""
    out = ("n_words", "hit_words", "hit_items")
    marked = docs.drop(*out)
    previous = False
    for tables, ids in pattern_blocks(benchmark, item_col, item_text_col, width, block_patterns):
        marked = _scan(marked, tables, ids, text_col, previous)
        previous = True
    if not previous:
        marked = _scan(marked, [], [], text_col, False)
    return marked


def _scan(docs: DataFrame, tables: list[PatternTable], ids: list, text_col: str, previous: bool) -> DataFrame:
    plain = docs.drop("n_words", "hit_words", "hit_items").schema
    schema = T.StructType([*plain, T.StructField("n_words", T.LongType()),
                           T.StructField("hit_words", T.ArrayType(T.IntegerType())),
                           T.StructField("hit_items", T.ArrayType(T.StringType()))])

    def scan(batches):
        for batch in batches:
            counts, hits, names = [], [], []
            for row, words in slices(batch.column(batch.schema.get_field_index(text_col)), ALPHANUMERIC):
                word = words.hashes()
                found = [(t, *occurrences(t, words, word)) for t in tables]
                hit = np.zeros(len(word), bool)
                items: dict[int, set] = {}
                for table, ends, patterns in found:
                    for back in range(table.length):
                        hit[ends - back] = True
                    rows = np.searchsorted(words.first, ends, "right") - 1
                    for r, p in zip(rows.tolist(), patterns.tolist()):
                        items.setdefault(r, set()).update(table.owners[p])
                for r in range(words.rows):
                    a, b = words.first[r], words.first[r + 1]
                    counts.append(int(b - a))
                    hits.append(np.flatnonzero(hit[a:b]).astype(np.int32))
                    names.append(sorted({str(ids[i]) for i in items.get(r, ())}))
            if previous:
                old_hits = batch.column(batch.schema.get_field_index("hit_words")).to_pylist()
                old_names = batch.column(batch.schema.get_field_index("hit_items")).to_pylist()
                hits = [np.union1d(a, np.array(b, np.int32)).astype(np.int32) for a, b in zip(hits, old_hits)]
                names = [sorted({*a, *b}) for a, b in zip(names, old_names)]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in plain]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                        pa.array(names, pa.list_(pa.string()))],
                names=[f.name for f in plain] + ["n_words", "hit_words", "hit_items"])

    return text_batches(docs).mapInArrow(scan, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    text_col = options.pop("text_col", "text")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    return mark_contaminated(packed, benchmark, **options).filter(F.size("hit_words") == 0).select("doc.*")


def digest(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the item list's hash for every document."""
    return marked.select(
        id_col, F.col("n_words"), F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
