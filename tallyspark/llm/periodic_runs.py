"""Operator 13, periodic runs of words, found on a grammar of each text.

The distinct words of a text are numbered and compressed by Re-Pair: the most frequent pair of neighbouring symbols becomes
a new symbol until no pair occurs twice. Pairs that do not overlap are replaced in the same round; of two that do, the
more frequent one goes first, and ties are broken in an arbitrary fixed order. What is left at the end is joined by a
balanced tree, so that every stretch of two words or more crosses the boundary of one symbol in which it lies whole.

For each symbol the runs across its boundary are computed once. At least half of such a run, and so twelve words and one
and a half periods, lies on one side; hence the GRAM words next to the boundary on that side recur one period further on.
Every such recurrence is a candidate, extended in both directions word by word. A candidate that is a multiple of a found
period and lies in that run is the same run and is left out. The runs of a symbol are then moved to all places where the
symbol stands in the text. A run cut off by the symbol's ends is part of one that a larger symbol holds, so stretches of
one period that overlap by the period are merged. Of several periods of one stretch, the smallest is kept.

All texts of a batch are worked on together by NumPy; a text is never split, and no task holds more than a batch.

Words are bytes outside x20 and x09-x0D, compared as they are. A null or empty text has no words and no runs; a null id,
repeated ids and equal rows are kept as they are, one row out per row in. Other columns pass through, but for those named
like the result's. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.words import text_batches

LEAST = 24
REPEATS = 3
GRAM = 4
#: A batch of rows is worked on in parts of about this many words, or of one text.
WORDS = 1 << 17
#: Words compared at once when candidates are extended.
COMPARED = 1 << 20
BLANKS = r"[^\x20\x09-\x0D]+"

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = {"n_words": T.LongType(), "runs": T.ArrayType(RUN), "collapsed": T.StringType()}


def word_lists(column: pa.Array) -> pa.ListArray:
    """The words of every text; null has none."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    pieces = pc.ascii_split_whitespace(text)
    flat = pieces.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    offsets = np.asarray(pieces.offsets, np.int64)
    kept = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    return pa.LargeListArray.from_arrays(pa.array(kept), flat.filter(pa.array(real)))


class Found:
    """Runs found so far, as columns: first word in the batch, end, period."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        if len(start):
            self.parts.append(np.stack([start, end, period]))

    def merged(self, text_of: np.ndarray) -> np.ndarray:
        """Maximal runs by start and period, each with its smallest period."""
        if not self.parts:
            return np.zeros((3, 0), np.int64)
        start, end, period = np.unique(np.concatenate(self.parts, 1), axis=1)
        order = np.lexsort((start, period, text_of[start]))
        start, end, period = start[order], end[order], period[order]
        text = text_of[start]
        # The furthest end so far of the same text and period, which come in ascending groups.
        new_group = np.ones(len(start), bool)
        new_group[1:] = (text[1:] != text[:-1]) | (period[1:] != period[:-1])
        base = np.cumsum(new_group) * (len(text_of) + 1)
        reach = np.maximum.accumulate(end + base) - base
        begins = new_group.copy()
        begins[1:] |= start[1:] > reach[:-1] - period[1:]
        first = np.flatnonzero(begins)
        start, period, end = start[first], period[first], np.maximum.reduceat(end, first)
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        keep = np.ones(len(start), bool)
        keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[keep], end[keep], period[keep]
        order = np.lexsort((period, start))
        return np.stack([start, end, period])[:, order]


def agreeing(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, sign: int) -> np.ndarray:
    """How many words from a and from b on agree, at most `limit`, going up (sign 1) or down (-1)."""
    count = np.zeros(len(a), np.int64)
    active, step = np.flatnonzero(limit > 0), 8
    while len(active):
        goes_on = []
        size = max(1, COMPARED // step)
        for at in range(0, len(active), size):
            some = active[at:at + size]
            offset = np.minimum(count[some, None] + np.arange(step), limit[some, None] - 1) * sign
            same = words[a[some, None] + offset] == words[b[some, None] + offset]
            run = np.where(same.all(1), step, same.argmin(1))
            count[some] = np.minimum(count[some] + run, limit[some])
            goes_on.append(some[(run == step) & (count[some] < limit[some])])
        active, step = np.concatenate(goes_on), min(2 * step, 4096)
    return count


class Grams:
    """Places of every GRAM of words within its text."""

    def __init__(self, words: np.ndarray, text_of: np.ndarray):
        self.n = n = len(words)
        self.key = np.full(n, -1)
        count = n - GRAM + 1
        if count > 0:
            rank = words
            for width in (1, 2):
                _, rank = np.unique(rank[:-width] * (rank.max() + 1) + rank[width:], return_inverse=True)
            inside = text_of[:count] == text_of[GRAM - 1:]
            key = rank * (text_of[-1] + 1) + text_of[:count]
            self.key[:count][inside] = key[inside]
        places = np.flatnonzero(self.key >= 0)
        self.sorted = np.sort(self.key[places] * n + places)

    def others(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, place): places from low[i] to before high[i] with the gram at at[i]; `at` needs a gram."""
        base = self.key[at] * self.n
        first = np.searchsorted(self.sorted, base + low)
        number = np.maximum(np.searchsorted(self.sorted, base + high) - first, 0)
        i = np.repeat(np.arange(len(at)), number)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(number) - number, number)
        return i, self.sorted[first[i] + nth] % self.n


def crossing(words: np.ndarray, grams: Grams, s: np.ndarray, m: np.ndarray, e: np.ndarray, least: int,
             repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, start, end, period) of the runs in words s[i] to e[i] next to or across the boundary before m[i]."""
    longest = (e - s) // repeats
    found = []
    for right in (True, False):
        seed = m if right else m - GRAM
        fits = np.flatnonzero((m + GRAM <= e) if right else (seed >= s))
        at = seed[fits]
        low = at + 1 if right else np.maximum(s[fits], at - longest[fits])
        high = np.minimum(e[fits] - GRAM, at + longest[fits]) + 1 if right else at
        i, place = grams.others(at, low, high)
        period = np.abs(place - at[i])
        i = fits[i]
        order = np.lexsort((period, i))
        i, period, first = i[order], period[order], np.minimum(place, seed[i])[order] if right else place[order]
        if right:
            first = seed[i]
        wave = 1
        while len(i):
            begins = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            nth = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
            now = nth < wave
            j, q, f = i[now], period[now], first[now]
            start = f - agreeing(words, f - 1, f + q - 1, f - s[j], -1)
            end = f + GRAM + q + agreeing(words, f + GRAM, f + GRAM + q, e[j] - f - GRAM - q, 1)
            good = end - start >= np.maximum(least, repeats * q)
            j, q, start, end = j[good], q[good], start[good], end[good]
            found.append((j, start, end, q))
            i, period, first = i[~now], period[~now], first[~now]
            # Multiples of a symbol's smallest period found in this wave that lie in its run are that run.
            owner, at_j = np.unique(j, return_index=True)
            known = np.searchsorted(owner, i)
            known[known == len(owner)] = 0
            if len(owner):
                k = at_j[known]
                inside = m[i] + period < end[k] if right else m[i] - 1 - period >= start[k]
                again = (j[k] == i) & inside & (period % q[k] == 0)
                i, period, first = i[~again], period[~again], first[~again]
            wave *= 2
    i, start, end, period = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((period, end, start, i))
    i, start, end, period = i[order], start[order], end[order], period[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return i[new], start[new], end[new], period[new]


class Sequence:
    """Symbols of some texts, with the first word and the text of each; a symbol goes to the next one's first word."""

    def __init__(self, symbol: np.ndarray, first: np.ndarray, text: np.ndarray):
        self.symbol, self.first, self.text = symbol, first, text

    def take(self, keep: np.ndarray) -> Sequence:
        return Sequence(self.symbol[keep], self.first[keep], self.text[keep])

    def ends(self, text_end: np.ndarray) -> np.ndarray:
        end = text_end[self.text]
        inner = self.text[:-1] == self.text[1:]
        end[:-1][inner] = self.first[1:][inner]
        return end

    def pairs(self) -> np.ndarray:
        """Which symbols begin a pair; of equal symbols in a row every second one does."""
        index = np.arange(len(self.symbol))
        begins = np.ones(len(index), bool)
        begins[1:] = self.symbol[1:] != self.symbol[:-1]
        odd = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 1
        pair = np.zeros(len(index), bool)
        equal = self.symbol[:-1] == self.symbol[1:]
        pair[:-1] = (self.text[:-1] == self.text[1:]) & ~(equal & odd[:-1])
        return pair


def replaced_pairs(sequence: Sequence, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(places, rule number): the pairs to replace in this round; none if no pair occurs twice."""
    place = np.flatnonzero(sequence.pairs())
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(place):
        return none
    code = sequence.symbol[place] * (int(sequence.symbol.max()) + 1) + sequence.symbol[place + 1]
    distinct, which, often = np.unique(code, return_inverse=True, return_counts=True)
    rank = np.zeros(len(sequence.symbol) + 1, np.int64)
    rank[place] = np.where(often[which] > 1, often[which] * len(distinct) + rng.permutation(len(distinct))[which], 0)
    here = rank[place]
    wins = (here > 0) & (here > rank[place + 1]) & (here > rank[place - 1])
    place, which = place[wins], which[wins]
    kept = np.bincount(which, minlength=len(distinct)) > 1
    place, which = place[kept[which]], which[kept[which]]
    return (place, (np.cumsum(kept) - 1)[which]) if len(place) else none


def runs_of(words: np.ndarray, offsets: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows start, end and period of all runs, in words of the batch; words are numbers, `offsets` those of the texts."""
    found = Found()
    words = np.asarray(words, np.int64)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(words):
        return found.merged(text_of)
    grams = Grams(words, text_of)
    text_end = offsets[1:]
    rng = np.random.Generator(np.random.PCG64(13))
    # A word is another symbol in every text, so pairs of different texts never meet.
    _, symbol = np.unique(text_of * (words.max() + 1) + words, return_inverse=True)
    sequence = Sequence(symbol.astype(np.int64), np.arange(len(words)), text_of)
    symbols, finished = int(symbol.max()) + 1, []

    def cross(s, m, e, owner, places):
        """Runs of the symbols of s, m, e, moved from s[owner] to all their places."""
        i, start, end, period = crossing(words, grams, s, m, e, least, repeats)
        if not len(i):
            return
        order = np.argsort(owner, kind="stable")
        number = np.bincount(owner, minlength=len(s))
        begin = np.cumsum(number) - number
        times = number[i]
        run = np.repeat(np.arange(len(i)), times)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        shift = places[order[begin[i[run]] + nth]] - s[i[run]]
        found.add(start[run] + shift, end[run] + shift, period[run])

    while len(sequence.symbol):
        place, rule = replaced_pairs(sequence, rng)
        busy = np.zeros(len(offsets) - 1, bool)
        busy[sequence.text[place]] = True
        mine = busy[sequence.text]
        finished.append(sequence.take(~mine))
        if not len(place):
            break
        end = sequence.ends(text_end)
        _, at = np.unique(rule, return_index=True)
        s, m, e = sequence.first[place[at]], sequence.first[place[at] + 1], end[place[at] + 1]
        long = e - s >= least
        if long.any():
            number = np.cumsum(long) - 1
            of_long = long[rule]
            cross(s[long], m[long], e[long], number[rule[of_long]], sequence.first[place[of_long]])
        sequence.symbol[place] = symbols + rule
        symbols += int(rule.max()) + 1
        mine[place + 1] = False
        sequence = sequence.take(mine)

    order = np.argsort(np.concatenate([f.first for f in finished]), kind="stable")
    first, text = (np.concatenate([getattr(f, c) for f in finished])[order] for c in ("first", "text"))
    while True:
        rest = Sequence(first, first, text)
        end = rest.ends(text_end)
        begins = np.searchsorted(text, text)
        odd = (np.arange(len(text)) - begins) % 2 == 1
        right = np.flatnonzero(odd)
        if not len(right):
            break
        s, m, e = first[right - 1], first[right], end[right]
        long = e - s >= least
        cross(s[long], m[long], e[long], np.arange(int(long.sum())), s[long])
        first, text = first[~odd], text[~odd]
    return found.merged(text_of)


def collapsed_words(offsets: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    start, end, period = runs
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:-1] == 0


def _measure(texts: pa.Array, least: int, repeats: int) -> list[pa.Array]:
    """n_words, runs and collapsed of some whole texts."""
    lists = word_lists(texts)
    offsets = np.asarray(lists.offsets, np.int64)
    flat = lists.flatten()
    number = np.asarray(flat.dictionary_encode().indices)
    runs = runs_of(number, offsets, least, repeats)
    row = np.searchsorted(offsets, runs[0], "right") - 1
    per_row = np.cumsum(np.bincount(row, minlength=len(texts)))
    run_lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], per_row]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(runs[0] - offsets[row]), pa.array(runs[1] - runs[0]), pa.array(runs[2])],
                                   names=RUN.names))
    keep = collapsed_words(offsets, runs)
    kept_offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kept = pa.ListArray.from_arrays(pa.array(kept_offsets.astype(np.int32)), flat.filter(pa.array(keep)).cast(pa.string()))
    return [pa.array(np.diff(offsets)), run_lists, pc.binary_join(kept, " ")]


def find_runs(docs: DataFrame, *, text_col: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """The other columns of `docs` with n_words, runs (start, length, period; by start, then period) and collapsed.

    A run is a stretch of at least `least` words and `repeats` periods that no neighbouring word extends. `collapsed` is
    the text without the words that a run holds after its first period, words joined by one blank. `least` must be 24 or
    more and `repeats` 3 or more, for which the search by GRAM words is exact.
    """
    if least < 24 or repeats < 3:
        raise ValueError("runs shorter than 24 words or three periods are not searched")
    kept = [f for f in docs.schema if f.name != text_col and f.name not in RESULT]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in RESULT.items()]])

    def measure(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            size = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
            # About six bytes a word.
            part = np.concatenate([[0], np.cumsum(size)]) // (6 * WORDS)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(size)]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(f.name)) for f in kept]
                    + _measure(text.slice(a, b - a), least, repeats), names=schema.names)

    return text_batches(docs).mapInArrow(measure, schema)


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per document the number of runs, the strongest one and digests of all runs and of the collapsed text.

    The strongest run has the greatest length by period; of equal ones the first, then that of the smallest period. Two
    different fractions of word counts are never the same double.
    """
    def key(r: Column) -> Column:
        return F.struct((-r["length"] / r["period"]).alias("weak"), r["start"], r["period"], r["length"])

    best = F.array_min(F.transform("runs", key))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` where the tail of about every tenth text, by the hash of its id, repeats its first words over and over."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.regexp_extract_all(text_col, F.lit(BLANKS), 0)
    chosen = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)).cast("long"))
    chosen = chosen.withColumn("_w", F.when(F.col("_g").isNotNull(), words))
    chosen = chosen.withColumn("_n", F.size("_w").cast("long"))
    a = F.col("_g") % F.col("_n")
    p = F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, a)).withColumn("_p", p)
    tail = F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(tail, times)), 1, (F.col("_n") - F.col("_a")).cast("int"))
    joined = F.array_join(F.concat(F.slice("_w", 1, F.col("_a").cast("int")), repeated), " ")
    return chosen.withColumn(text_col, F.when(F.col("_a").isNotNull(), joined).otherwise(F.col(text_col))).drop(
        "_g", "_w", "_n", "_a", "_p")
