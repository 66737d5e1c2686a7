"""Records of CSV files whose quoted fields hold line breaks, found by many tasks a file.

A line begins either at the start of a record or inside a quoted field, and it ends in one of these two states. So a line is
a function of two states, and functions of consecutive lines compose associatively. One pass composes the lines of each
split; the splits of a file are composed in order, which tells the state each split begins in. A second pass groups lines
into records. A record that crosses the border of splits is put together from its pieces, of which a split has two at most.

Lines without quotes change no state, and files in which no line leaves a quoted field open need no second pass.

Line breaks are "\\n" or "\\r\\n"; those of the second kind become "\\n" inside quoted fields.
"""

import bisect
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
#: A line from the start of a record, and one from inside a quoted field, that ends its record.
_WHOLE = re.compile(f"{_FIELD}(?:,{_FIELD})*+", re.DOTALL)
_REST = re.compile(f'[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD})*+', re.DOTALL)

RECORD = "file string, start long, row long, record string"
PIECE = RECORD + ", piece string"


def ends_record(line: str, quoted: bool) -> bool:
    """Whether no quoted field is open at the end of a line that begins inside one (`quoted`) or with a record."""
    return (_REST if quoted else _WHOLE).fullmatch(line) is not None


def unix_breaks(record: str) -> str:
    """A record that ends with a carriage return has its line breaks inside quotes written the same way."""
    return record[:-1].replace("\r\n", "\n") if record.endswith("\r") else record


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start of the split, line) in the order of the files within each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"))


def _runs(batch: pa.RecordBatch):
    """(file, start, first row, end row) of the stretches of a batch that belong to one split."""
    file, start = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
    code = np.asarray(file.indices)
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.column(0)[a].as_py(), int(start[a]), int(a), int(b)


class _Quotes:
    """What each line of a column does to the state "inside quotes", found for all lines at once.

    As long as every quote opens or closes a field, a line with an odd number of quotes changes the state and others keep
    it. A line can do otherwise only if a quote that would open a field stands neither at the start of a field nor right
    behind the quote that has just closed it, where it is an escape. Such lines are matched as text, one by one.
    """

    def __init__(self, column: pa.Array):
        self.column, n = column, len(column)
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * np.dtype(kind).itemsize)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        self.starts = ends - ends[0]
        at = np.flatnonzero(data == ord('"'))
        line = np.searchsorted(self.starts, at, "right") - 1
        count = np.bincount(line, minlength=n)
        odd = (np.cumsum(count) & 1).astype(bool)
        self.change = np.concatenate([[False], odd])
        number = np.arange(len(at)) - (np.cumsum(count) - count)[line]
        before = data[at - 1]
        strange = (at != self.starts[line]) & (before != ord(",")) & (before != ord('"'))
        by_start = np.zeros((2, n), bool)
        for quoted in (0, 1):
            by_start[quoted, line[strange & (number % 2 == quoted)]] = True
        #: Lines to match, where the state is `phase` changed by all quotes before the line.
        self.matched = [np.flatnonzero(np.where(self.change[:-1] ^ phase, by_start[1], by_start[0])) for phase in (False, True)]

    def open_after(self, quoted: bool) -> np.ndarray:
        """Whether a quoted field is open after each line; the first begins inside one (`quoted`) or with a record."""
        n, at = len(self.column), 0
        found = np.empty(n, bool)
        while at < n:
            phase = bool(quoted ^ self.change[at])
            matched = self.matched[phase]
            k = np.searchsorted(matched, at)
            end = int(matched[k]) if k < len(matched) else n
            found[at:end] = self.change[at + 1:end + 1] ^ phase
            if end < n:
                quoted = not ends_record(self.column[end].as_py(), bool(self.change[end] ^ phase))
                found[end] = quoted
            at = end + 1
        return found


class SplitStates:
    """Whether a quoted field is open after each split that holds quotes, by file in the order of offsets."""

    def __init__(self, after: list[tuple[str, int, bool, bool]]):
        self.starts: dict[str, list[int]] = {}
        self.open: dict[str, list[bool]] = {}
        for file, start, from_record, from_quoted in sorted(after):
            state = self.open.setdefault(file, [])
            state.append(from_quoted if state and state[-1] else from_record)
            self.starts.setdefault(file, []).append(start)

    def begins_quoted(self, file: str, start: int) -> bool:
        before = bisect.bisect_left(self.starts.get(file, []), start)
        return before > 0 and self.open[file][before - 1]


def split_states(lined: DataFrame) -> SplitStates | None:
    """The composed lines of all splits; None if no line leaves a quoted field open.

    The first line of all that leaves a field open begins with a record, and so does its split; it is enough to look for
    one from there. The driver receives a path and three flags for each split with quotes; it holds more than that for
    every split to plan the scan.
    """
    def compose(batches):
        after: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, start, a, b in _runs(batch):
                state = after.setdefault((file, start), [False, True, False])
                quotes = _Quotes(batch.column(2).slice(a, b - a))
                open_ = quotes.open_after(state[0])
                other = open_ if state[0] == state[1] else quotes.open_after(state[1])
                state[:] = bool(open_[-1]), bool(other[-1]), state[2] or bool(open_.any())
        for (file, start), state in after.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([start], pa.int64()), *(pa.array([s]) for s in state)],
                names=["file", "start", "from_record", "from_quoted", "opens"])

    quoted = lined.filter(F.contains("line", F.lit('"')))
    found = quoted.mapInArrow(
        compose, "file string, start long, from_record boolean, from_quoted boolean, opens boolean").collect()
    if not any(r.opens for r in found):
        return None
    return SplitStates([tuple(r)[:4] for r in found])


def assembled(lined: DataFrame, states: SplitStates, pieces: bool) -> DataFrame:
    """RECORD rows of whole records, or PIECE rows ("first" or "rest") of those that cross a split's border.

    `row` numbers the records that begin in a split. Blank lines between records are no records.
    """
    def group(batches):
        split, held, row, quoted, rest = None, [], 0, False, False

        def taken(whole=None):
            """The lines held, as one piece of a record or as a whole one."""
            text = "\n".join(line for part in held for line in part.to_pylist())
            if whole:
                return _batch(split, row, pa.array([unix_breaks(text)], pa.string()))
            return _batch(split, row, pa.array([text], pa.string()), "rest" if rest else "first")

        for batch in batches:
            for file, start, a, b in _runs(batch):
                if (file, start) != split:
                    if held and pieces:
                        yield taken()
                    split, held, row = (file, start), [], 0
                    quoted = rest = states.begins_quoted(file, start)
                column = batch.column(2).slice(a, b - a)
                open_ = _Quotes(column).open_after(quoted)
                quoted = bool(open_[-1])
                ends, at = np.flatnonzero(~open_) + 1, 0
                if len(ends) and (held or rest):
                    at, ends = int(ends[0]), ends[1:]
                    held.append(column.slice(0, at))
                    if rest:
                        if pieces:
                            yield taken()
                    else:
                        if not pieces:
                            yield taken(whole=True)
                        row += 1
                    held, rest = [], False
                if len(ends):
                    found = _joined(column, at, ends)
                    if not pieces:
                        yield _batch(split, row, found)
                    row, at = row + len(found), int(ends[-1])
                if at < len(column):
                    held.append(column.slice(at))
        if held and pieces:
            yield taken()

    return lined.mapInArrow(group, PIECE if pieces else RECORD)


def _joined(column: pa.Array, start: int, ends: np.ndarray) -> pa.Array:
    """The records of a column's lines from `start` on that end before the lines `ends`, without blank ones."""
    if len(ends) == ends[-1] - start:
        found = column.slice(start, len(ends))
    else:
        groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[start], ends]), pa.int32()), column)
        found = pc.binary_join(groups, "\n")
    if column.type != pa.string():
        found = found.cast(pa.string())
    returned = pc.ends_with(found, "\r")
    if pc.any(returned).as_py():
        unix = pc.replace_substring(pc.replace_substring_regex(found, "\r\\z", ""), "\r\n", "\n")
        found = pc.if_else(returned, unix, found)
    # A text that begins with a visible character is not blank; few others are left to look at.
    seen = pc.match_substring_regex(found, "^[!-~]")
    blank = [i for i in np.flatnonzero(~np.asarray(seen)).tolist() if not found[i].as_py().strip()]
    if blank:
        kept = np.ones(len(found), bool)
        kept[blank] = False
        found = found.filter(pa.array(kept))
    return found


def _batch(split: tuple[str, int], row: int, texts: pa.Array, piece: str | None = None) -> pa.RecordBatch:
    """Rows of RECORD, or of PIECE, numbered from `row`."""
    file, start = split
    columns = {"file": pa.repeat(pa.scalar(file, pa.string()), len(texts)),
               "start": pa.repeat(pa.scalar(start, pa.int64()), len(texts)),
               "row": pa.array(np.arange(row, row + len(texts)), pa.int64()), "record": texts}
    if piece:
        columns["piece"] = pa.repeat(pa.scalar(piece, pa.string()), len(texts))
    return pa.RecordBatch.from_pydict(columns)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(file, start, row, record) of the records that cross borders, by the split they begin in.

    A split has two pieces at most, so the window over a file's pieces is as short as its list of splits. A field that is
    never closed takes all that follows, as it does for any reader.
    """
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("piece") == "rest", 0).otherwise(1))
    first = F.last(F.when(F.col("piece") == "first", F.struct("start", "row")), ignorenulls=True).over(order)
    part = F.struct("start", "record")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["record"]), "\n")
    return pieces.withColumn("_first", first).groupBy("file", "_first").agg(text.alias("record")).select(
        "file", "_first.start", "_first.row",
        F.when(F.endswith("record", F.lit("\r")), F.regexp_replace(F.regexp_replace("record", "\r$", ""), "\r\n", "\n"))
        .otherwise(F.col("record")).alias("record"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """(file, start, row, record) of all records, headers included; None if every line of the files is one."""
    lined = lines(spark, path)
    states = split_states(lined)
    if states is None:
        return None
    return assembled(lined, states, pieces=False).unionByName(joined_pieces(assembled(lined, states, pieces=True)))
