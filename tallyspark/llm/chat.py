"""Operator 5, chat formatting with a grammar round trip.

A turn is rendered as its opening mark, the text and its closing mark; a conversation is its turns in a row. The marks
are control strings:

    system     <<SYS>> text <</SYS>>        user   [INST] text [/INST]
    assistant  <s> text </s>                other  [ROLE:name] text [/ROLE], the name percent-encoded

(without the blanks). A control string with an odd number of backslashes before it is text. Every rendered turn is parsed
again; when the parse is not the source turn, its text is escaped one step further, until they are identical: first
control strings inside the text (k backslashes and the string become 2k + 1 and the string), then backslashes at its end
(k become 2k). Texts without conflicts stay as they are.

The output has one row per turn, so that no conversation must fit one row: conv_id, seq, segment, and the loss mask as
code points of the segment (empty but for assistant turns). The reader streams a conversation's segments through the
parser and never relies on where segments end.

Turns are ordered by turn, then role, then text, nulls first; repeated rows are repeated turns. A null text is empty, a
null role is [ROLE]. Rows with a null conversation id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.session import wide

#: Opening and closing mark by role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER_CLOSE = "[/ROLE]"
CONTROL = r"<<SYS>>|<</SYS>>|\[/?INST\]|</?s>|\[ROLE(?::[^\]\[\s]*)?\]|\[/ROLE\]"
RUN = re.compile(rf"(\\*)({CONTROL})")
OPENING = re.compile(r"<<SYS>>|\[INST\]|<s>|\[ROLE(?::([^\]\[\s]*))?\]")
ROLES = {opening: role for role, (opening, _) in MARKS.items()}
BATCH_CHARS = 4 << 20


class GrammarError(ValueError):
    """Text that no conversation renders to."""


def marks(role: str | None) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    return ("[ROLE]" if role is None else f"[ROLE:{quote(role, safe='')}]"), OTHER_CLOSE


def escape(text: str, steps: int) -> str:
    if steps >= 1:
        text = RUN.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    if steps >= 2:
        body = text.rstrip("\\")
        text = body + "\\" * (2 * (len(text) - len(body)))
    return text


def unescape(body: str) -> str:
    """The text of a turn's body; the backslashes at its end stand before the closing mark."""
    inner = body.rstrip("\\")
    return RUN.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], inner) + "\\" * ((len(body) - len(inner)) // 2)


class Parser:
    """Turns of one rendered conversation, from pieces of any size."""

    def __init__(self):
        self.buffer, self.role, self.close, self.at = "", None, None, 0

    def feed(self, piece: str):
        self.buffer += piece
        while self.buffer:
            if self.close is None:
                m = OPENING.match(self.buffer)
                if not m:
                    # No opening mark is cut by a segment that the renderer made, but a piece may end anywhere.
                    return
                self.role = ROLES.get(m[0], None if m[1] is None else unquote(m[1]))
                self.close = marks(self.role)[1]
                self.buffer, self.at = self.buffer[m.end():], 0
            found = next((m for m in RUN.finditer(self.buffer, self.at) if len(m[1]) % 2 == 0), None)
            if found is None:
                return
            if found[2] != self.close:
                raise GrammarError(f"{found[2]} inside a turn that ends with {self.close}")
            yield self.role, unescape(self.buffer[:found.start(2)])
            self.buffer, self.close, self.at = self.buffer[found.end():], None, 0

    def finish(self):
        if self.buffer or self.close is not None:
            raise GrammarError("the conversation ends inside a turn")


def parse(rendered: str) -> list[tuple[str | None, str]]:
    parser = Parser()
    turns = list(parser.feed(rendered))
    parser.finish()
    return turns


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """A turn's segment and where its escaped text begins and ends."""
    opening, closing = marks(role)
    for steps in range(3):
        body = escape(text, steps)
        segment = opening + body + closing
        try:
            if parse(segment) == [(role, text)]:
                return segment, len(opening), len(opening) + len(body)
        except GrammarError:
            pass
    raise GrammarError(f"a turn of {len(text)} characters has no rendering")


def _runs(columns: list[pa.Array]):
    return zip(*(c.to_pylist() for c in columns))


def format_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, seq, segment, loss_start, loss_end) for every turn."""
    def write(batches):
        last, seq = object(), 0
        for batch in batches:
            rows, chars = [], 0
            for conv, role, text in _runs(batch.columns):
                seq, last = (seq + 1, conv) if conv == last else (0, conv)
                segment, start, end = render(role, text or "")
                rows.append((conv, seq, segment, *((start, end) if role == "assistant" else (0, 0))))
                chars += len(segment)
                if chars > BATCH_CHARS:
                    yield _batch(rows, OUTPUT)
                    rows, chars = [], 0
            if rows:
                yield _batch(rows, OUTPUT)

    dealt = turns.select(turns[id_col].cast("long").alias("conv_id"), turns[turn_col].alias("turn"),
                         turns[role_col].alias("role"), turns[text_col].alias("text"))
    dealt = dealt.repartition(wide(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(
        write, "conv_id long, seq long, segment string, loss_start int, loss_end int")


OUTPUT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("segment", pa.string()),
                    ("loss_start", pa.int32()), ("loss_end", pa.int32())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _conversations(formatted: DataFrame) -> DataFrame:
    dealt = formatted.select("conv_id", "seq", "segment", "loss_start", "loss_end")
    return dealt.repartition(wide(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as the parser recovers them from the output."""
    def read(batches):
        last, parser, number = object(), Parser(), 0
        for batch in batches:
            rows = []
            for conv, _, segment, _, _ in _runs(batch.columns):
                if conv != last:
                    parser.finish()
                    last, parser, number = conv, Parser(), 0
                for role, text in parser.feed(segment):
                    rows.append((conv, number, role, text))
                    number += 1
            if rows:
                yield _batch(rows, TURNS)
        parser.finish()

    return _conversations(formatted).mapInArrow(read, "conv_id long, turn long, role string, text string")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: turns, hashes of the recovered turns and of the text under the mask."""
    def summarise(batches):
        last, state, rows = object(), None, []
        for batch in batches:
            for conv, _, segment, start, end in _runs(batch.columns):
                if conv != last:
                    if state is not None:
                        rows.append(state.row(last))
                    last, state = conv, _Digest()
                state.add(segment, start, end)
            if rows:
                yield _batch(rows, DIGEST)
                rows = []
        if state is not None:
            yield _batch([state.row(last)], DIGEST)

    return _conversations(formatted).mapInArrow(
        summarise, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                   "formatted_chars long")


class _Digest:
    def __init__(self):
        self.parser, self.turns, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, segment: str, start: int, end: int):
        self.chars += len(segment)
        masked = unescape(segment[start:end])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        for role, text in self.parser.feed(segment):
            self.turns.update(f"{role or ''}\n{text}\n".encode())
            self.n += 1

    def row(self, conv) -> tuple:
        self.parser.finish()
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
