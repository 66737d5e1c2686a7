"""Token ids of whole texts from the tokenizers library, each distinct piece of text encoded once.

A byte-level BPE tokenizer splits a text by its regex and encodes the parts one by one, so the ids of a text are those of
any pieces that end where such parts end. `TextEncoder` cuts texts where the bytes beside a place make that certain, lets the
library encode every distinct piece, and puts the ids of whole texts together from these. A piece may hold several parts:
around characters whose kind is not certain from their bytes (most beyond U+017F) nothing is cut.

Pieces are remembered in a worker, over its tasks of one run, up to a bounded number of pieces and characters; then all are forgotten.
Texts that name an added token, and tokenizers of another kind, are encoded as they are, each text by one call.
"""

from __future__ import annotations

import itertools
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and their characters, remembered before all are forgotten.
KEPT_PIECES, KEPT_CHARS = 1 << 20, 1 << 24

_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BLANK = range(7)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
# A quote may begin a short form like 's, which goes on behind it.
_KIND[0x27] = _QUOTE
_KIND[0x20] = _SPACE
_KIND[0x09:0x0E] = _BLANK
# U+00C0 to U+017F are letters but for U+00D7 and U+00F7; their second bytes are set beside them.
_KIND[0xC3:0xC6] = _LETTER

#: By two kinds in a row: whether a part surely ends between them.
_BORDER = np.zeros((8, 8), bool)
for _a in (_LETTER, _DIGIT, _MARK, _QUOTE):
    _BORDER[_a, [_SPACE, _BLANK]] = True
_BORDER[_LETTER, [_DIGIT, _MARK, _QUOTE]] = _BORDER[_DIGIT, [_LETTER, _MARK, _QUOTE]] = True
_BORDER[_MARK, [_LETTER, _DIGIT]] = True
_BORDER = np.resize(_BORDER, 256)

#: First bytes of characters that are surely no white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True

#: Pieces that any others may stand beside, with a line break between them; so many are encoded as one text.
_PLAIN = "^ ?[!-~\u00c0-\u017f]+$"
JOINED = 128


def _looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """`table[data]` for tables of 256 bytes or truth values."""
    return np.frombuffer(bytearray(data.tobytes().translate(table.tobytes())), table.dtype)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts start: text r is the UTF-8 bytes `data[offsets[r]:offsets[r + 1]]`."""
    starts = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = _looked_up(_KIND, data)
        second = np.flatnonzero(data[:-1] - np.uint8(0xC3) < 3) + 1
        kind[second] = _LETTER
        sign = second[(data[second - 1] == 0xC3) & ((data[second] & 0xDF) == 0x97)]
        kind[sign] = kind[sign - 1] = _OTHER
        starts[1:-1] = _looked_up(_BORDER, kind[:-1] << 3 | kind[1:])
        # A space belongs to what follows it, whatever stands before.
        solid = _looked_up(_SOLID, data)
        solid[offsets[:-1][offsets[:-1] < len(data)]] = False
        starts[:-2] |= (kind[:-1] == _SPACE) & solid[1:]
        # A line break alone is a part; of several, the last one is a part when no white space follows.
        alone = np.flatnonzero(kind[:-1] == _BLANK)
        before, after = kind[np.maximum(alone - 1, 0)], kind[alone + 1]
        alone = alone[(before >= _LETTER) & (before <= _QUOTE) & (after >= _LETTER) & (after <= _QUOTE)]
        starts[alone + 1] = True
    starts[offsets] = True
    starts[len(data)] = False
    return np.flatnonzero(starts)


def cuts_hold(tokenizer_json: str) -> bool:
    """Whether a tokenizer splits texts by the regex that `piece_starts` knows, before all else."""
    told = json.loads(tokenizer_json)
    split, end, model = told.get("pre_tokenizer") or {}, told.get("post_processor"), told["model"]
    return (
        split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        and not any(told.get(k) for k in ("normalizer", "truncation", "padding"))
        and (end is None or end["type"] == "ByteLevel")
        and model["type"] == "BPE" and not model.get("dropout"))


@lru_cache(maxsize=1)
def encoder(tokenizer_json: str, special_as_text: bool, run: str) -> TextEncoder:
    """The encoder of a worker, which keeps its pieces from task to task of a run."""
    return TextEncoder(tokenizer_json, special_as_text)


class TextEncoder:
    def __init__(self, tokenizer_json: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or []]
        self.by_pieces = cuts_hold(tokenizer_json)
        # The id of a line break; None when the pieces cannot be joined by one.
        ids = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.by_pieces else []
        self.line_break = ids[0] if len(ids) == 1 and not any("\n" in content for content in self.added) else None
        self._forget()

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; texts are not null."""
        coded = texts.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_string())
        whole = np.full(len(distinct), not self.by_pieces)
        for content in self.added:
            whole |= pc.match_substring(distinct, content).to_numpy(zero_copy_only=False)
        found: list = [None] * len(distinct)
        for rows, encode in ((np.flatnonzero(whole), self._whole), (np.flatnonzero(~whole), self._by_pieces)):
            if len(rows):
                some = distinct if len(rows) == len(distinct) else distinct.take(pa.array(rows))
                for row, ids in zip(rows.tolist(), encode(some)):
                    found[row] = ids
        return [found[k] for k in coded.indices.to_pylist()]

    def _whole(self, texts: pa.Array) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        return [np.array(c.ids, np.uint32) for c in coded]

    def _by_pieces(self, texts: pa.Array) -> list[np.ndarray]:
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        starts = piece_starts(data, offsets)
        ends = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(
            pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        places = self._places(pieces.dictionary)[pieces.indices.to_numpy()]
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(sizes.sum())]
        # Where each text ends among the ids, from where it ends among the pieces.
        borders = np.append(0, ends)[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(borders)]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.pool = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The places of distinct pieces among those known; unknown ones are encoded."""
        if len(self.known) > KEPT_PIECES or self.chars > KEPT_CHARS:
            self._forget()
        texts = pieces.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.known.get, texts, itertools.repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(places < 0)
        if len(new):
            plain = np.zeros(len(new), bool)
            if self.line_break is not None:
                plain = pc.match_substring_regex(pieces.take(pa.array(new)), _PLAIN).to_numpy(zero_copy_only=False)
            for some, encode in ((new[plain], self._joined), (new[~plain], self._single)):
                if len(some):
                    places[some] = self._learn([texts[k] for k in some.tolist()], encode)
        return places

    def _learn(self, pieces: list[str], encode) -> np.ndarray:
        ids, sizes = encode(pieces)
        places = np.arange(len(self.known), len(self.known) + len(pieces))
        self.known.update(zip(pieces, places.tolist()))
        self.chars += sum(map(len, pieces))
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.append(self.pool, ids)
        return places

    def _single(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        ids = [c.ids for c in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, sizes.sum()), sizes

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces, which are lines of a few texts."""
        ids, _ = self._single(["\n".join([*some, ""]) for some in itertools.batched(pieces, JOINED)])
        ends = np.flatnonzero(ids == self.line_break)
        if len(ends) != len(pieces):
            return self._single(pieces)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
