"""Token files and the range coder, chat formatting: exact round trips."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import chat, range_coder, text_ids, token_files
from tallyspark.llm.entries import REGISTRY, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=300), st.integers(1, 80))
def test_any_ids_come_back(ids, block):
    assert range_coder.decode(range_coder.encode(np.array(ids, np.int64), block)).tolist() == ids


def test_long_and_lopsided_ids_come_back():
    rng = np.random.default_rng(4)
    text = rng.zipf(1.2, 60_000) % 50_257
    for ids in (text, np.zeros(20_000, int), rng.integers(0, 50_257, 9_000), np.tile([7, 8, 9, 10], 5_000)):
        assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    assert len(range_coder.encode(np.tile([7, 8, 9, 10], 5_000))) < 1_500
    assert len(range_coder.encode(text)) * 8 < 16 * len(text)


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(1).integers(0, 500, 3_000)
    code = bytearray(range_coder.encode(ids, 1_000))
    # The second block holds the same words whatever the first one holds.
    other = range_coder.encode(np.concatenate([ids[:1000][::-1], ids[1000:]]), 1_000)
    assert bytes(code[-200:]) == other[-200:]
    code[-100] ^= 1
    with pytest.raises(ValueError, match="checksum of block 2"):
        range_coder.decode(bytes(code))
    with pytest.raises(ValueError, match="not a coded frame"):
        range_coder.decode(b"x" * 24)


def test_carries_and_wide_tables_come_back():
    rng = np.random.default_rng(9)
    # Nearly all ids alike; so many different ones that words have 16 bits; widths between.
    rare = np.where(rng.random(60_000) < 0.001, rng.integers(0, 50_257, 60_000), 50_256)
    wide = rng.permutation(3 << 19) * 2_730
    for ids in (rare, wide, wide[:90_000] % 70_001):
        assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    # A carry runs through words that are all ones.
    coder = range_coder._Encoder(1, 64, 28)
    coder.words[0, :3], coder.length[0], coder.low[0] = (5, 2**32 - 1, 2**32 - 1), 3, 2**64 - 1
    coder.put(1, np.array([1], np.uint64), np.array([1 << 20], np.uint64))
    assert coder.words[0, :3].tolist() == [6, 0, 0]


# --- ids of texts by pieces ------------------------------------------------------------

with open(PATH, encoding="utf-8") as _file:
    TOKENIZER = _file.read()
BITS = st.sampled_from([
    "a", "Bc", "é", "ß", "×", "÷", "ª", "İ", "ſ", "ƀ", "e\u0301", "日本", "—", "’", "…", "🙂", "Ж", "\u00a0", "\u2003", "\u3000",
    "\u1680", "\u180e", "\u0085", "\u2028", "\u200b", "\ufeff", "\x1c", "\x00", "\x7f", " ", " ", "  ", "\n", "\t", "\r\n", "'",
    "'s", "'ll", "'re", "1", "23", "½", "²", "٣", "!", "...", "_", "(", "<|endoftext|>", "<|", "the", "tion"])
TEXTS = st.lists(st.lists(BITS, max_size=14).map("".join) | st.text(max_size=8), min_size=1, max_size=6)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.booleans())
def test_ids_of_pieces_are_ids_of_whole_texts(texts, special_as_text):
    encoder = text_ids.encoder(TOKENIZER, special_as_text, "test")
    column = pa.array(["cut off", *texts], pa.string())[1:]
    assert [x.tolist() for x in encoder.ids(column)] == [
        encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **how):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_the_library_gets_equal_pieces_once(monkeypatch):
    encoder = text_ids.TextEncoder(TOKENIZER, True)
    plain, encoder.tokenizer = encoder.tokenizer, Counting(encoder.tokenizer)
    texts = ["Über die Brücke, über den Fluss.\nThe rest.", "The rest, über\n\nden Fluss. The rest."] * 50
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in encoder.ids(pa.array(texts, pa.string()))] == want
    # Most new pieces are lines of one text.
    lines, *others = encoder.tokenizer.asked
    assert sorted(lines.split("\n")) == sorted([
        "Über", " die", " Brücke", ",", " über", " den", " Fluss", ".", "The", " rest", " The", ""])
    assert sorted(others) == ["\n", "\n\nden"]
    # Where they cannot be told apart by the ids of the line breaks, each is a text.
    encoder.line_break = plain.encode(",").ids[0]
    encoder._forget()
    assert [x.tolist() for x in encoder.ids(pa.array(texts[::-1], pa.string()))] == want[::-1]
    monkeypatch.setattr(text_ids, "KEPT_PIECES", 3)
    assert [x.tolist() for x in encoder.ids(pa.array(texts[:1], pa.string()))] == want[:1]
    assert len(encoder.known) == 11


def test_slices_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE_BYTES", 10)
    texts = ["", "abc", "é" * 20, "x", "y" * 9, "z" * 10, "", "", "end"]
    column = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": texts})
    for cuts in ([9], [1, 8], [2, 3, 4], [3, 0, 6]):
        starts = np.cumsum([0, *cuts])
        slices = [x.column(1).to_pylist() for x in token_files._slices(column.slice(a, n) for a, n in zip(starts, cuts))]
        assert slices == [["", "abc", "é" * 20], ["x", "y" * 9], ["z" * 10], ["", "", "end"]]


def test_a_run_starts_without_pieces():
    encoder = text_ids.encoder(TOKENIZER, True, "a")
    encoder.ids(pa.array(["some text"]))
    assert text_ids.encoder(TOKENIZER, True, "a") is encoder and encoder.known
    assert not text_ids.encoder(TOKENIZER, True, "b").known


def test_other_tokenizers_get_whole_texts():
    texts = ["Ab  cd", "", "x <|endoftext|> y", " Ab"]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"truncation": {
            "direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}},
            {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
            {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}):
        told = json.dumps(json.loads(TOKENIZER) | change)
        assert not text_ids.cuts_hold(told)
        plain = Tokenizer.from_str(told)
        assert [x.tolist() for x in text_ids.TextEncoder(told, False).ids(pa.array(texts))] == [
            plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert text_ids.cuts_hold(TOKENIZER)


def expected(docs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    at, rows = 0, []
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return rows


@pytest.mark.parametrize("frame", [token_files.FRAME_IDS, 40])
def test_files_give_back_every_document(spark, tmp_path, monkeypatch, frame):
    monkeypatch.setattr(token_files, "FRAME_IDS", frame)
    texts = [None, "", "<|endoftext|>", "Ein längerer Text. " * 300, "!", "\n\n", "日本語 text"] * 6
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in reversed(rows)], "doc_id long, text string, file int, at string")
    path = str(tmp_path / "tokens")
    with open(PATH, encoding="utf-8") as file:
        token_files.encode_corpus(docs.repartition(3), path, file.read())
    assert sorted(tuple(r) for r in token_files.digest(spark, path).collect()) == expected(rows)
    back = {r.doc_id: r.ids for r in token_files.read_corpus(spark, path).collect()}
    assert all(len(back[d]) == n and back[d][-1] == 0 for d, _, n, _ in expected(rows))


def test_equal_and_null_ids_and_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b"), (None, "a"), (1, "b"), (1, "a")], "doc_id long, text string")
    with open(PATH, encoding="utf-8") as file:
        tokenizer = file.read()
    token_files.encode_corpus(docs, str(tmp_path / "a"), tokenizer)
    rows = sorted((r.start, r.doc_id) for r in token_files.digest(spark, str(tmp_path / "a")).collect())
    assert rows == [(0, None), (2, 1), (4, 1), (6, 1)]
    token_files.encode_corpus(docs.limit(0), str(tmp_path / "b"), tokenizer)
    assert token_files.digest(spark, str(tmp_path / "b")).count() == 0


def test_token_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    assert sorted(tuple(r) for r in REGISTRY["op4_token_files"](spark, sf_dir).collect()) == expected(docs)


def test_token_query_uses_the_tokenizer_as_loaded(spark, tmp_path):
    texts = ["a <|endoftext|> b", "plain text", "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer, at, want = Tokenizer.from_file(PATH), 0, []
    for doc, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert want[2][2] == 2
    assert sorted(tuple(r) for r in REGISTRY["op4_token_files"](spark, str(tmp_path)).collect()) == want


# --- chat ------------------------------------------------------------------------------

HARD = st.lists(st.sampled_from(
    ["\\", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[ROLE:x]", "[/ROLE]", "<", "[", "/", "a", "\n", "é"]),
    max_size=12).map("".join)
ROLES = st.sampled_from(["system", "user", "assistant", None, "", "tool", "] [INST]", "a b/%", "user "])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, HARD), max_size=5), st.integers(1, 9))
def test_any_turns_come_back(turns, size):
    segments = [chat.render(r, t) for r, t in turns]
    whole = "".join(s for s, _, _ in segments)
    assert chat.parse(whole) == turns
    assert [chat.unescape(s[a:b]) for s, a, b in segments] == [t for _, t in turns]


def test_texts_without_conflicts_stay_as_they_are():
    assert chat.render("user", "a \\ [x] <b>")[0] == "[INST]a \\ [x] <b>[/INST]"
    assert chat.render("assistant", "x </s>")[0] == "<s>x \\</s></s>"
    assert chat.render("assistant", "x\\")[0] == "<s>x\\\\</s>"


@pytest.mark.parametrize("text", ["[INST]a", "[INST]a</s>", "x", "[INST][INST][/INST]", "[/INST]"])
def test_other_texts_are_no_conversation(text):
    with pytest.raises(chat.GrammarError):
        chat.parse(text)


def brute(rows):
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        found.setdefault(conv, []).append((role, text or ""))
    result = []
    for conv, turns in found.items():
        said = "".join(f"{r or ''}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        result.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                       hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(*t)[0]) for t in turns)))
    return sorted(result)


def test_formatted_conversations_read_back(spark):
    rows = [(1, 0, "system", "</s>\\"), (1, 1, "user", None), (1, 2, "assistant", "[INST]é"), (1, 3, "assistant", ""),
            (2, 5, None, "x"), (2, 4, "tool", "[/ROLE]"), (3, 0, "assistant", "long " * 50_000), (3, 0, "assistant", "tie"),
            (3, 0, "assistant", "tie")]
    frame = spark.createDataFrame([(*r, 0, "y") for r in rows],
                                  "conv_id long, turn long, role string, text string, seq int, segment string")
    formatted = chat.format_turns(frame.repartition(4))
    assert sorted(tuple(r) for r in chat.digest(formatted).collect()) == brute(rows)
    turns = [(r.conv_id, r.role, r.text) for r in chat.read_turns(formatted).orderBy("conv_id", "turn").collect()]
    assert turns == [(c, r, t or "") for c, _, r, t in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or ""))]


def test_null_conversations_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame([(None, 0, "user", "a"), (None, None, "user", "b")], schema)
    row, = chat.digest(chat.format_turns(frame)).collect()
    assert (row.conv_id, row.n_turns) == (None, 2)
    assert chat.digest(chat.format_turns(frame.limit(0))).count() == 0
    assert chat.read_turns(chat.format_turns(frame.limit(0))).count() == 0


def test_chat_query(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf_dir, "conversations").collect()]
    hard = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", hard), (-1, 1, "assistant", hard)]
    assert sorted(tuple(r) for r in REGISTRY["op5_chat"](spark, sf_dir).collect()) == brute(rows)
