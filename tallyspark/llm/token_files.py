"""Operator 4, token ids of a corpus in files of range-coded blocks.

Documents are dealt by ranges of their id and sorted, so files, and frames in a file, follow ascending ids. A task encodes
whole texts (`text_ids`: equal pieces of text once), ends each document with one extra id, and gathers documents to frames of about FRAME_IDS ids; a longer
document is a frame of its own. A frame is one row of a Parquet file: file and frame number, the ids and lengths of its
documents, and their token ids as one code of a table and independent, checksummed blocks (`range_coder`). Frames hold whole
documents, so each is read alone; a document's place in the corpus follows from the frames' lengths.

Text that names a special token, such as <|endoftext|>, is ordinary text unless `special_as_text` is off: then the tokenizer
works as its file says, and the name becomes the token's single id.

A null text is empty and has the end id only. Null ids come first; equal ids are in order of their texts. The tokenizer's
file is a parameter; its content travels with the tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm import range_coder, text_ids
from tallyspark.llm.words import text_batches
from tallyspark.session import wide

FRAME_IDS = 1 << 22
SLICE_BYTES = 1 << 23
FRAMES = "file int, frame int, doc_ids array<long>, lengths array<long>, n_ids long, code binary"


def encode_corpus(docs: DataFrame, path: str, tokenizer_json: str, *, end_id: int = 0, id_col: str = "doc_id",
                  text_col: str = "text", special_as_text: bool = True) -> None:
    """Write the token ids of all documents below `path`."""
    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(wide(docs.sparkSession), "id").sortWithinPartitions("id", "text")

    def encode(batches):
        encoder = text_ids.encoder(tokenizer_json, special_as_text, path)
        end = np.array([end_id], np.uint32)
        file, frame = TaskContext.get().partitionId(), 0
        names, parts, held = [], [], 0

        def finish():
            lengths = [len(p) + 1 for p in parts]
            code = range_coder.encode(np.concatenate([x for p in parts for x in (p, end)]))
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([frame], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([sum(lengths)], pa.int64()),
                 pa.array([code], pa.binary())],
                names=["file", "frame", "doc_ids", "lengths", "n_ids", "code"])

        for some in _slices(batches):
            for name, ids in zip(some.column(0).to_pylist(), encoder.ids(some.column(1))):
                names.append(name)
                parts.append(ids)
                held += len(ids) + 1
                if held >= FRAME_IDS:
                    yield finish()
                    names, parts, held, frame = [], [], 0, frame + 1
        if parts:
            yield finish()

    dealt.mapInArrow(encode, FRAMES).write.option("compression", "none").parquet(path)


def _slices(batches):
    """Rows of all batches, about SLICE_BYTES of text at a time."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < len(ends):
            held.append(batch.slice(at, int(np.searchsorted(ends[at:], before + SLICE_BYTES - size)) + 1))
            at += len(held[-1])
            size, before = size + int(ends[at - 1]) - before, int(ends[at - 1])
            if size >= SLICE_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def frame_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, start): ids in all frames before, from narrow columns."""
    sizes = _frames(spark, path).select("file", "frame", "n_ids")
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("in_file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(files, "file").select(
        "file", "frame", (F.col("file_start") + F.col("in_file")).alias("start"))


def _documents(batches):
    """(file, frame, doc_id, start in the frame, ids) of every document, a frame at a time."""
    for batch in batches:
        for file, frame, names, lengths, code in zip(*(batch.column(i) for i in range(5))):
            ids, at = range_coder.decode(code.as_py()), 0
            yield file.as_py(), frame.as_py(), [
                (name, at := at + n, ids[at - n:at]) for name, n in zip(names.as_py(), lengths.as_py())]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, decoded from the files."""
    def read(batches):
        for file, frame, documents in _documents(batches):
            yield _rows(file, frame, documents, [d[2].astype(np.int64) for d in documents], pa.list_(pa.int64()))

    return _placed(spark, path, read, "ids array<long>").select("doc_id", "start", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    def read(batches):
        for file, frame, documents in _documents(batches):
            sums = [zlib.crc32(d[2].astype("<u4", copy=False)) for d in documents]
            yield _rows(file, frame, documents, sums, pa.int64())

    return _placed(spark, path, read, "ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")


def _rows(file: int, frame: int, documents: list, values: list, kind: pa.DataType) -> pa.RecordBatch:
    n = len(documents)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.int32()), pa.array([frame] * n, pa.int32()),
         pa.array([d[0] for d in documents], pa.int64()), pa.array([d[1] - len(d[2]) for d in documents], pa.int64()),
         pa.array([len(d[2]) for d in documents], pa.int64()), pa.array(values, kind)],
        names=["file", "frame", "doc_id", "at", "n_tokens", "value"])


def _placed(spark: SparkSession, path: str, read, value: str) -> DataFrame:
    frames = _frames(spark, path).select("file", "frame", "doc_ids", "lengths", "code")
    name, kind = value.split()
    rows = frames.mapInArrow(read, f"file int, frame int, doc_id long, at long, n_tokens long, value {kind}")
    starts = frame_starts(spark, path)
    return rows.join(starts, ["file", "frame"]).withColumn("start", F.col("start") + F.col("at")).withColumnRenamed(
        "value", name)
