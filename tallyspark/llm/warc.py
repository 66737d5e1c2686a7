"""Operator 6, WARC archives: writing captures, reading records back and assembling transactions.

Writing. A capture is three records: a request, a response and a metadata record; request and metadata name the response in
WARC-Concurrent-To. Of captures with equal payloads, the one with the largest page id is the response; the others are
revisit records, which carry no payload and name that response in WARC-Refers-To. The blank line that ends every record
is the line separator of Spark's own text writer, so archives go wherever Spark can write, a task's file at a time.

Reading. The reader gets the same pieces in file order and cuts records by their Content-Length, so payloads may hold
blank lines or whole record headers. A task holds one record at a time. Archives must be gzipped, as a whole or by record,
because only those files are never split between tasks.

Assembly. Requests and metadata are joined with the response or revisit that they are concurrent to, and a revisit with
the response it refers to, into one nested row per capture. Either side may name the other, in any number of
WARC-Concurrent-To fields, and a capture holds all its requests and all its metadata. Records with the same id are one.

A null text is an empty payload. A null url has no target header. Among equal payloads a null page id is never the largest;
if all are null, all are responses. Of rows equal in id, url and payload one is written as above and the others as revisits
of it, so each row of the input comes back. Record ids follow from content, so a repeated task writes the same file.
Header fields keep their order and repetitions. An archive that ends within a record is refused. Other columns are left
out, whatever their names; empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import materialize

END = "\r\n\r\n"
# The base 32 alphabet and the names of the WARC format.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20

RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "fields array<struct<name: string, value: string>>, payload_bytes long, payload_digest string, payload binary"
)
PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
RECORD_TYPES = {
    "record_id": pa.string(), "type": pa.string(), "concurrent_to": pa.list_(pa.string()), "refers_to": pa.string(),
    "target_uri": pa.string(), "date": pa.string(), "fields": PAIRS, "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "payload": pa.binary()}


def base32_of_hex(digits: Column, length: int) -> Column:
    """Upper-case base 32 of `length` hexadecimal digits; every five digits are four characters."""
    characters = []
    for i in range(0, length, 5):
        value = F.conv(F.substring(digits, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(value, shift).bitwiseAND(31)
            characters.append(F.substring(F.lit(ALPHABET), place + 1, F.lit(1)))
    return F.concat(*characters)


def _header(kind: str, record_id: Column, date: str, url: Column, *lines: Column | str) -> Column:
    # A line break inside a url would end the header; such characters are percent-encoded.
    clean = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    parts = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), clean), F.lit("")),
    ]
    for line in lines:
        parts += [F.lit("\r\n"), line if isinstance(line, Column) else F.lit(line)]
    return F.concat(*parts)


def _record(header: Column, block: Column) -> Column:
    return F.concat(header, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _urn(*parts: Column) -> Column:
    digits = F.md5(F.concat_ws("|", *parts))
    pieces = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def write_captures(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write all pages as captures into gzipped archives below `path`."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
    ).withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    census = materialize(rows.groupBy("id", "url", "sha1", "bytes").agg(F.count("*").alias("n")), "payloads")

    def urn(kind: str, page_id: str, url: str, copy: Column | None = None) -> Column:
        some = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (page_id, url)]
        again = [F.when(copy > 0, copy.cast("string"))] if copy is not None else []
        return _urn(F.lit(kind), *some, F.col("sha1"), *again)

    # Only payloads that occur twice need a look at the others.
    repeated = census.groupBy("sha1", "bytes").agg(
        F.sum("n").alias("n"), F.max(F.struct("id", "url")).alias("first")).filter("n > 1")
    repeated = repeated.select(
        F.col("sha1").alias("_sha1"), F.col("bytes").alias("_bytes"), F.lit(True).alias("shared"),
        F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    rows = _numbered(rows, census.filter("n > 1"))
    placed = rows.join(repeated, (F.col("sha1") == F.col("_sha1")) & (F.col("bytes") == F.col("_bytes")), "left")
    is_first = F.col("shared").isNull() | (F.col("copy") == 0) & (
        F.col("id").eqNullSafe(F.col("first_id")) & (F.col("id").isNull() | F.col("url").eqNullSafe(F.col("first_url"))))
    # Without ids none is the largest, and every row is a response.
    is_first = is_first | (F.col("id").isNull() & F.col("first_id").isNull())

    url, copy = F.col("url"), F.col("copy")
    capture = urn("capture", "id", "url", copy)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"), 40))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    with_to = F.concat(F.lit("WARC-Concurrent-To: "), capture)
    request = _record(
        _header("request", urn("request", "id", "url", copy), date, url, with_to,
                "Content-Type: application/http; msgtype=request"),
        F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace(url, r"^[a-z]+://[^/\s]*|\s", ""), F.lit("")), F.lit("/")),
                 F.lit(" HTTP/1.1\r\nHost: "),
                 F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/\s]*)", 1), F.lit("")), F.lit(END)))
    response = _record(
        _header("response", capture, date, url, digest, "Content-Type: application/http; msgtype=response"),
        F.concat(http, F.col("payload")))
    revisit = _record(
        _header("revisit", capture, date, url, digest, f"WARC-Profile: {PROFILE}",
                F.concat(F.lit("WARC-Refers-To: "), urn("capture", "first_id", "first_url")),
                "Content-Type: application/http; msgtype=response"),
        http)
    metadata = _record(
        _header("metadata", urn("metadata", "id", "url", copy), date, url, with_to, "Content-Type: application/warc-fields"),
        F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")))
    records = placed.select(F.explode(F.array(
        request, F.when(is_first, response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def _numbered(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """`rows` with `copy`, which numbers rows equal in id, url and payload from 0. They are the same row, so any order does."""
    if twins.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    keys = ["id", "url", "sha1", "bytes"]
    named = twins.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n"))
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    single = rows.join(named, match, "left_anti").withColumn("copy", F.lit(0))
    # Equal rows of any number are one row and a count, so they need not meet in a task.
    every = rows.join(named, match).groupBy(*keys, "_n").agg(F.any_value("payload").alias("payload"))
    several = every.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    return single.unionByName(several.select(*single.columns))


def _parse(header: bytes, block: bytes) -> tuple:
    pairs = _fields(header)
    lines = dict(reversed(pairs))
    kind = lines.get("warc-type")
    payload, fields = None, []
    digest = lines.get("warc-payload-digest", "").removeprefix("sha1:") or None
    length = None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = _fields(head)
        if kind == "response":
            digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        else:
            payload = None
    elif kind == "metadata":
        fields = _fields(b"\r\n" + block)
    concurrent = [value for name, value in pairs if name == "warc-concurrent-to"]
    return (lines.get("warc-record-id"), kind, concurrent, lines.get("warc-refers-to"),
            lines.get("warc-target-uri"), lines.get("warc-date"),
            [{"name": name, "value": value} for name, value in fields], length, digest, payload)


def _fields(head: bytes) -> list[tuple[str, str]]:
    """All (name, value) lines after the first, in order."""
    return [_field(x) for x in head.split(b"\r\n")[1:] if b":" in x]


def _field(line: bytes) -> tuple[str, str]:
    name, _, value = line.partition(b":")
    return name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()


class RecordCutter:
    """Cuts one archive's bytes into (header, block), whatever pieces they come in."""

    def __init__(self):
        self.buffer = bytearray()
        self.header: bytes | None = None
        self.length = 0

    def feed(self, piece: bytes):
        self.buffer += piece
        while True:
            if self.header is None:
                start = 0
                while self.buffer[start:start + 2] == b"\r\n":
                    start += 2
                end = self.buffer.find(b"\r\n\r\n", start)
                if end < 0:
                    return
                self.header = bytes(self.buffer[start:end])
                fields = dict(_fields(self.header))
                if not self.header.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
                    raise ValueError(f"not a WARC record: {self.header[:80]!r}")
                self.length = int(fields["content-length"])
                del self.buffer[:end + 4]
            if len(self.buffer) < self.length:
                return
            block = bytes(self.buffer[:self.length])
            del self.buffer[:self.length]
            yield self.header, block
            self.header = None

    def finish(self, file: str) -> None:
        """Refuse an archive whose last record is not whole: after its block stands an empty line."""
        if self.header is not None or self.buffer.strip(b"\r\n") or len(self.buffer) < len(END):
            raise ValueError(f"{file} ends within a record")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all gzipped archives below `path`; the payload's digest is computed from what was read."""
    pieces = spark.read.option("lineSep", END).text(path).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def parse(batches):
        rows, held, cutter, last = [], 0, RecordCutter(), None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), RECORD_TYPES.values())], names=[*RECORD_TYPES])

        for batch in batches:
            for piece, file in zip(batch.column(0), batch.column(1)):
                file = file.as_py()
                if file != last:
                    if last is not None:
                        cutter.finish(last)
                    cutter, last = RecordCutter(), file
                for header, block in cutter.feed(piece.as_py() + b"\r\n\r\n"):
                    rows.append(_parse(header, block))
                    held += len(block) + 512
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if last is not None:
            cutter.finish(last)
        if rows:
            yield batch_of(rows)

    return pieces.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, target_uri, date, payload_bytes, payload_digest, refers_to (a record
    id), page_id, refers_to_page_id, and the arrays requests and metadata of (record_id, fields) by record id.

    The page id is that of the first metadata record that has one.
    """
    extra = ["payload"] if "payload" in records.columns else []
    records = records.filter(F.col("record_id").isNotNull())
    captures = records.filter(F.col("type").isin("response", "revisit")).dropDuplicates(["record_id"])
    others = records.filter(F.col("type").isin("request", "metadata")).select(
        "record_id", "type", "concurrent_to", F.struct("record_id", "fields").alias("part"))
    naming = others.select(F.explode("concurrent_to").alias("capture"), "type", "part")
    named = captures.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id")).join(
        others, "record_id").select("capture", "type", "part")

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("part"))))

    parts = naming.union(named).groupBy(F.col("capture").alias("record_id")).agg(
        of("request").alias("requests"), of("metadata").alias("metadata"))
    none = F.array().cast(parts.schema["requests"].dataType)
    page_ids = F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda f: f["name"] == "page-id")
    joined = captures.join(parts, "record_id", "left").withColumns({
        "requests": F.coalesce("requests", none), "metadata": F.coalesce("metadata", none),
    }).withColumn("page_id", F.get(page_ids, F.lit(0))["value"].try_cast("long"))
    targets = joined.filter("type = 'response'").select(
        F.col("record_id").alias("_target"), F.col("page_id").alias("_page_id"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    revisits = joined.filter("type = 'revisit'").join(targets, F.col("refers_to") == F.col("_target"), "left").select(
        "record_id", "type", "target_uri", "date", F.col("_bytes").alias("payload_bytes"),
        F.coalesce("_digest", "payload_digest").alias("payload_digest"), "refers_to", "page_id",
        F.col("_page_id").alias("refers_to_page_id"), "requests", "metadata", *extra)
    responses = joined.filter("type = 'response'").select(
        "record_id", "type", "target_uri", "date", "payload_bytes", "payload_digest", "refers_to", "page_id",
        F.lit(None).cast("long").alias("refers_to_page_id"), "requests", "metadata", *extra)
    return responses.union(revisits)
