"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

Every partition of pages becomes one ``.warc.zst`` file: a dictionary is built from the first
records, stored in a leading skippable frame, and each record becomes one frame compressed
with it.  So each record can be read alone, given the file's head and the record's offset.

Payloads that several pages share are stored once, by the page with the largest id; the
others become revisit records that point to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm.common import arrow_files, fresh_path, key_name, name_key, text_or_empty

#: Little-endian magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of a dictionary, and bytes of records that it is built from, at most.
DICTIONARY_BYTES, TRAINING_BYTES = 32 << 10, 2 << 20
READ_BYTES = 1 << 20


def record_id(page_id: str | None) -> str:
    return f"<urn:page{key_name(page_id)}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary trained on records like these; where they are too few or too uniform for that, their own content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def warc_record(page_id: str | None, url: str, payload: bytes | None, *, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response, or with ``refers_to`` a revisit without a block."""
    block = b"" if refers_to is not None else payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {length}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Its header fields, names in lower case, and its block; ValueError if the lengths don't agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return fields, rest[:size]


# ---- writing ----


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for page, url, html, refers, sha1, size in zip(*batch.columns, strict=True):
            uri = " ".join((url.as_py() or "").split())
            digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
            yield warc_record(page.as_py(), uri, html.as_py(), digest=digest, length=size.as_py(), refers_to=refers.as_py())


def _write_file(batches: Iterator[pa.RecordBatch], directory: str, level: int) -> Iterator[pa.RecordBatch]:
    records = _records(batches)
    first, size = [], 0
    for record in records:
        first.append(record)
        size += len(record)
        if size >= TRAINING_BYTES:
            break
    if not first:
        return
    raw = build_dictionary(first)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw), write_checksum=True)
    fs, base = arrow_files(directory)
    fs.create_dir(f"{base}/_drafts", recursive=True)
    name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
    draft, n = f"{base}/_drafts/{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        for part in (first, records):
            for record in part:
                out.write(compressor.compress(record))
                n += 1
            first = None
    fs.move(draft, f"{base}/{name}")
    yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})


def with_originals(pages: DataFrame, *, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """``key``, ``url``, the payload's bytes, ``refers_to``, and the payload's ``sha1`` and ``size``: of equal payloads of ``least_bytes`` or more, the largest key's ``refers_to`` is null and the others' that key.

    Where it isn't null the payload is: a revisit needs its digest and size alone.

    Keys that share the largest value with an equal payload (repeated rows) all have null;
    so have null keys among themselves.  Groups are found from digests, one row for each; a
    payload that a large part of all pages share is one row there, and Spark splits its side of the join.
    """
    rows = pages.select(F.col(key).alias("page"), F.col("url").cast("string").alias("url"), text_or_empty(payload).cast("binary").alias("payload"))
    rows = rows.select("page", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    newest = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    newest = newest.select("digest", "size", "newest")
    found = rows.join(newest, ["digest", "size"], "left")
    other = F.col("newest").isNotNull() & ~F.col("page").eqNullSafe(F.col("newest"))
    return found.select("page", "url", F.when(~other, F.col("payload")).alias("payload"), F.when(other, F.col("newest")).alias("refers_to"), F.col("digest").alias("sha1"), "size")


def write_archives(pages: DataFrame, directory: str, *, key: str = "page_id", payload: str = "html", least_bytes: int = 0, level: int = 3) -> None:
    """Write ``pages`` (``key``, ``url``, ``payload``) as WARC files below ``directory``, one per partition that has rows."""
    rows = with_originals(pages, key=key, payload=payload, least_bytes=least_bytes)
    rows = rows.select(F.col("page").cast("string"), "url", "payload", F.col("refers_to").cast("string"), "sha1", "size")
    rows.mapInArrow(lambda batches: _write_file(batches, directory, level), "file string, records long").write.parquet(f"{directory}/_manifest")


# ---- reading ----


def read_frames(stream: io.RawIOBase) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record of a file, in order."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no leading dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(size)))
    buffer, at, offset = b"", 0, 8 + size
    while True:
        if at >= len(buffer):
            buffer, at = stream.read(READ_BYTES), 0
            if not buffer:
                return
        frame, record, used = decompressor.decompressobj(), [], 0
        while not frame.eof:
            if at >= len(buffer):
                buffer, at = stream.read(READ_BYTES), 0
                if not buffer:
                    raise ValueError("the last record is cut off")
            piece = buffer[at : at + 8192]
            record.append(frame.decompress(piece))
            took = len(piece) - len(frame.unused_data)
            at, used = at + took, used + took
        yield offset, b"".join(record)
        offset += used


RECORDS = "file string, offset long, page string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _uri_id(value: str | None) -> str | None:
    return None if value is None else name_key(value.removeprefix("<urn:page").removesuffix(">"))


def _read_files(batches: Iterator[pa.RecordBatch], directory: str) -> Iterator[pa.RecordBatch]:
    fs, base = arrow_files(directory)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    for names in batches:
        for name in names.column(0).to_pylist():
            rows, size = [], 0
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for offset, raw in read_frames(stream):
                    fields, block = parse_record(raw)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(block) != digest:
                        raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
                    rows.append((name, offset, _uri_id(fields["warc-record-id"]), fields["warc-target-uri"], kind, _uri_id(fields.get("warc-refers-to")), digest, int(fields["warc-payload-length"]), block if kind == "response" else None))
                    size += len(block)
                    if size >= 8 << 20 or len(rows) >= 20_000:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """The records below ``directory`` with the columns of ``RECORDS``; a task for each file.  Revisits have no payload."""
    files = spark.read.schema("file string, records long").parquet(f"{directory}/_manifest").select("file")
    n = files.count()
    return files.repartition(max(1, n)).mapInArrow(lambda batches: _read_files(batches, directory), RECORDS)


def archived_pages(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html), read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row for each row of ``pages``.  A null html is an empty payload and joins the group of
    empty ones; a null url is an empty one; a null page_id comes back as null, is smaller than
    any other, and so is a revisit where another page has its payload.  Rows that repeat the
    largest page_id of a payload are all responses.  An empty table gives an empty result;
    other columns are not read.
    """
    spark, directory = pages.sparkSession, fresh_path(pages.sparkSession, "warc")
    write_archives(pages.select("page_id", "url", "html"), directory, least_bytes=least_bytes)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, directory).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: The same from the table alone; base32 comes from four groups of ten hexadecimal digits, eight signs each.
ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS newest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM g
"""
