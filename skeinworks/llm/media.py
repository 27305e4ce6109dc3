"""Media columns: payloads stored as images in ZIP archives, and a Spark data source that reads them back.

Writing: every partition becomes one archive of lossless 8-bit greyscale PNG images, put in
place by a rename, so a repeated task replaces its own archive and nothing else.

Reading: the driver plans byte ranges from archive sizes alone.  A task loads the directory
of its archive, takes the members that begin in its range, and streams their payloads as
Arrow batches of bounded size.  Members come out of large reads; one that comes out short or
damaged is read again on its own, by its offset, a bounded number of times.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skeinworks.llm.common import arrow_files, fresh_path, key_name, name_key, text_or_empty

#: Samples in an image row; payloads are padded with ``PAD`` to a positive multiple of it.
WIDTH, PAD = 192, b" "
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---- images ----


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode_png(raw: bytes, level: int = 4) -> bytes:
    """``raw``, padded, as a greyscale image ``WIDTH`` samples wide; its own length goes into a text chunk."""
    samples = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # a leading 0: the row isn't filtered
    rows[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return b"".join((PNG_SIGNATURE, _chunk(b"IHDR", header), _chunk(b"tEXt", b"length\0%d" % len(raw)), _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)), _chunk(b"IEND", b"")))


def decode_png(stored: bytes) -> tuple[np.ndarray, int]:
    """The samples (height, width) and the length without padding; ValueError for what is not such an image."""
    if stored[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, shape, length, packed = 8, None, None, []
    while at < len(stored):
        size = int.from_bytes(stored[at : at + 4], "big")
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != int.from_bytes(stored[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
            shape = height, width
        elif kind == b"tEXt" and data.startswith(b"length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not read")
    return rows[:, 1:], shape[0] * shape[1] if length is None else length


def feature(samples: np.ndarray) -> str:
    """Shape, sum, and a 64-bit hash that says which 64ths of the samples are brighter than their mean."""
    flat = samples.astype(np.int64).reshape(64, -1).sum(axis=1)
    bright = np.packbits(flat * 64 > flat.sum()).tobytes().hex()
    return f"{samples.shape[0]}x{samples.shape[1]};sum={flat.sum()};ahash={bright}"


# ---- writing ----


def _write_archive(batches: Iterator[pa.RecordBatch], directory: str) -> Iterator[pa.RecordBatch]:
    fs, base = arrow_files(directory)
    name = f"part-{TaskContext.get().partitionId():06d}.zip"
    draft, members, archive, out = f"{base}/_drafts/{name}.{uuid.uuid4().hex}", 0, None, None
    for batch in batches:
        for key, raw in zip(batch.column(0), batch.column(1), strict=True):
            if archive is None:
                fs.create_dir(f"{base}/_drafts", recursive=True)
                out = fs.open_output_stream(draft)
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
            member = zipfile.ZipInfo(f"k{key_name(key.as_py())}")
            archive.writestr(member, encode_png(raw.as_py() or b""))
            members += 1
    if archive is not None:
        archive.close()
        out.close()
        fs.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": [name], "members": pa.array([members], pa.int64())})


def write_archives(payloads: DataFrame, directory: str, *, key: str, payload: str) -> None:
    """One archive per partition of ``payloads`` below ``directory``; ``key`` names the members (``k`` for null, else ``k=`` and the key, quoted as in a URL), ``payload`` (binary, null: empty) fills them."""
    pairs = payloads.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("binary").alias("payload"))
    written = pairs.mapInArrow(lambda batches: _write_archive(batches, directory), "archive string, members long")
    written.write.parquet(f"{directory}/_manifest")


# ---- reading ----


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def plan_ranges(files: list[tuple[str, int]], range_bytes: int) -> list[ByteRange]:
    """Ranges of about equal size, none longer than ``range_bytes``, that tile every file."""
    ranges = []
    for path, size in files:
        n = max(1, -(-size // range_bytes))
        ranges += [ByteRange(path, size * i // n, size * (i + 1) // n) for i in range(n)]
    return ranges


class DamagedMember(IOError):
    pass


def _payload(read_at, base: int, blob: bytes | None, info: zipfile.ZipInfo) -> bytes:
    """One stored member: out of ``blob`` (which begins at ``base``) or, where that is None, read by its own offset."""
    if blob is None:
        base, blob = info.header_offset, read_at(30 + 2 * 65535 + info.compress_size, info.header_offset)
    at = info.header_offset - base
    head = blob[at : at + 30]
    if len(head) < 30 or head[:4] != b"PK\3\4" or info.compress_type != zipfile.ZIP_STORED:
        raise DamagedMember(f"{info.filename} at {info.header_offset}: no stored member")
    names, extra = struct.unpack_from("<HH", head, 26)
    data = blob[at + 30 + names + extra : at + 30 + names + extra + info.compress_size]
    if len(data) != info.compress_size or binascii.crc32(data) != info.CRC:
        raise DamagedMember(f"{info.filename} at {info.header_offset}: damaged")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        fs, base = arrow_files(self.directory)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return plan_ranges(sorted((f.path, f.size) for f in found if f.path.endswith(".zip")), self.range_bytes) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = arrow_files(self.directory)

        def read_at(size: int, offset: int) -> bytes:
            with fs.open_input_file(partition.path) as file:
                return file.read_at(min(size, file.size() - offset), offset)

        def again(info: zipfile.ZipInfo) -> bytes:
            for left in reversed(range(self.retries)):
                try:
                    return _payload(read_at, 0, None, info)
                except OSError:
                    if not left:
                        raise
            raise DamagedMember(info.filename)

        with fs.open_input_file(partition.path) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if partition.start <= m.header_offset < partition.end]
        members.sort(key=lambda m: m.header_offset)
        first = 0
        while first < len(members):
            base, last = members[first].header_offset, first
            while last + 1 < len(members) and members[last + 1].header_offset + members[last + 1].compress_size - base <= self.batch_bytes:
                last += 1
            end = members[last].header_offset + members[last].compress_size + 30 + 2 * 65535
            try:
                blob = read_at(end - base, base)
            except OSError:
                blob = b""
            payloads = []
            for info in members[first : last + 1]:
                try:
                    payloads.append(_payload(read_at, base, blob, info))
                except DamagedMember:
                    payloads.append(again(info))
            group = members[first : last + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * len(group)), pa.array([m.header_offset for m in group], pa.int64()), pa.array([m.filename for m in group]), pa.array(payloads, pa.binary())],
                names=["archive", "offset", "member", "payload"],
            )
            first = last + 1


class ArchiveSource(DataSource):
    """``spark.read.format("zip_members").load(directory)``; options rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, offset long, member string, payload binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("zip_members").options(**options).load(directory)


# ---- digests ----

DIGESTS = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            stored = stored.as_py()
            samples, length = decode_png(stored)
            payload = samples.tobytes()
            rows.append((name_key(key[1:]), length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])


def media_digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", range_bytes: int = 32 << 20) -> DataFrame:
    """Store every text as an image in archives of the shared folder, read the archives back, and describe what was read.

    One row per row of ``docs`` (repeated rows give repeated rows): ``key`` in its own type and
    the columns of ``DIGESTS``.  A null text is stored like an empty one: one row of padding.
    A null key comes back as null.  An empty table gives an empty result.  Other columns of
    ``docs`` are not read.  A member that stays damaged after all retries fails the query.
    """
    spark, directory = docs.sparkSession, fresh_path(docs.sparkSession, "media")
    bytes_of = docs.select(F.col(key).alias("key"), text_or_empty(text).cast("binary").alias("payload"))
    write_archives(bytes_of, directory, key="key", payload="payload")
    stored = read_archives(spark, directory, rangeBytes=str(range_bytes)).select("member", "payload")
    found = stored.mapInArrow(_digest_batches, DIGESTS)
    return found.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *[c.split()[0] for c in DIGESTS.split(", ")][1:])
