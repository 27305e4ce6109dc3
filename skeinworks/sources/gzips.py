"""Gzipped lines that can be read in pieces: files of many gzip members, and an index of where each member begins.

To any other reader such a file is one gzip stream.  A member holds whole lines, about a megabyte of them, so a task
can begin at any, and a line's number in its part follows from the index.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources.files import opened

#: Bytes of lines in a member, about, and of members that a task reads.
MEMBER_BYTES, TASK_BYTES = 1 << 20, 32 << 20
#: Where the index lies below a folder: Spark's readers don't look into it.
INDEX_FOLDER, INDEX = "_index", "part long, file string, offset long, length long, first long, lines long"
FILE = "lines.json.gz"


class _PartFile:
    """A part's file while it is written, under another name until it is whole: a task that is tried again replaces it."""

    def __init__(self, path: str, part: int, member_bytes: int):
        self.part, self.member_bytes, self.name = part, member_bytes, f"part={part}/{FILE}"
        self.fs, self.folder = opened(f"{path}/part={part}")
        self.fs.create_dir(self.folder, recursive=True)
        self.draft = f"{self.folder}/.{FILE}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft, compression=None)
        self.held, self.size, self.index, self.offset, self.first = [], 0, [], 0, 0

    def add(self, line: bytes) -> None:
        self.held.append(line)
        self.size += len(line) + 1
        if self.size >= self.member_bytes:
            self.end_member()

    def end_member(self) -> None:
        if self.held:
            member = gzip.compress(b"\n".join(self.held) + b"\n", mtime=0)
            self.out.write(member)
            self.index.append((self.part, self.name, self.offset, len(member), self.first, len(self.held)))
            self.offset, self.first, self.held, self.size = self.offset + len(member), self.first + len(self.held), [], 0

    def close(self) -> list[tuple]:
        self.end_member()
        self.out.close()
        self.fs.move(self.draft, f"{self.folder}/{FILE}")
        return self.index


def write(lines: DataFrame, path: str, member_bytes: int = MEMBER_BYTES) -> None:
    """``lines`` (part, place, value) as a file for each part, its lines in order of place, and the index.  Values hold no line ends."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file is None or file.part != part:
                    if file:
                        yield rows(file.close())
                    file = _PartFile(path, part, member_bytes)
                file.add(value.as_buffer().to_pybytes())
        if file:
            yield rows(file.close())

    def rows(index: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in index], pa.string() if names[k] == "file" else pa.int64()) for k in range(len(names))], names=names)

    ordered = lines.repartition("part").sortWithinPartitions("part", "place")
    ordered.select(F.col("part").cast("long"), F.col("value").cast("binary")).mapInArrow(run, INDEX).write.json(f"{path}/{INDEX_FOLDER}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, place (from 0 in the part), value: every line, members dealt out to tasks."""
    index = spark.read.schema(INDEX).json(f"{path}/{INDEX_FOLDER}")
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    members = index.repartition(max(1, -(-size // TASK_BYTES)), "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = opened(f"{path}/{r['file']}")
                with fs.open_input_file(at) as source:
                    source.seek(r["offset"])
                    member = source.read(r["length"])
                found = gzip.decompress(member).split(b"\n")[:-1]
                if len(found) != r["lines"]:
                    raise OSError(f"{r['file']} has {len(found)} lines at {r['offset']}, not {r['lines']}")
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(found), pa.int64()), pa.array(range(r["first"], r["first"] + len(found)), pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], names=["part", "place", "value"])

    return members.mapInArrow(run, "part long, place long, value string")


def is_indexed(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{INDEX_FOLDER}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
