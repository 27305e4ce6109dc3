"""What the operators of this subpackage share: tables, the shared folder, sampling."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder that the package lies in.
HOME = str(Path(__file__).resolve().parents[2])


def show_workers_the_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did; a cluster gets it with ``--py-files``."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if HOME not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (paths, HOME)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    show_workers_the_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where it has too few files for them; a large table stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


#: Folders made for sessions on one machine that name none, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where a session on one machine has neither, as in tests, a folder of its own, the same for the whole session; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dirs.get(context.applicationId) or tempfile.mkdtemp(prefix="skeinworks-")
        _own_dirs[context.applicationId] = found
    return found if "://" in found or found.startswith("file:") else _qualified(spark, found)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme as Spark's default file system has it, so that Spark and Arrow mean the same folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


#: Paths that operators have used since, for each ``intermediates`` that is open.
_open: list[list[str]] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nobody has used."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    for used in _open:
        used.append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, whatever operators have written to the shared folder inside: for callers that have stored a result by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            deleted(spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_files(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a folder as Spark names it; S3 and DBFS have other names there."""
    scheme, mark, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        uri = f"file:///dbfs/{rest.lstrip('/')}"
    elif scheme == "file":
        uri = f"file:///{rest.lstrip('/')}"
    return pafs.FileSystem.from_uri(uri)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later uses don't compute it again, and lost executors lose nothing of it."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def key_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sampled(df: DataFrame, bound: int, *keys: str, seed: str = "fit") -> DataFrame:
    """All rows while there are no more than ``bound``, else a sample of the distinct ``keys`` by their hash, a row for each: the same on every run.

    The rate comes from a count of all rows, so a sample is ``bound`` rows at most, plus the noise of a
    binomial draw: rows that repeat their keys can't outgrow it.  ``keys`` should be all columns, or rows that share them alike.
    """
    n = df.count()
    if n <= bound:
        return df
    at = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30))
    return df.where(at < int(bound / n * (1 << 30))).dropDuplicates(list(keys))


def text_slices(batches: Iterator[pa.RecordBatch], at: int, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in column ``at`` come to about ``chars`` bytes, or are one text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + chars, "right")))
            yield batch.slice(start, end - start)
            start = end


def handed_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at the end of the task its worker, which other stages will use, gives unused memory back: Arrow's, and that of the C library where it can."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def key_name(key: str | None) -> str:
    """A key as part of a name in an archive, whatever its characters; a null key has the empty name."""
    return "" if key is None else f"={quote(key, safe='')}"


def name_key(name: str) -> str | None:
    return unquote(name[1:]) if name else None
