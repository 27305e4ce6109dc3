"""Folders that are replaced in one step: each version is a folder whose name is its number.

A version is written as a draft beside the others and gets its name in a single rename that fails if the name is
taken.  So a reader sees the version before or the one after, never a part or nothing; and of two writers that start from
the same version one wins, and the other one's draft is deleted and an error raised.  Old versions stay until they are vacuumed, for
readers that still use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAME = "version="


class Conflict(OSError):
    """Another writer has published a version since this one began."""


def _at(spark: SparkSession, path: str):
    """(Hadoop path, its file system, its file context)."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    fs = at.getFileSystem(conf)
    at = fs.makeQualified(at)
    return at, fs, hadoop.FileContext.getFileContext(at.toUri(), conf)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The published versions, ascending."""
    at, fs, _ = _at(spark, path)
    if not fs.exists(at):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(at))
    return sorted(int(n.removeprefix(NAME)) for n in names if n.startswith(NAME) and n.removeprefix(NAME).isdigit())


def folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{NAME}{number}"


def current(spark: SparkSession, path: str) -> str:
    """The folder of the last version; none is an error."""
    found = numbers(spark, path)
    if not found:
        raise FileNotFoundError(f"no version of {path}")
    return folder(path, found[-1])


def publish(spark: SparkSession, path: str, write: Callable[[str], None], *, after: int | None = None) -> int:
    """Have ``write`` fill a folder, and make that the version after ``after`` (the last one, as it is now, without it); its number."""
    if after is None:
        after = max(numbers(spark, path), default=0)
    draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    at, fs, context = _at(spark, draft)
    to = _at(spark, folder(path, after + 1))[0]
    try:
        write(draft)
        rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(at, to, options)
        except Exception as error:
            if fs.exists(to):
                raise Conflict(f"{path} has a version {after + 1} by another writer") from error
            raise
    finally:
        fs.delete(at, True)
    return after + 1


def replace(rows: DataFrame, path: str) -> int:
    """Publish ``rows`` as Parquet; they may come from an earlier version of ``path``."""
    return publish(rows.sparkSession, path, lambda draft: rows.write.parquet(draft))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the last version, or of a given one."""
    return spark.read.parquet(current(spark, path) if number is None else folder(path, number))


def vacuum(spark: SparkSession, path: str, *, keep: int = 1) -> list[int]:
    """Delete all but the last ``keep`` versions, when no reader uses them any more; the numbers deleted.  Drafts of writers at work stay."""
    old = numbers(spark, path)[:-keep] if keep > 0 else numbers(spark, path)
    for number in old:
        at, fs, _ = _at(spark, folder(path, number))
        fs.delete(at, True)
    return old
