"""Files by their names: what lies below a path, and hashes of files of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task holds at once.
BLOCK = 4 << 20


def listed(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """path, file, length of everything below ``path`` but empty files, which Spark doesn't list; contents aren't read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "length")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a file as Spark names it; S3 and DBFS have other names there."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        uri = f"file:///dbfs/{rest.lstrip('/')}"
    elif scheme == "file":
        uri = f"file:///{rest.lstrip('/')}"
    return pafs.FileSystem.from_uri(uri)


def sha256_of(uri: str, upto: int) -> str:
    """The SHA-256 of a file's first ``upto`` bytes, read in blocks; a shorter file is an error."""
    fs, path = opened(uri)
    found, left = hashlib.sha256(), upto
    with fs.open_input_stream(path) as source:
        while left:
            block = source.read(min(left, BLOCK))
            if not block:
                raise OSError(f"{uri} ends {left} bytes early")
            found.update(block)
            left -= len(block)
    return found.hexdigest()


def hashed(files: DataFrame, upto: str = "length") -> DataFrame:
    """``files`` with ``sha256`` of the first ``upto`` bytes of the file at ``path``.  A file is read by one task, as the hash needs its bytes in order, and is never held."""
    rows = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[sha256_of(p, int(n)) for p, n in zip(batch["path"], batch[upto], strict=True)])

    return rows.mapInPandas(run, schema)
