"""What files a release should have, and whether they are there in full."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources import files

SCHEMA = "dataset string, file string, bytes long"


def inventory(spark: SparkSession, files: list[tuple[str, str, int]]) -> DataFrame:
    """(dataset, file, bytes) as pinned by the caller."""
    return spark.createDataFrame(files, SCHEMA)


#: A pinned release: where its files come from, at which revision, and where they go.
RELEASES = "dataset string, repository string, revision string, folder string, remote string, file string, bytes long"


def pinned_releases(spark: SparkSession, releases: list[tuple]) -> DataFrame:
    """A row for each file of each release, as pinned by the caller (``RELEASES``)."""
    return spark.createDataFrame(releases, RELEASES)


def selected(pinned: DataFrame, datasets: Sequence[str] = ()) -> DataFrame:
    """The files of some datasets, all without a choice; one that isn't pinned is an error, raised where the rows are computed."""
    if not datasets:
        return pinned
    wanted = pinned.sparkSession.createDataFrame([(d,) for d in datasets], "__wanted string").distinct()
    both = wanted.join(pinned, F.col("__wanted") == F.col("dataset"), "left")
    known = F.when(F.col("dataset").isNull(), F.raise_error(F.concat(F.lit("unknown dataset: "), "__wanted")).cast("boolean")).otherwise(F.lit(True))
    return both.where(known).select(pinned.columns)


def fetch_list(pinned: DataFrame, present: DataFrame, url: str = "https://huggingface.co/datasets/{repository}/resolve/{revision}/{remote}") -> DataFrame:
    """dataset, file, state, url, start: what is still to be fetched, and from which byte on: partial files go on where they end, complete ones aren't listed.

    ``present`` has folder, file, length.  A file longer than pinned is listed as ``oversize``, to be looked at, from byte 0.
    """
    have = present.select(F.col("folder").alias("__folder"), F.col("file").alias("__file"), "length")
    both = pinned.join(have, (F.col("folder") == F.col("__folder")) & (F.col("file") == F.col("__file")), "left")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") < F.col("bytes"), "partial").when(F.col("length") > F.col("bytes"), "oversize")
    parts = re.split(r"\{(\w+)\}", url)
    address = F.concat(*(F.col(x) if k % 2 else F.lit(x) for k, x in enumerate(parts)))
    start = F.when(F.col("length") < F.col("bytes"), F.col("length")).otherwise(0)
    return both.withColumn("state", state).where("state IS NOT NULL").select("dataset", "file", "state", address.alias("url"), start.cast("long").alias("start"))


def described(pinned: DataFrame, raw: str) -> DataFrame:
    """dataset, said: ``dataset: repository@revision (n files, x GB) -> folder`` for each release."""
    found = pinned.groupBy("dataset", "repository", "revision", "folder").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    said = F.concat("dataset", F.lit(": "), "repository", F.lit("@"), "revision", F.lit(" ("), F.col("n").cast("string"), F.lit(" files, "), F.format_string("%.3f", F.col("bytes") / 1e9), F.lit(f" GB) -> {raw}/"), "folder")
    return found.select("dataset", said.alias("said"))


def require_shards(df: DataFrame, expected: int) -> DataFrame:
    """``df`` if its files are as many as expected."""
    found = len(df.inputFiles())
    if found != expected:
        raise ValueError(f"expected {expected} shards, found {found}")
    return df


def totals(pinned: DataFrame) -> DataFrame:
    return pinned.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def verify_sizes(pinned: DataFrame, present: DataFrame) -> DataFrame:
    """``pinned`` with ``state``: missing, partial, complete or oversize, from what is present (file, length)."""
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") < F.col("bytes"), "partial").when(F.col("length") > F.col("bytes"), "oversize").otherwise("complete")
    return pinned.join(present.select("file", "length"), "file", "left").withColumn("state", state)


def present_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file, length of everything below ``path`` but empty files; contents aren't read."""
    return files.listed(spark, path)


def verify_hashes(pinned: DataFrame, present: DataFrame) -> DataFrame:
    """``pinned`` (file, bytes, sha256) with ``state``: as ``verify_sizes``, and ``changed`` for a complete file of other content.  Only complete files are read."""
    sized = verify_sizes(pinned.withColumnRenamed("sha256", "pinned_sha256"), present)
    at = present.select(F.col("file").alias("__file"), "path")
    read = sized.where(F.col("state") == "complete").join(at, F.col("file") == F.col("__file")).drop("__file")
    content = F.when(F.col("sha256") == F.col("pinned_sha256"), "complete").otherwise("changed")
    return files.hashed(read, "bytes").withColumn("state", content).drop("path", "sha256").unionByName(sized.where(F.col("state") != "complete"))
