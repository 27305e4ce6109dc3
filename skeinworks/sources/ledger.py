"""Ledgers of JSON lines that may be caught in the middle of a write, and their snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.sources import files, ranges, versions


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0), line, ended, parsed: every line of every file below ``path``, split at newlines only.

    Files are read in ranges, so they may have any size; only the last line of a file can lack its end.
    """
    found = ranges.numbered(ranges.pieces(spark, path))
    return found.select("path", F.col("number").alias("line_no"), F.col("piece").alias("line"), "ended", F.expr("try_parse_json(piece)").isNotNull().alias("parsed"))


def _rows(found: DataFrame, schema: str) -> DataFrame:
    return found.select("path", "line_no", F.from_json("line", schema).alias("r")).select("path", "line_no", "r.*")


def _checked(found: DataFrame, bad) -> DataFrame:
    good = F.when(bad, F.raise_error(F.concat(F.lit("broken line "), (F.col("line_no") + 1).cast("string"), F.lit(" in "), "path")).cast("boolean")).otherwise(F.lit(True))
    return found.where(good)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must parse, blank ones are skipped; a missing file is an error."""
    found = lines(spark, path).where(F.trim("line") != "")
    return _rows(_checked(found, ~F.col("parsed")), schema)


def completed_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The distinct ids of the lines that parse; whatever doesn't is skipped, a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.schema(f"{key} string").option("mode", "DROPMALFORMED").json(path).select(key).where(F.col(key).isNotNull()).distinct()


def tolerant(spark: SparkSession, path: str, schema: str, *, missing_ok: bool = True) -> DataFrame:
    """An unparsed last line without an end is a write in progress and left out; any other unparsed line is an error."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType())])).select("*", F.from_json(F.lit(None).cast("string"), schema).alias("r")).select("path", "line_no", "r.*")
    found = lines(spark, path).where((F.trim("line") != "") & (F.col("ended") | F.col("parsed")))
    return _rows(_checked(found, ~F.col("parsed")), schema)


def latest(rows: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """The last record of each id; one without an id is an error."""
    named = F.when(F.coalesce(F.length(key), F.lit(0)) > 0, F.lit(True)).otherwise(F.raise_error(F.lit("a record without an id")).cast("boolean"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.where(named).withColumn("__n", place).where("__n = 1").drop("__n")


def keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """The older cache format, a JSON object of id to record, as rows; the file is read in ranges (``ranges.json_entries``)."""
    found = ranges.json_entries(spark, path)
    return found.select("key", F.from_json("value", value_schema).alias("r")).select(F.col("key").alias("id"), "r.*")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, file, bytes, json_lines, sha256 of the complete lines of each file (up to its last newline); a complete line that isn't empty and doesn't parse is an error."""
    complete = lines(spark, path).where("ended")
    kept = _checked(complete, (F.col("line") != "") & ~F.col("parsed"))
    counts = kept.groupBy(F.col("path").alias("__path")).agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.count(F.lit(1)).alias("json_lines"))
    every = files.listed(spark, path).join(counts, F.col("path") == F.col("__path"), "left")
    whole = every.select("path", "file", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "json_lines")))
    return files.hashed(whole, "bytes")


def append(rows: DataFrame, path: str, *, by: str | None = None) -> None:
    """Add rows to a ledger folder, a sub-folder for each value of ``by``."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def split_errors(results: DataFrame, path: str, errors: str) -> None:
    """Results go to one ledger, rows with an ``error`` to another; they are computed once, and stored for the two writes."""
    spark, staged = results.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        results.write.parquet(staged)
        found = spark.read.schema(results.schema).parquet(staged)
        append(found.where(F.col("error").isNull()).drop("error"), path)
        append(found.where(F.col("error").isNotNull()).select("id", "dataset", "error"), errors)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def compact(rows: DataFrame, path: str, key: str = "id", order: str = "line_no") -> int:
    """Publish a cache (``versions``) of the latest record of each id, sorted by id; its version."""
    return versions.replace(latest(rows, key, order).orderBy(key), path)


def migrate(spark: SparkSession, legacy: str, path: str, value_schema: str) -> int:
    """Turn the older cache into a new one, sorted by id, where there is no new one yet; the number of records moved."""
    if versions.numbers(spark, path) or not exists(spark, legacy):
        return 0
    versions.replace(keyed_json(spark, legacy, value_schema).orderBy("id"), path)
    return versions.read(spark, path).count()
