"""Content fingerprints, and what they say about caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.messages import compact_json


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the compact JSON of named values, names sorted."""
    return F.sha2(compact_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def document_fingerprint(cases: DataFrame, version: int, *, level: str = "level", order: str = "id", fp: str = "fingerprint") -> DataFrame:
    """level, fingerprint of a document: over its cases' fingerprints in order of their ids."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, fp))), lambda c: c[fp])
    rows = cases.groupBy(level).agg(ordered.alias("cases"))
    return rows.select(level, fingerprint(cases=F.col("cases"), format_version=F.lit(version), level=F.col(level)).alias(fp))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Cached fragments from JSON lines; what can't be read is no fragment, so a miss."""
    return spark.read.schema("id string, fingerprint string, version int, body string").option("mode", "DROPMALFORMED").json(path)


def fragment_status(wanted: DataFrame, cached: DataFrame, version: int, *, key: str = "id", fp: str = "fingerprint") -> DataFrame:
    """key, status: ``hit`` if the cache has a body of the same fingerprint and version, else ``miss``."""
    have = cached.where((F.col("version") == version) & (F.coalesce(F.length("body"), F.lit(0)) > 0)).select(key, fp, F.lit(True).alias("__hit")).distinct()
    return wanted.select(key, fp).join(have, [key, fp], "left").select(key, F.when(F.col("__hit"), "hit").otherwise("miss").alias("status"))


def upsert_status(cache: DataFrame, incoming: DataFrame, *, key: str = "id", value: str = "value") -> DataFrame:
    """key, status: ``unchanged``, ``appended`` or ``rewritten`` for incoming records, ``kept`` for the cache's others."""
    both = cache.select(key, F.struct(value).alias("old")).join(incoming.select(key, F.struct(value).alias("new")), key, "full_outer")
    status = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "appended").when(F.col("old") == F.col("new"), "unchanged").otherwise("rewritten")
    return both.select(key, status.alias("status"))


def is_current(rows: DataFrame, version: int) -> DataFrame:
    """Whether an output's manifest (format_version, document_fingerprint, output_sha256) fits what is expected and on file."""
    same = (F.col("format_version") == version) & (F.col("document_fingerprint") == F.col("expected_fingerprint")) & (F.col("output_sha256") == F.col("file_sha256"))
    return rows.withColumn("current", F.coalesce(same, F.lit(False)))
