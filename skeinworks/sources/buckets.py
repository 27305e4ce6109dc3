"""A cache of records by key, in buckets: a store writes the buckets that change, and no others.

Records are dealt to buckets by a hash of the key.  The cache is a sequence of small manifests (``versions``) that name the
folders of each bucket: a base, and what was appended since.  A store compares the incoming records with the buckets they
fall into, once; a bucket with a replaced record gets a new base, others get what is new to them, and a new manifest makes
all of that visible in one step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources import versions

#: Buckets of a new cache; appended folders of a bucket before ``compact`` joins them.
BUCKETS, MOST_APPENDED = 64, 8
MANIFEST = "bucket int, buckets int, kind string, folder string, rows long"
UNCHANGED, APPENDED, REWRITTEN = "unchanged", "appended", "rewritten"


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """bucket, buckets (how many there are), kind (base or appended), folder (below ``path``), rows."""
    at = versions.current(spark, path) if number is None else versions.folder(path, number)
    return spark.read.schema(MANIFEST).json(at)


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("__bucket")


def _folders(spark: SparkSession, path: str, names: list[str], schema) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/{n}" for n in names))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records, each key once."""
    names = [r["folder"] for r in manifest(spark, path).collect()]  # a row for each folder of a bucket
    return spark.read.parquet(*(f"{path.rstrip('/')}/{n}" for n in names))


def _written(rows: DataFrame, path: str) -> str:
    """A folder of ``rows`` (with ``__bucket``) below ``path``, a sub-folder for each bucket with one file of it; its name."""
    name = f"data/{uuid.uuid4().hex}"
    rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path.rstrip('/')}/{name}")
    return name


def _published(spark: SparkSession, path: str, rows: list[tuple], after: int) -> None:
    versions.publish(spark, path, lambda draft: spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(draft), after=after)


def store(incoming: DataFrame, path: str, *, key: str = "id", buckets: int = BUCKETS) -> dict[str, int]:
    """Put records (of distinct keys) into the cache: how many were ``unchanged``, ``appended``, ``rewritten``, and ``kept`` from before.

    Another writer's version since this one began is an error (``versions.Conflict``), and leaves the cache as that one made it.
    A null key, or one that comes twice, is an error.
    """
    spark = incoming.sparkSession
    known = versions.numbers(spark, path)
    after = known[-1] if known else 0
    before = manifest(spark, path, after).collect() if known else []
    buckets = before[0]["buckets"] if before else buckets
    rows = incoming.withColumn("__bucket", _bucket(key, buckets))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if not counts.where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        raise ValueError("records need distinct keys, none null")
    touched = {r["__bucket"] for r in rows.select("__bucket").distinct().collect()}  # as many as there are buckets
    old = _folders(spark, path, [r["folder"] for r in before if r["bucket"] in touched], incoming.schema).withColumn("__bucket", _bucket(key, buckets))
    others = [c for c in incoming.columns if c != key]
    packed = lambda df, name: df.select(key, "__bucket", F.struct(*others).alias(name))
    both = packed(old, "old").join(packed(rows, "new"), [key, "__bucket"], "full_outer")
    status = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), APPENDED).when(F.col("old") == F.col("new"), UNCHANGED).otherwise(REWRITTEN)
    marked = both.select(key, "__bucket", status.alias("__status"), F.coalesce("new", "old").alias("value"))
    staged = f"{path.rstrip('/')}/data/_staged-{uuid.uuid4().hex}"
    marked.write.parquet(staged)  # compared once: counts and both kinds of write come from here
    try:
        marked = spark.read.schema(marked.schema).parquet(staged)
        found = marked.groupBy("__bucket", "__status").agg(F.count(F.lit(1)).alias("n")).collect()  # four rows a bucket at most
        n = {(r["__bucket"], r["__status"]): r["n"] for r in found}
        changed = sorted({b for b, s in n if s == REWRITTEN})
        grown = sorted({b for b, s in n if s == APPENDED} - set(changed))
        total = {s: sum(x for (_, t), x in n.items() if t == s) for s in (UNCHANGED, APPENDED, REWRITTEN)}
        total["kept"] = sum(r["rows"] for r in before) - total[UNCHANGED] - total[REWRITTEN]
        if changed or grown:
            values = lambda df: df.select(key, "value.*", "__bucket").select(*incoming.columns, "__bucket")
            every, fresh = F.col("__bucket").isin(changed), F.col("__bucket").isin(grown) & (F.col("__status") == APPENDED)
            name = _written(values(marked.where(every | fresh)), path)
            size = lambda b: sum(x for (c, _), x in n.items() if c == b)
            at = [(r["bucket"], buckets, r["kind"], r["folder"], r["rows"]) for r in before if r["bucket"] not in changed]
            at += [(b, buckets, "base", f"{name}/__bucket={b}", size(b)) for b in changed]
            have = {r["bucket"] for r in before}
            at += [(b, buckets, "appended" if b in have else "base", f"{name}/__bucket={b}", n[b, APPENDED]) for b in grown]
            _published(spark, path, at, after)
    finally:
        at, fs, _ = versions._at(spark, staged)
        fs.delete(at, True)
    return {k: v for k, v in total.items() if v}


def compact(spark: SparkSession, path: str, *, most: int = MOST_APPENDED) -> list[int]:
    """One folder each for the buckets that have more than ``most`` appended ones; their numbers.  Others aren't read."""
    after = versions.numbers(spark, path)[-1]
    before = manifest(spark, path, after).collect()
    appended: dict[int, int] = {}
    for r in before:
        appended[r["bucket"]] = appended.get(r["bucket"], 0) + (r["kind"] == "appended")
    full = sorted(b for b, n in appended.items() if n > most)
    if full:
        rows = None
        for b in full:
            part = spark.read.parquet(*(f"{path.rstrip('/')}/{r['folder']}" for r in before if r["bucket"] == b)).withColumn("__bucket", F.lit(b))
            rows = part if rows is None else rows.unionByName(part)
        name = _written(rows, path)
        at = [(r["bucket"], r["buckets"], r["kind"], r["folder"], r["rows"]) for r in before if r["bucket"] not in full]
        at += [(b, before[0]["buckets"], "base", f"{name}/__bucket={b}", sum(r["rows"] for r in before if r["bucket"] == b)) for b in full]
        _published(spark, path, at, after)
    return full
