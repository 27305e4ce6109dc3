"""Corpora and reports as files: parts in source order, documents of JSON, CSV with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.sources import gzips

#: Records of a part of an ordered corpus.
PART_ROWS = 100_000


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` of ``readers.union_sources`` with ``position``, from 0: by source, file and row.

    Positions come from a count of each file and a window inside it, so no task orders them all.
    """
    counts = rows.groupBy("source_order", "source_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("source_order", "source_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("source_order").alias("__s"), F.col("source_file").alias("__f"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("source_order", "source_file").orderBy("row")) - 1
    same = (F.col("source_order") == F.col("__s")) & F.col("source_file").eqNullSafe(F.col("__f"))
    return rows.withColumn("__inside", inside).join(starts, same).withColumn("position", F.col("__before") + F.col("__inside")).drop("__s", "__f", "__before", "__inside")


def write_ordered(rows: DataFrame, path: str, *, position: str = "position", part_rows: int = PART_ROWS, member_bytes: int = gzips.MEMBER_BYTES) -> None:
    """Gzipped JSON lines in order of ``position``: a file for each ``part_rows`` positions, of many members with an index (``gzips``)."""
    value = F.to_json(F.struct(*(c for c in rows.columns if c != position)), {"ignoreNullFields": "false"})
    gzips.write(rows.select((F.col(position) / part_rows).cast("long").alias("part"), F.col(position).alias("place"), value.alias("value")), path, member_bytes)


def read_ordered(spark: SparkSession, path: str, schema: str, *, part_rows: int = PART_ROWS) -> DataFrame:
    """The records of ``write_ordered`` with ``place``, from 0: the part's first, and the line in it; tasks begin at members."""
    lines = gzips.read(spark, path)
    return lines.select((F.col("part") * part_rows + F.col("place")).alias("place"), F.from_json("value", schema).alias("r")).select("place", "r.*")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_json(row: DataFrame, path: str) -> None:
    """A report of one row as one JSON document."""
    row.coalesce(1).write.option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row, whatever its line breaks."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _by_dataset(value: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(F.col("dataset").isNotNull(), F.struct("dataset", value))))
    return F.map_from_entries(rows).alias(value)


def manifest_document(manifest: DataFrame, *, minimum: int) -> DataFrame:
    """The rows of ``corpus.manifest`` as one: maps by dataset, and the totals of all."""
    total = lambda c: F.max(F.when(F.col("dataset").isNull(), F.col(c)))
    found = manifest.agg(_by_dataset("conversations"), _by_dataset("characters"), _by_dataset("max_characters"), total("conversations").alias("all"), total("characters").alias("all_characters"))
    return found.select(
        F.lit(minimum).alias("minimum"), F.col("conversations").alias("counts"), "characters", F.col("max_characters").alias("maximum_characters"),
        F.col("all").alias("total_conversations"), F.col("all_characters").alias("total_characters"),
    )


def raw_counts(spark: SparkSession, path: str, *, renamed: dict[str, str] | None = None) -> DataFrame:
    """dataset, rows out of a report's ``summaries``; ``renamed`` gives datasets the corpus' names."""
    found = read_json(spark, path, "summaries array<struct<dataset:string,total_conversations:long>>").select(F.explode("summaries").alias("s"))
    name = F.col("s.dataset")
    for old, new in (renamed or {}).items():
        name = F.when(F.col("s.dataset") == old, new).otherwise(name)
    return found.select(name.alias("dataset"), F.col("s.total_conversations").alias("rows"))
