"""Files read in ranges, whatever their records look like: pieces between separators, their numbers, and a state that is carried across ranges.

Spark's text reader cuts each file into ranges at the next separator, and says where the range of a piece
begins.  What depends on everything before a piece, its number in the file, or whether it begins inside of quotes, is
found in two steps: inside each range for either state that it may begin in, and across ranges by composing
one thin row for each.  So no task holds a file, and a record may lie across the border of two ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of files that Spark decompresses: their sizes don't tell whether the last line has ended, and they are one range each.
COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
RANGE = ["path", "block"]


def pieces(spark: SparkSession, path: str | list[str], separator: str = "\n", **options: str) -> DataFrame:
    """path, block (where the range begins), id (ascending inside a range, without gaps), piece, size (of the file): every piece of every file below ``path``."""
    found = spark.read.options(lineSep=separator, **options).text(path)
    about = F.col("_metadata")
    return found.select(about["file_path"].alias("path"), about["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece"), about["file_size"].alias("size"))


def numbered(cut: DataFrame) -> DataFrame:
    """path, number (from 0 in each file), piece, ended: whether a separator follows the piece.

    The rows stay where they are read: they meet a row for each range, with the pieces of earlier ones.
    """
    counts = cut.groupBy(*RANGE).agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n"), F.sum(F.octet_length("piece")).alias("__bytes"), F.max("size").alias("__size"))
    earlier, file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__all": F.sum("__n").over(file), "__held": F.sum("__bytes").over(file)})
    whole = F.col("path").rlike(COMPRESSED) | (F.col("__held") + F.col("__all") == F.col("__size"))
    counts = counts.select(F.col("path").alias("__path"), F.col("block").alias("__block"), "__first", "__before", (F.col("__all") - 1).alias("__last"), whole.alias("__whole"))
    number = F.col("__before") + F.col("id") - F.col("__first")
    found = cut.join(counts, (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    return found.select("path", number.alias("number"), "piece", (F.col("__whole") | (number < F.col("__last"))).alias("ended"))


def carried(cut: DataFrame, *, flips: Column, outside: Column, inside: Column) -> DataFrame:
    """``cut`` with ``open``, whether a piece begins in the other state, and ``before``, the sum of what earlier pieces of its file count.

    ``flips`` says whether a piece changes the state; it counts ``outside`` if it begins in the first state, and else ``inside``.
    """
    rows = cut.withColumns({"__flip": flips.cast("int"), "__outside": outside.cast("long"), "__inside": inside.cast("long")})
    before = Window.partitionBy(*RANGE).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    rows = rows.withColumn("__odd", sums("__flip", before) % 2)
    # What a piece counts if its range begins in the first state, and in the other
    first, other = F.when(F.col("__odd") == 0, F.col("__outside")).otherwise(F.col("__inside")), F.when(F.col("__odd") == 0, F.col("__inside")).otherwise(F.col("__outside"))
    rows = rows.withColumns({"__first": first, "__other": other})
    rows = rows.withColumns({"__first_before": sums("__first", before), "__other_before": sums("__other", before)})
    effects = rows.groupBy(*RANGE).agg((F.sum("__flip") % 2).alias("flip"), F.sum("__first").alias("first"), F.sum("__other").alias("other"))
    effects = effects.withColumn("state", sums("flip", earlier) % 2)
    effects = effects.withColumn("so_far", sums(F.when(F.col("state") == 0, F.col("first")).otherwise(F.col("other")), earlier))
    effects = effects.select(F.col("path").alias("__path"), F.col("block").alias("__block"), F.col("state").alias("__state"), F.col("so_far").alias("__so_far"))
    found = rows.join(effects, (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    inner = F.when(F.col("__state") == 0, F.col("__first_before")).otherwise(F.col("__other_before"))
    return found.select(*cut.columns, ((F.col("__odd") + F.col("__state")) % 2 == 1).alias("open"), (F.col("__so_far") + inner).alias("before"))


def _joined(cut: DataFrame, number: Column, separator: str) -> DataFrame:
    """path, number, block (of the first piece), record: the pieces of each record, in order."""
    part = F.struct("block", "id", "piece")
    found = cut.groupBy("path", number.alias("number")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return found.select("path", "number", F.get("parts", F.lit(0))["block"].alias("block"), F.array_join(F.transform("parts", lambda p: p["piece"]), separator).alias("record"))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def csv_records(spark: SparkSession, path: str | list[str], quote: str = '"', **options: str) -> DataFrame:
    """path, number (from 0, the header's), block, record: the records of CSV files as text, fields may hold line ends between quotes; empty lines are none.

    A line begins a record if the quotes before it in the file are even in number; a quote inside of a field is doubled.
    """
    cut = pieces(spark, path, **options).drop("size")
    found = carried(cut, flips=_count(F.col("piece"), quote) % 2, outside=(F.trim(F.regexp_replace("piece", "\r$", "")) != "").cast("int"), inside=F.lit(0))
    empty = ~F.col("open") & (F.trim(F.regexp_replace("piece", "\r$", "")) == "")
    begins = F.when(F.col("open"), 0).otherwise(1)
    whole = _joined(found.where(~empty), F.col("before") + begins - 1, "\n")
    return whole.withColumn("record", F.regexp_replace(F.regexp_replace("record", "^﻿", ""), "\r$", ""))


def _json_parts(spark: SparkSession, path: str | list[str], level: int, **options: str) -> DataFrame:
    """path, number, block, record: what ends with a closing brace that leaves ``level`` braces open, as text without that brace.

    Files are cut at closing braces.  A piece opens what braces it has outside of strings, and its own brace closes one,
    if it stands outside.
    """
    cut = pieces(spark, path, "}", **options).drop("size")
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    quotes = F.size(parts) - 1
    outer = lambda side: F.array_join(F.filter(parts, lambda x, i: i % 2 == side), "")
    cut = cut.withColumns({"__flips": quotes % 2, "__outside": _count(outer(0), "{") - F.when(quotes % 2 == 0, 1).otherwise(0), "__inside": _count(outer(1), "{") - F.when(quotes % 2 == 1, 1).otherwise(0)})
    found = carried(cut, flips=F.col("__flips"), outside=F.col("__outside"), inside=F.col("__inside"))
    left = F.col("before") + F.when(F.col("open"), F.col("__inside")).otherwise(F.col("__outside"))
    closes = F.when(F.col("open"), F.col("__flips") == 1).otherwise(F.col("__flips") == 0)
    found = found.withColumn("__ends", (closes & (left == level)).cast("int")).select("path", "block", "id", "piece", "__ends")
    return _joined(carried(found, flips=F.lit(0), outside=F.col("__ends"), inside=F.col("__ends")), F.col("before"), "}")


def json_records(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """path, number (from 0), block, record: the objects of files that hold a JSON array each, as text, whatever their line breaks."""
    whole = _json_parts(spark, path, 0, **options).withColumn("record", F.regexp_replace("record", r"^[\ufeff\s,\[]+", ""))
    # What follows the last object is no record
    return whole.where(F.trim("record").rlike(r"^\{")).withColumn("record", F.concat("record", F.lit("}")))


def json_entries(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """path, number (from 0), key, value (text): the entries of files that hold a JSON object of objects each."""
    whole = _json_parts(spark, path, 1, **options).withColumn("record", F.regexp_replace("record", r"^[\ufeff\s,{]+", ""))
    entry = r'(?s)^("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:\s*(\{.*)$'
    # What follows the last entry is none
    whole = whole.where(F.col("record").startswith('"'))
    found = whole.select("path", "number", F.regexp_extract("record", entry, 1).alias("key"), F.concat(F.regexp_extract("record", entry, 2), F.lit("}")).alias("value"))
    return found.withColumn("key", F.get(F.from_json(F.concat(F.lit("["), "key", F.lit("]")), "array<string>"), F.lit(0)))
