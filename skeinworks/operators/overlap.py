"""How much of a newer release an older one already holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.operators.corpus import is_long, is_qualifying

#: Where a key occurs: in the existing release, among the qualifying rows of the new one.
OLD, NEW = 1, 2


def _entries(rows: DataFrame, flag: Column, old: Column, long: Column, good: Column, keys: dict[str, str]) -> DataFrame:
    """A thin row for each key of a row: its kind, the key, and what the row counts for."""
    found = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in keys.items())))
    return rows.select(flag.alias("flag"), old.alias("old"), long.cast("long").alias("long"), good.cast("long").alias("good"), found.alias("k")).select("k.*", "flag", "old", "long", "good")


def overlap_report(existing: DataFrame, new: DataFrame, *, min_per_role: int = 10, source: str = "source_id", transcript: str = "hash", turns: str | None = None) -> DataFrame:
    """One row of counts: rows of the new release, those that qualify and don't, how many of these the existing one
    has by source id and by transcript, the repeats among the new by either key, and the distinct keys that are new.

    With ``turns``, the release's own count of turns, only rows with at least ``min_per_role`` of them (null: none) can qualify;
    ``long_not_qualifying`` counts those that have as many and don't.  A null key is in no release.

    Both kinds of keys of both releases are aggregated once, to where each key occurs; counts come from these.  Rows
    that both keys find meet the existing keys in two semi-joins.
    """
    long = F.lit(True) if turns is None else is_long(turns, min_per_role)
    good = F.coalesce(long & is_qualifying(min_per_role), F.lit(False))
    keys, none = {"source": source, "transcript": transcript}, F.lit(0).cast("long")
    entries = _entries(existing, F.lit(OLD), F.lit(1).cast("long"), none, none, keys).unionByName(_entries(new, F.when(good, NEW).otherwise(0), none, F.coalesce(long, F.lit(False)), good, keys).withColumn("new", F.lit(1).cast("long")), allowMissingColumns=True)
    each = entries.groupBy("kind", "key").agg(F.bit_or("flag").alias("where"), *(F.coalesce(F.sum(c), none).alias(c) for c in ("old", "new", "long", "good")))
    known = F.col("key").isNotNull()
    is_old, is_new = known & (F.col("where").bitwiseAND(OLD) > 0), F.col("where").bitwiseAND(NEW) > 0
    of = lambda kind, test, value: F.coalesce(F.sum(F.when((F.col("kind") == kind) & test, value)), none)
    counts, always = {}, F.lit(True)
    for name, plural in (("source", "sources"), ("transcript", "transcripts")):
        counts |= {f"{name}_overlap": of(name, is_old, F.col("good")), f"{name}_new": of(name, ~is_old, F.col("good"))}
        counts |= {f"distinct_{plural}": of(name, known & is_new, F.lit(1)), f"new_{plural}": of(name, known & is_new & ~is_old, F.lit(1)), f"existing_{plural}": of(name, is_old, F.lit(1))}
    counts |= {"existing_rows": of("source", always, F.col("old")), "rows": of("source", always, F.col("new")), "long": of("source", always, F.col("long")), "qualifying": of("source", always, F.col("good"))}
    found = each.agg(*(c.alias(name) for name, c in counts.items()))
    met = new.where(good).select(F.col(source).alias("__s"), F.col(transcript).alias("__t"))
    met = met.join(existing.select(F.col(source).alias("__s")), "__s", "left_semi").join(existing.select(F.col(transcript).alias("__t")), "__t", "left_semi")
    whole = found.join(met.agg(F.count(F.lit(1)).alias("both_overlap")))
    whole = whole.withColumns({f"repeated_{plural}": F.col("qualifying") - F.col(f"distinct_{plural}") for plural in ("sources", "transcripts")})
    whole = whole.withColumns({"not_qualifying": F.col("rows") - F.col("qualifying"), "long_not_qualifying": F.col("long") - F.col("qualifying")})
    first = ["rows", "existing_rows", "existing_sources", "existing_transcripts", "qualifying", "source_overlap", "source_new", "transcript_overlap", "transcript_new", "both_overlap", "distinct_sources", "distinct_transcripts", "new_sources", "new_transcripts"]
    return whole.select(*first, "repeated_sources", "repeated_transcripts", "not_qualifying", "long_not_qualifying")
