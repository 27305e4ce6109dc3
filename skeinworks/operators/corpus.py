"""From messages to conversations, and from sources to one corpus without repeats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.messages import ASSISTANT, USER, characters, role_count, stable_id, transcript_hash

STATUSES = ("base", "base_dup", "expansion_dup", "included")


def conversations(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row for each ``key`` with ``messages``: those of users and assistants, in order, null content empty."""
    kept = turns.where(F.col(role).isin(USER, ASSISTANT))
    entry = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    ordered = F.array_sort(F.collect_list(entry))
    return kept.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def records(rows: DataFrame, dataset: str, source_id: Column, *, exchanges: Column | None = None) -> DataFrame:
    """``rows`` (with ``messages``) as records of the corpus: id, dataset, source_id, counts; other columns stay.

    ``exchanges`` is the source's own number of turns; the smaller of both role counts without it.
    """
    messages = F.col("messages")
    rows = rows.withColumns({"user_messages": role_count(messages, USER), "assistant_messages": role_count(messages, ASSISTANT), "source_id": source_id.cast("string"), "dataset": F.lit(dataset)})
    return rows.withColumns(
        {
            "id": stable_id(F.col("dataset"), F.col("source_id")),
            "exchanges": F.least("user_messages", "assistant_messages") if exchanges is None else exchanges.cast("long"),
            "message_turns": F.size(messages).cast("long"),
            "characters": characters(messages),
        }
    )


def is_qualifying(min_per_role: int = 10) -> Column:
    """Whether a record has at least so many messages of each role."""
    return (F.col("user_messages") >= min_per_role) & (F.col("assistant_messages") >= min_per_role)


def is_long(turns: str = "turn", min_turns: int = 10) -> Column:
    """Whether a record has at least so many turns by the source's own count; null counts as 0."""
    return F.coalesce(turns, F.lit(0)) >= min_turns


def qualifying(rows: DataFrame, min_per_role: int = 10) -> DataFrame:
    return rows.where(is_qualifying(min_per_role))


def long_by_turns(rows: DataFrame, turns: str = "turn", min_turns: int = 10) -> DataFrame:
    return rows.where(is_long(turns, min_turns))


def of_datasets(rows: DataFrame, wanted: Sequence[str], known: Sequence[str]) -> DataFrame:
    """The rows of ``wanted``; a dataset that isn't ``known`` is an error."""
    name = F.when(F.col("dataset").isin(*known), F.col("dataset")).otherwise(F.raise_error(F.concat(F.lit("unknown dataset: "), F.coalesce("dataset", F.lit("null")))))
    return rows.where(name.isin(*wanted))


def dedup_status(base: DataFrame, expansion: DataFrame, *, order: Sequence[str], fingerprint: str = "hash") -> DataFrame:
    """Both, with ``status``: ``base`` rows are kept as they are; of the others those whose fingerprint
    the base has are ``base_dup``, and of equal ones only the first by ``order`` is ``included``, the rest ``expansion_dup``.
    A row without a fingerprint repeats nothing and is ``included``.

    First-seen is decided on thin rows: fingerprint and order only, partially aggregated, so a
    transcript that a large part of all rows shares stays one row for each task.
    """
    place = F.struct(*order)
    known = base.select(F.col(fingerprint).alias("__hash")).distinct().withColumn("__base", F.lit(True))
    first = expansion.groupBy(F.col(fingerprint).alias("__hash")).agg(F.min(place).alias("__first"))
    seen = first.join(known, "__hash", "left")
    marked = expansion.join(seen, expansion[fingerprint] == F.col("__hash"), "left")
    status = F.when(F.col("__base"), "base_dup").when(F.col(fingerprint).isNull() | (place == F.col("__first")), "included").otherwise("expansion_dup")
    return base.withColumn("status", F.lit("base")).unionByName(marked.withColumn("status", status).drop("__hash", "__base", "__first"))


def expand(base: DataFrame, expansion: DataFrame, *, order: Sequence[str], fingerprint: str = "hash") -> DataFrame:
    """The base, untouched, and what the expansion adds to it.  Running it again on a corpus' base rows gives the same corpus."""
    return dedup_status(base, expansion, order=order, fingerprint=fingerprint).where(F.col("status").isin("base", "included")).drop("status")


def manifest(rows: DataFrame) -> DataFrame:
    """conversations, characters and the longest, for each dataset and (dataset null) in all."""
    return rows.rollup("dataset").agg(F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"), F.max("characters").alias("max_characters"))


def expansion_manifest(statuses: DataFrame, by: str = "dataset") -> DataFrame:
    """Counts of qualifying, repeated and included rows of the expansion."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return statuses.where("status <> 'base'").groupBy(by).agg(F.count(F.lit(1)).alias("qualifying"), *(count(s) for s in STATUSES[1:]))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether columns agree, nulls too."""
    return reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


def runs(rows: DataFrame, *, key: str, order: str, part: str, within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``run``: the number, from 1, of the stretch of equal keys (null is a key) in the given order that the row lies in.

    ``part`` is a column that ascends with ``order``: ranges of rows, each small enough for a task.  Each
    gives its first and last key and how often the key changes; these thin rows, in order, tell where each range's first run stands.
    """
    inside = Window.partitionBy(*within, part).orderBy(order)
    first = F.row_number().over(inside) == 1
    change = F.when(first, 0).otherwise((~F.col(key).eqNullSafe(F.lag(key).over(inside))).cast("int"))
    marked = rows.withColumn("__change", change)
    marked = marked.withColumn("__inner", F.sum("__change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*within, part).agg(F.min_by(F.struct(F.col(key).alias("k")), order).alias("__first"), F.max_by(F.struct(F.col(key).alias("k")), order).alias("__last"), F.sum("__change").alias("__changes"))
    across = Window.partitionBy(*within).orderBy(F.asc_nulls_first(part))
    begins = (F.lag(F.lit(1)).over(across).isNull() | ~F.col("__first.k").eqNullSafe(F.lag("__last").over(across)["k"])).cast("int")
    ends = ends.withColumn("__begins", begins)
    earlier = F.coalesce(F.sum(F.col("__changes") + F.col("__begins")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"__at{k}" for k in range(len(within) + 1)]
    ends = ends.select(*(F.col(c).alias(n) for c, n in zip([*within, part], names, strict=True)), (earlier + F.col("__begins")).alias("__earlier"))
    found = marked.join(ends, _same([*within, part], names))
    return found.withColumn("run", F.col("__earlier") + F.col("__inner")).drop("__change", "__inner", "__earlier", *names)


def run_keys(stretches: DataFrame, *, key: str, part: str, within: Sequence[str] = ()) -> DataFrame:
    """One row for each run: its key, with ``#occurrence=n`` from the second run of a key on, and its number of rows.

    A key's runs are numbered inside the range of rows (``part``) that they begin in, after those of earlier ranges.
    """
    found = stretches.groupBy(*within, "run", key).agg(F.count(F.lit(1)).alias("rows"), F.min(part).alias("__part"))
    at = [*within, key, "__part"]
    found = found.withColumn("__nth", F.row_number().over(Window.partitionBy(*at).orderBy("run")))
    before = F.sum("__n").over(Window.partitionBy(*within, key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__at{k}" for k in range(len(at))]
    counts = found.groupBy(*at).agg(F.count(F.lit(1)).alias("__n")).select(*(F.col(c).alias(n) for c, n in zip(at, names, strict=True)), F.coalesce(before, F.lit(0)).alias("__before"))
    found = found.join(counts, _same(at, names)).withColumn("occurrence", F.col("__before") + F.col("__nth"))
    run_key = F.when(F.col("occurrence") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#occurrence="), F.col("occurrence").cast("string")))
    return found.withColumn("run_key", run_key).drop("__nth", "__before", "__part", *names)


def with_hash(rows: DataFrame, fingerprint: str = "hash") -> DataFrame:
    return rows.withColumn(fingerprint, transcript_hash(F.col("messages")))
