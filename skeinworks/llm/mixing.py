"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end as one stream of words,
repeated three times, and cut into blocks of equal length up to the source's target, the last block as long as what the target lacks.
The mix is a sequence of slots.  Slot i has the golden-ratio point (i + 1) * 2654435769 / 2**32 mod 1; the
cumulative blocks of the sources map it to a source, and the slots of a source, ranked, take its blocks in order until none is left.
There are twice as many slots as blocks, as the widest gap between such points is less than two of their mean gaps; a block that found none
would follow after all slots.

All work is DataFrame expressions.  Ranks and positions in a large source come from sums per
chunk (of slots) or per range of hashes (of documents) plus a window inside each, so no
source has to fit into a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.common import text_or_empty, written

#: Weights of the sources by rank, repeating; times that a source may be read.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
#: Slots aimed at, and words of a block at most: beyond their product there are more slots.
SLOTS, MAX_BLOCK_WORDS = 1 << 17, 1 << 16
#: 2**32 over the golden ratio, the step of the points.
GOLDEN, POINTS = 2654435769, 1 << 32
#: Cells of the unit interval in which slots meet the sources' intervals.
CELLS = 1 << 12
#: Slots of a chunk, and documents of a range of hashes, about.
CHUNK_SLOTS, RANGE_DOCS = 1 << 14, 20_000

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row for each source with its words.

    Sources by code point (null last) weigh 5, 2, 1, repeating, and share all words; a target
    stops at three times its source, and the excess is shared by weight among the others.
    Sorted by words per weight, those before any source being full gives each a level that all
    others could reach; the highest level is the one that uses everything.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", (MOST_EPOCHS * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    fuller = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    words = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(fuller), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fuller), F.lit(0.0))
    rows = rows.withColumn("level", words / open_weight)
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """source, block, slot: where in the mix each block of a source comes, blocks from 0 up to the source's target."""
    spark = shares.sparkSession
    order = Window.orderBy(F.asc_nulls_last("source"))
    counted = shares.select("source", F.expr(f"(CAST(round(target) AS BIGINT) + {block - 1}) div {block}").alias("blocks"))
    bounds = counted.withColumn("upto", F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("blocks").over(Window.partitionBy()))
    bounds = written(bounds.where("blocks > 0"), "bounds")
    total = bounds.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    high = F.round(F.col("upto") / F.col("total") * POINTS).cast("long")
    bounds = bounds.withColumns({"high": high, "low": F.round((F.col("upto") - F.col("blocks")) / F.col("total") * POINTS).cast("long")})
    width = POINTS // CELLS
    intervals = bounds.select("source", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("cell"))
    points = spark.range(2 * total).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 1) * {GOLDEN}L, {POINTS}L)").alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {width}"))
    taken = points.join(intervals, "cell").where("point >= low AND point < high").select("slot", "source", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    # By rank of the chunk's slots in the source, and the slots of earlier chunks
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = taken.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    ranked = taken.withColumn("inside", inside).alias("t").join(earlier.alias("e"), F.expr("t.source <=> e.source AND t.chunk = e.chunk"))
    ranked = ranked.select("t.slot", "t.source", (F.col("t.inside") + F.col("e.before")).cast("long").alias("rank"))
    every = bounds.select("source", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), (2 * F.col("total") + F.col("upto") - F.col("blocks")).alias("after"))
    both = every.alias("b").join(ranked.alias("r"), F.expr("b.source <=> r.source AND b.block = r.rank"), "left")
    return both.select("b.source", "b.block", F.coalesce("r.slot", F.col("b.after") + F.col("b.block")).alias("slot"))


def shuffled(sized: DataFrame, docs: int) -> DataFrame:
    """``sized`` (doc_id, source, size, mark) with ``start``, a document's place in its source's stream by ``mark``, and ``nth``, which tells wholly repeated rows apart: these are one row until they have a place."""
    digits = max(0, math.ceil(math.log(max(1, docs / RANGE_DOCS), 16)))
    rows = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("copies")).withColumn("part", F.substring("mark", 1, digits))
    rows = rows.withColumn("words", F.col("size") * F.col("copies"))
    inside = Window.partitionBy("source", "part").orderBy("mark", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("words").over(inside))
    earlier = rows.groupBy("source", "part").agg(F.sum("words").alias("words")).select("source", "part", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = rows.alias("r").join(earlier.alias("e"), F.expr("r.source <=> e.source AND r.part = e.part"))
    placed = both.select("r.doc_id", "r.source", "r.size", "r.mark", (F.col("r.upto") - F.col("r.words") + F.col("e.before")).alias("first"), F.explode(F.expr("sequence(0L, r.copies - 1)")).alias("nth"))
    return placed.withColumn("start", (F.col("first") + F.col("nth") * F.col("size")).cast("long")).drop("first")


@dataclass
class Mix:
    """The documents in their places with their sources' targets, and where each of a source's blocks comes."""

    placed: DataFrame
    plan: DataFrame
    block: int

    def stretches(self) -> DataFrame:
        """slot and the document's row (doc_id, source, size, mark, nth), epoch, first (word, from 0) and words: every stretch of a document that a slot takes.

        In order of slot, source and epoch, start this is the mix.  Documents that no block takes have none.
        """
        at = F.transform(F.array(*(F.lit(e) for e in range(MOST_EPOCHS))), lambda e: F.struct(e.alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at")))
        rows = self.placed.where("size > 0").select("*", F.explode(at).alias("e")).select("*", "e.epoch", "e.at").where("at < upto").drop("e")
        crossed = F.expr(f"sequence(at div {self.block}, (least(at + size, upto) - 1) div {self.block})")
        rows = rows.withColumn("block", F.explode(crossed))
        first = F.greatest("at", F.col("block") * self.block)
        last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * self.block, F.col("upto"))
        rows = rows.select("doc_id", "source", "size", "mark", "nth", "epoch", "block", (first - F.col("at")).alias("first"), (last - first).alias("words"))
        both = rows.alias("p").join(self.plan.alias("b"), F.expr("p.source <=> b.source AND p.block = b.block"))
        return both.select("b.slot", "p.doc_id", "p.source", "p.size", "p.mark", "p.nth", "p.epoch", "p.first", "p.words")


def planned(docs: DataFrame, slots: int = SLOTS) -> Mix:
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_or_empty()).cast("binary"))
    sized = written(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), mark.alias("mark")), "sizes")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    block = min(MAX_BLOCK_WORDS, max(1, -(-total // slots)))
    known = sources.withColumn("upto", F.round("target").cast("long"))
    placed = shuffled(sized, sized.count()).alias("p").join(known.alias("s"), F.expr("p.source <=> s.source"), "left").select("p.*", "s.source_size", "s.target", "s.upto")
    return Mix(written(placed, "placed"), written(schedule(sources, block), "schedule"), block)


def mix(docs: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (the words that the mix takes of the document, repeats counted) and slots (the first of each time it is taken, null where it isn't), a row for each row of ``docs``.

    A source is taken to its target, rounded, at any size.  A null text has no words; a document without words is never
    taken.  A null source is a source of its own.  Repeated rows are separate stretches of the stream.  An empty table, or one
    without words, gives targets and takings of 0.  Nothing but doc_id, source and text is read.  The order depends on ids and texts alone, so reruns agree.
    """
    found = planned(docs, slots)
    row = ["doc_id", "source", "size", "mark", "nth"]
    firsts = F.array(*(F.min(F.when(F.col("epoch") == e, F.col("slot"))) for e in range(MOST_EPOCHS)))
    taken = found.stretches().groupBy(*row).agg(F.sum("words").alias("taken"), firsts.alias("slots"))
    same = F.expr(" AND ".join(f"p.{c} <=> t.{c}" for c in row))
    both = found.placed.alias("p").join(taken.alias("t"), same, "left")
    return both.select("p.doc_id", "p.source", "p.size", "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("t.slots", F.array(*(F.lit(None).cast("long") for _ in range(MOST_EPOCHS)))).alias("slots"))


def sequence(docs: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """slot, source, doc_id, stretch (epoch, first word from 0, words): the mix itself, a row for each stretch of a document, to be read in order of slot and, inside a slot, as the source's stream runs."""
    found = planned(docs, slots).stretches()
    return found.select("slot", "source", "doc_id", F.struct("epoch", "first", "words").alias("stretch"))


#: The same rows without ranges and chunks, for one machine.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS mark, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (3 * source_size)::DOUBLE AS most FROM src),
leveled AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
  WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM leveled),
total AS (SELECT CAST(sum(size) AS BIGINT) AS words FROM sized),
cut AS (SELECT words, least({MAX_BLOCK_WORDS}, greatest(1, (words + {SLOTS} - 1) // {SLOTS})) AS block FROM total),
counted AS (SELECT shares.*, CAST(round(target) AS BIGINT) AS upto, (CAST(round(target) AS BIGINT) + block - 1) // block AS blocks FROM shares, cut),
bounds AS (SELECT *, CAST(round((sum(blocks) OVER w - blocks) / sum(blocks) OVER () * {POINTS}) AS BIGINT) AS low, CAST(round(sum(blocks) OVER w / sum(blocks) OVER () * {POINTS}) AS BIGINT) AS high FROM counted
  WINDOW w AS (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)),
points AS (SELECT i AS slot, ((i + 1)::HUGEINT * {GOLDEN}) % {POINTS} AS point FROM range(0, (SELECT CAST(2 * sum(blocks) AS BIGINT) FROM counted)) t(i)),
-- Every block has a slot: a source whose slots are too few would be taken less here
ends AS (SELECT source, count(*) AS slots FROM points JOIN bounds ON point >= low AND point < high GROUP BY source),
placed AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY mark, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized)
SELECT p.doc_id, p.size, s.source_size, s.target,
  CAST((SELECT coalesce(sum(greatest(0, least(p.start + e * s.source_size + p.size, s.upto, coalesce(n.slots, 0) * c.block) - (p.start + e * s.source_size))), 0) FROM range(0, {MOST_EPOCHS}) t(e)) AS BIGINT) AS taken
FROM placed p JOIN bounds s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN ends n ON p.source IS NOT DISTINCT FROM n.source, cut c
"""
