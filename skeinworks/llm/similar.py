"""All pairs of texts with similar sets of word shingles, found exactly, and which of them stay.

Two sets with a similarity of ``least`` or more share one of the first few shingles of each, in any order of shingles
that is the same for all texts.  So each text is sent to those of its shingles only.  How many of them two texts share bounds how many
they share in all: the rest can add no more than what follows the first ones; and the very first one that they share must leave enough of both
behind it.  Texts that meet in a common shingle only where it leaves too little aren't told of it, so passages that many texts share don't bring all of
these together.  Those that pass are compared whole.  Any order gives all pairs; this one begins with shingles that a sample of the texts doesn't have, so that what many texts
share comes last and few texts meet in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import handed_back, sampled, text_or_empty, text_slices, written
from skeinworks.llm.simhash import shingle_set

#: Texts that are looked at to see which shingles are common, and common shingles that are remembered, at most: 16 MB.
SAMPLE_TEXTS, MOST_COMMON = 5_000, 1 << 20
#: Text of a batch, in bytes, and shingles of a text of the sample, about.
BYTES_AT_ONCE, SAMPLE_SHINGLES = 1 << 20, 4_096
#: Shingles that a task sends at once, and text for each part of the shingles: a part is met in one task, a million of them or so.
SENT_AT_ONCE, TEXT_OF_PART = 1 << 20, 32 << 20
#: Meetings of pairs that are counted at once.
MET_AT_ONCE = 1 << 18
#: A shingle's high bits, the text's node, how many shingles it has, this one's place among them, and how many of the first ones are common: what is sent of a text's shingle.
SENT = np.dtype([("high", "<u4"), ("low", "<u2"), ("node", "<i8"), ("size", "<i4"), ("at", "<i4"), ("common", "<i4")])


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a sample have, ascending, and how many have each.  It decides what meets, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(handed_back(batches), 0, BYTES_AT_ONCE):
            for text in part.column(0):
                found = shingle_set(text.as_py(), words)
                yield pa.RecordBatch.from_arrays([pa.array(found[:: max(1, len(found) // SAMPLE_SHINGLES)].view(np.int64))], names=["shingle"])

    some = sampled(rows.select("node"), SAMPLE_TEXTS, "node", seed="common").withColumnRenamed("node", "__some")
    texts = rows.join(F.broadcast(some), F.col("node") == F.col("__some")).select("text")
    counts = texts.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()
    shingles = np.array([r["shingle"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r["n"] for r in found], np.int64)[order]


def after_first(size, least: float):
    """How many shingles of a set of ``size`` follow the first ones; a little less than the share, as a product of floats may come out too large."""
    return np.ceil(least * size - 1e-9).astype(int) - 1


def first_shingles(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set, in the order of all texts: as many as a similar set must share one of; and how many of these, the last, are common.  ``found`` is ascending."""
    shingles, counts = common
    rank = np.zeros(len(found), np.int64)
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, found), len(shingles) - 1)
        rank = np.where(shingles[at] == found, counts[at], 0)
    first = np.argsort(rank, kind="stable")[: len(found) - int(after_first(np.array(len(found)), least))]
    return found[first], int((rank[first] > 0).sum())


def pairs(texts: DataFrame, *, node: str, text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """a, b (a < b): the nodes, longs, of all pairs of texts whose sets of ``words``-word shingles have a Jaccard similarity of ``least`` or more.

    Rows of a node have one text.  Texts without words aren't paired: they are equal, and equal texts have one node.
    """
    rows = texts.select(F.col(node).alias("node"), text_or_empty(text).cast("binary").alias("text")).where("node IS NOT NULL")
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, words))

    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_OF_PART))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in text_slices(handed_back(batches), 1, BYTES_AT_ONCE):
            for node, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = shingle_set(value.as_py(), words)
                if len(found):
                    keys, known = first_shingles(found, common.value, least)
                    held.append((keys, node, len(found), known))
                    n += len(keys)
                if n >= SENT_AT_ONCE:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    def sent(held: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
        """A row for each part, with what goes there as bytes: a third of what rows of their own would take."""
        keys = np.concatenate([h[0] for h in held])
        out, each = np.empty(len(keys), SENT), [len(h[0]) for h in held]
        out["high"], out["low"] = keys >> np.uint64(32), keys >> np.uint64(16) & np.uint64(0xFFFF)
        out["node"], out["size"], out["common"] = (np.repeat([h[k] for h in held], each) for k in (1, 2, 3))
        out["at"] = np.concatenate([np.arange(n) for n in each])
        to = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array([out[order[edges[p] : edges[p + 1]]].tobytes() for p in some], pa.binary())], names=["part", "sent"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in handed_back(batches):
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != last and held:
                    yield from met(np.concatenate(held))
                    held = []
                last = part
                held.append(np.frombuffer(value.as_py(), SENT))
        if held:
            yield from met(np.concatenate(held))

    def met(all_: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = all_["high"].astype(np.uint64) << np.uint64(16) | all_["low"].astype(np.uint64)
        order = np.lexsort((all_["node"], all_["size"], key))
        key, all_ = key[order], all_[order]
        size, at, nodes = all_["size"].astype(np.int64), all_["at"].astype(np.int64), all_["node"]
        is_common = at >= size - after_first(size, least) - all_["common"]
        edges = np.flatnonzero(np.diff(key, prepend=~key[:1], append=~key[-1:]))
        found, n = [], 0
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            # By ascending size: similar sets aren't far apart in it
            reach = a + np.searchsorted(size[a:b], size[a:b] / least + 1e-6, "right")
            for i in range(a, b - 1):
                j = np.arange(i + 1, reach[i - a])
                j = j[nodes[j] != nodes[i]]
                shared = least / (1 + least) * (size[i] + size[j]) - 1e-6
                first = (size[i] - at[i] >= shared) & (size[j] - at[j] >= shared)
                if is_common[i]:
                    j, first = j[first], first[first]
                if len(j):
                    found.append((np.full(len(j), i), j, first))
                    n += len(j)
                if n >= MET_AT_ONCE:
                    yield counted(found, all_)
                    found, n = [], 0
        if found:
            yield counted(found, all_)

    def counted(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], all_: np.ndarray) -> pa.RecordBatch:
        """How often each pair has met, and whether where it may be the first time."""
        i, j, first = (np.concatenate(x) for x in zip(*found, strict=True))
        swap = all_["node"][i] > all_["node"][j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pair = np.stack([all_["node"][i], all_["node"][j], all_["size"][i], all_["size"][j], np.minimum(all_["common"][i], all_["common"][j])], axis=1)
        once, at, n = np.unique(pair, axis=0, return_inverse=True, return_counts=True)
        firsts = np.bincount(at.ravel(), weights=first, minlength=len(once)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in once.T), pa.array(n.astype(np.int64)), pa.array(firsts)], names=["a", "b", "size_a", "size_b", "untold", "n", "firsts"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(handed_back(batches), 2, BYTES_AT_ONCE):
            keep = []
            for one, other in zip(part.column(2), part.column(3), strict=True):
                x, y = (shingle_set(v.as_py(), words) for v in (one, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = rows.mapInArrow(deal, "part long, sent binary").repartition(parts, "part").sortWithinPartitions("part")
    each = dealt.mapInArrow(meet, "a long, b long, size_a long, size_b long, untold long, n long, firsts long")
    each = each.groupBy("a", "b", "size_a", "size_b", "untold").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts")).where("firsts > 0")
    rest = lambda c: F.ceil(least * F.col(c) - 1e-9) - 1
    enough = F.col("n") + F.col("untold") + F.greatest(rest("size_a"), rest("size_b")) >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6
    met_pairs = written(each.where(enough).select("a", "b"), "met")
    if met_pairs.isEmpty():
        return met_pairs
    wanted = met_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = written(rows.join(wanted, "node").groupBy("node").agg(F.min("text").alias("text")), "compared")
    of = lambda side: some.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    return met_pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def later_of(links: DataFrame, order: DataFrame, key: Column) -> DataFrame:
    """node: those that go, as each has a link to one that stays and comes before it; ``order`` has a row for each node, ``key`` tells its place.

    A node is decided when all before it that it has links to are: those with none left stay, what these have links to goes.
    """
    place = order.select("node", key.alias("place"))
    of = lambda side: place.select(F.col("node").alias(side), F.col("place").alias(f"place_{side}"))
    both = links.join(of("a"), "a").join(of("b"), "b")
    first = F.col("place_a") < F.col("place_b")
    left = written(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")).distinct(), "ordered")
    gone = None
    while not left.isEmpty():
        stays = left.select(F.col("early").alias("node")).distinct().join(left.select(F.col("late").alias("node")), "node", "left_anti")
        goes = written(left.join(stays.withColumnRenamed("node", "early"), "early", "left_semi").select(F.col("late").alias("node")).distinct(), "goes")
        gone = goes if gone is None else gone.unionByName(goes)
        left = left.join(goes.withColumnRenamed("node", "late"), "late", "left_anti").join(goes.withColumnRenamed("node", "early"), "early", "left_anti")
        left = written(left.select("early", "late"), "ordered")
    return links.select(F.col("a").alias("node")).limit(0) if gone is None else gone
