"""Nearest neighbours by inner product from an inverted multi-index.

Both halves of the vectors have a codebook of their own; a vector's cell is its pair of
nearest centroids.  A query takes cells in order of their summed shortfall from its best
centroids, with a heap over centroid pairs that passes over empty cells, until they hold as many
vectors as are wanted.  Vectors in those cells are reranked by the exact product in double precision.

How many are wanted is measured: for a few of the queries the nearest are found exactly, in
blocks against all rows, and the places of their cells say how far to go for the asked recall.
So the work follows the data: a small part of it where vectors cluster, a large one where they don't.

Cells are packed into blocks of bounded size, large cells cut over several.  Each block's
vectors lie sorted before the queries that want it, so a task holds one block and streams
queries past it; a query is sent with how far it reaches, and the block finds its cells within.
Equal vectors are indexed once, with their smallest ids: no more can be asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinworks.llm.common import sampled, written

#: Vectors that codebooks are fitted on, about at most, how many of them a centroid has at least, and rounds of k-means.
FIT_ROWS, LEAST_FIT, FIT_ROUNDS = 20_000, 16, 10
#: Centroids of a half for each square root of the vectors: there are somewhat more pairs than vectors.
CENTROIDS_PER_ROOT = 1.2
#: Cells of a row that are taken at once.
RUN = 16
#: Queries that are searched exactly to measure how much to probe.
MEASURED = 128
#: Queries of a task that probes, about.
QUERIES_AT_ONCE = 500
#: Vectors in a block, at most (the ids of equal vectors count as one).
BLOCK_ROWS = 4096
#: Scores this close to the last place kept in a block are decided by the exact sum, and cells this close to a query's reach are in.
SLACK = 1e-9


def k_means(rows: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids from a fixed start; fewer than ``k`` where there are fewer rows."""
    rng = np.random.default_rng(7)
    centroids = rows[np.sort(rng.choice(len(rows), min(k, len(rows)), replace=False))].copy()
    for _ in range(rounds):
        at = nearest(rows, centroids)
        counts = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, rows)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


@dataclass
class MultiIndex:
    """The codebooks; and of the cells that hold vectors, by first and second centroid, their numbers and how many each holds."""

    first: np.ndarray
    second: np.ndarray
    cell: np.ndarray | None = None
    count: np.ndarray | None = None

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return nearest(vectors[:, :half], self.first) * len(self.second) + nearest(vectors[:, half:], self.second)

    def shortfalls(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, centroids) of each half: how much less than the best centroid's each product is."""
        half = self.first.shape[1]
        products = queries[:, :half] @ self.first.T, queries[:, half:] @ self.second.T
        return tuple(p.max(axis=1, keepdims=True) - p for p in products)

    def of_cells(self, short: tuple[np.ndarray, np.ndarray], cell: np.ndarray) -> np.ndarray:
        """(queries, cells): the summed shortfalls."""
        return short[0][:, cell // len(self.second)] + short[1][:, cell % len(self.second)]

    def probe(self, one: np.ndarray, two: np.ndarray, wanted: int) -> tuple[np.ndarray, float]:
        """Places in ``cell``, by ascending sum of the shortfalls ``one`` and ``two`` of a query, until they hold ``wanted`` vectors; and the last sum.

        The heap holds rows, the cells of a first centroid, by the sum that comes next in each.  A row is opened
        when its centroid's own shortfall comes up, as no cell in it can come before, and gives up to ``RUN``
        cells at a time.  Enough is there when cells up to the least sum in the heap hold what is wanted: none left comes before.
        """
        starts = np.searchsorted(self.cell, np.arange(len(self.first) + 1) * len(self.second)).tolist()
        rows = np.argsort(one, kind="stable").tolist()
        heap, opened, held, check = [(float(one[rows[0]]), 0, 0)], {}, 0, wanted
        while heap:
            _, is_open, row = heapq.heappop(heap)
            if is_open:
                sums, upto, _, at = found = opened[row]
                found[3] = end = min(at + RUN, len(upto) - 1)
                held += upto[end] - upto[at]
                if end < len(upto) - 1:
                    heapq.heappush(heap, (float(sums[end]), 1, row))
            else:
                a, b = starts[rows[row]], starts[rows[row] + 1]
                if b > a:
                    sums = one[rows[row]] + two[self.cell[a:b] % len(self.second)]
                    order = np.argsort(sums, kind="stable")
                    opened[row] = [sums[order], [0, *np.cumsum(self.count[a:b][order]).tolist()], order + a, 0]
                    heapq.heappush(heap, (float(opened[row][0][0]), 1, row))
                if row + 1 < len(rows):
                    heapq.heappush(heap, (float(one[rows[row + 1]]), 0, row + 1))
            if held >= check and heap:
                sure = sum(upto[min(at, int(np.searchsorted(sums, heap[0][0], "right")))] for sums, upto, _, at in opened.values())
                if sure >= wanted:
                    break
                check = held + wanted - sure
        sums = np.concatenate([found[0][: found[3]] for found in opened.values()])
        places = np.concatenate([found[2][: found[3]] for found in opened.values()])
        order = np.argsort(sums, kind="stable")
        last = min(int(np.searchsorted(np.cumsum(self.count[places[order]]), wanted)), len(order) - 1)
        return places[order[: last + 1]], float(sums[order[last]])

    def needed(self, queries: np.ndarray, nearest_cells: list[np.ndarray], recall: float) -> int:
        """Vectors to probe so that the cells of the queries' nearest are among them for a share ``recall`` of all."""
        ranks = []
        for query, cells in zip(queries, nearest_cells, strict=True):
            short = self.shortfalls(query[None])
            sums = self.of_cells(short, self.cell)[0]
            order = np.argsort(sums, kind="stable")
            upto = np.cumsum(self.count[order])
            last = np.searchsorted(sums[order], self.of_cells(short, cells)[0], "right") - 1
            ranks.append(upto[last])
        ranks = np.concatenate(ranks) if ranks else np.zeros(0)
        return int(np.quantile(ranks, recall, method="higher")) if len(ranks) else int(self.count.sum())

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``cell`` its first block and the number of blocks that it is cut over."""
        first, cut, block, held = np.zeros(len(self.cell), np.int64), np.ones(len(self.cell), np.int64), 0, 0
        for at, n in enumerate(self.count.tolist()):
            if n > BLOCK_ROWS:
                block += held > 0
                first[at], cut[at] = block, -(-n // BLOCK_ROWS)
                block, held = block + int(cut[at]), 0
                continue
            if held + n > BLOCK_ROWS:
                block, held = block + 1, 0
            first[at] = block
            held += n
        return first, cut


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def exact(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed on its own: equal vectors get equal scores wherever they stand."""
    return (block * query).sum(axis=1)


def rerank(block: np.ndarray, queries: np.ndarray, inside: np.ndarray, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, places of vectors, scores) for the block's vectors ``inside`` (queries, vectors) of each query's cells that can be among its ``keep`` best."""
    products = np.where(inside, queries @ block.T, -np.inf)
    for k, scores in enumerate(products):
        at = np.flatnonzero(inside[k])
        if len(at) > keep:
            least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
            at = np.flatnonzero(scores >= least - SLACK * max(1.0, abs(least)))
        if len(at):
            yield k, at, exact(block[at], queries[k])


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, vec) of the vectors that take part, and their length.

    Out are null keys, and vectors that are null, hold a null, NaN or infinite component, are
    zero, or have another length than most (ties: the longer).  Rows that share a key are rows of their own.
    """
    good = F.expr("NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vec, x -> x <> 0)")
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("vec")).where(F.col("key").isNotNull() & F.col("vec").isNotNull()).where(good)
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = common["n"] if common else 0
    return rows.where(F.size("vec") == dims), dims


def nearest_of(placed: DataFrame, marks: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query (with the mark ``h`` of its own vector, which doesn't count) the cells of its ``k`` nearest of all vectors, exactly; a task keeps the best of what it has seen."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.empty(0), np.empty(0, np.int64)) for _ in queries]
        for batch in batches:
            own, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            scores = queries @ _matrix(batch.column(1), queries.shape[1]).T
            scores[own[None, :] == marks[:, None]] = -np.inf
            for q, (held, at) in enumerate(top):
                both, where = np.concatenate([held, scores[q]]), np.concatenate([at, cells])
                kept = np.argsort(-both, kind="stable")[:k]
                kept = kept[np.isfinite(both[kept])]
                top[q] = both[kept], where[kept]
        sizes = [len(s) for s, _ in top]
        columns = np.repeat(np.arange(len(top)), sizes), np.concatenate([s for s, _ in top]), np.concatenate([c for _, c in top])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "score", "cell"])

    found = placed.select("h", "vec", F.col("cell").cast("long").alias("cell")).mapInArrow(best, "q long, score double, cell long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))
    cells: list[list[int]] = [[] for _ in queries]
    for r in found.withColumn("place", place).where(F.col("place") <= k).collect():  # MEASURED times k rows at most
        cells[r["q"]].append(r["cell"])
    return [np.array(c, np.int64) for c in cells]


def search(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95, wanted: int | None = None) -> DataFrame:
    """For each row whose key is divisible by ``every``, its ``k`` nearest other rows by inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller key.  Cells are
    probed until they hold ``wanted`` distinct vectors, by default as many as gave ``recall`` for
    the measured queries.  See ``usable`` for rows that take no part; rows that repeat a
    key, or a whole row, are candidates, and queries, of their own.  Fewer than ``k`` candidates
    are all returned; an empty table, or one without usable vectors, gives an empty result.
    """
    spark = rows.sparkSession
    key_type = rows.schema[key].dataType
    vectors, dims = usable(rows, key, vector)
    vectors = written(vectors.select("key", "vec", F.xxhash64("vec").alias("h")), "vectors")
    # Of equal vectors the k + 1 smallest keys: a query among them leaves out its own
    smallest = vectors.withColumn("n", F.row_number().over(Window.partitionBy("h", "vec").orderBy("key"))).where(F.col("n") <= k + 1)
    distinct = smallest.groupBy("h", "vec").agg(F.array_sort(F.collect_list("key")).alias("ids"))
    queries = vectors.where(F.col("key") % every == 0)
    asking = written(queries.select("h", "vec").distinct(), "asking")

    fit_on = sampled(vectors.select("h", "vec"), FIT_ROWS, "h", "vec").toArrow() if dims else None
    if fit_on is None or not fit_on.num_rows:
        empty = T.StructType([T.StructField("query_id", key_type), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", key_type), T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], empty)
    fit_on = fit_on.sort_by("h")
    sample = _matrix(fit_on.column("vec").combine_chunks(), dims)
    n = vectors.count()
    centroids, half = int(np.clip(round(CENTROIDS_PER_ROOT * n**0.5), 1, max(1, len(sample) // LEAST_FIT))), dims // 2
    index = MultiIndex(k_means(sample[:, :half], centroids), k_means(sample[:, half:], centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(_matrix(batch.column(1), dims)).astype(np.int32))], names=["ids", "vec", "h", "cell"])

    vec_type = T.ArrayType(rows.schema[vector].dataType.elementType)
    ids_type = T.ArrayType(key_type)
    placed = distinct.select("ids", "vec", "h").mapInArrow(assign, T.StructType([T.StructField("ids", ids_type), T.StructField("vec", vec_type), T.StructField("h", T.LongType()), T.StructField("cell", T.IntegerType())]))
    placed = written(placed, "cells")
    # A row for each cell that holds any: the square of the centroids at most
    counts = placed.groupBy("cell").count().toArrow().sort_by("cell")
    index.cell, index.count = counts.column("cell").to_numpy().astype(np.int64), counts.column("count").to_numpy()
    if wanted is None:
        some = sampled(asking, MEASURED, "h", "vec").toArrow()
        measured = _matrix(some.column("vec").combine_chunks(), dims) if some.num_rows else np.zeros((0, dims))
        marks = some.column("h").to_numpy()
        wanted = index.needed(measured, nearest_of(placed, marks, measured, k), recall) if some.num_rows else 1
    first, cut = index.blocks()

    where = spark.createDataFrame(pa.table({"cell": pa.array(index.cell, pa.int32()), "first": first, "cut": cut}))
    stored = placed.join(where, "cell").select(
        (F.col("first") + F.pmod(F.col("h"), F.col("cut"))).alias("block"), F.lit(0).alias("kind"), "h", "ids", "vec", "cell", F.lit(None).cast("double").alias("reach")
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _matrix(batch.column(1), dims)
            for start in range(0, batch.num_rows, 256):
                out = []
                short = index.shortfalls(vecs[start : start + 256])
                for i, (one, two) in enumerate(zip(*short, strict=True)):
                    at, reach = index.probe(one, two, wanted)
                    begin, reps = first[at], cut[at]
                    blocks = np.unique(np.repeat(begin - np.cumsum(reps) + reps, reps) + np.arange(int(reps.sum())))
                    out += [(start + i, b, reach) for b in blocks.tolist()]
                taken = batch.take(pa.array([o[0] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["h", "vec", "block", "reach"])

    # Few rows, but much work: dealt out by number, as their size would make them one task
    asked = asking.repartition(-(-asking.count() // QUERIES_AT_ONCE) or 1).mapInArrow(probe, T.StructType([T.StructField("h", T.LongType()), T.StructField("vec", vec_type), T.StructField("block", T.LongType()), T.StructField("reach", T.DoubleType())]))
    asked = asked.select("block", F.lit(1).alias("kind"), "h", F.lit(None).cast(ids_type).alias("ids"), "vec", F.lit(None).cast("int").alias("cell"), "reach")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, block = -1, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks) | np.diff(kinds)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if blocks[start] != current:
                    current, kept, block = int(blocks[start]), [], None
                if kinds[start] == 0:
                    kept.append(part)
                    block = None
                    continue
                if block is None:
                    if not kept:
                        continue
                    block = np.concatenate([_matrix(p.column(4), dims) for p in kept])
                    ids = [i for p in kept for i in p.column(3).to_pylist()]
                    marks = np.concatenate([p.column(2).to_numpy() for p in kept])
                    cells, of_cell = np.unique(np.concatenate([p.column(5).to_numpy() for p in kept]), return_inverse=True)
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    vecs, asker = _matrix(some.column(4), dims), some.column(2).to_numpy()
                    near = index.of_cells(index.shortfalls(vecs), cells) <= some.column(6).to_numpy()[:, None] + SLACK
                    found = []
                    for q, places, scores in rerank(block, vecs, near[:, of_cell], k + 1):
                        hits = sorted((-s, i, m) for s, a, m in zip(scores.tolist(), places.tolist(), marks[places].tolist(), strict=True) for i in ids[a])
                        found += [(asker[q], i, m, -s) for s, i, m in hits[: k + 1]]
                    columns = [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), ids_arrow, pa.int64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["asker", "vec_id", "h", "score"])

    ids_arrow = pa.int64() if isinstance(key_type, T.LongType) else pa.int32()
    stored_and_asked = stored.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    found = stored_and_asked.mapInArrow(compare, T.StructType([T.StructField("asker", T.LongType()), T.StructField("vec_id", key_type), T.StructField("h", T.LongType()), T.StructField("score", T.DoubleType())]))
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "h"))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "h", "score"))).alias("best"))

    answer = queries.select(F.col("key").alias("query_id"), F.col("h").alias("asker")).join(best, "asker")
    own = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["h"] == F.col("asker"))), True) - 1
    others = F.slice(F.filter("best", lambda x, i: i != F.col("own")), 1, k)
    answer = answer.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "hit"))
    return answer.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
