"""Centroid clustering of integer vectors, with kd-trees that filter the centroids.

Components become integers, so sums, means and distances are exact and don't depend on how rows are dealt
out.  Vectors are packed once into blocks of the partition they lie in; each block has a kd-tree whose
nodes hold how many vectors lie below them, the sums of these, and their bounding box.  A round sends the
centroids down each tree: one that another is strictly closer than at every point of a node's box is
dropped, a node left with a single centroid goes to it as a whole, by its count and sums, and in leaves
that are still open distances decide.  What leaves a task is a row for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.llm.common import handed_back, written

#: Components of a vector, and what a component is multiplied with before it is floored.
DIMENSIONS, SCALE = 64, 256
#: Centroids, rounds, and what stands before the id in the hash that chooses the first centroids.
CLUSTERS, ROUNDS, SEED = 40, 5, "2:"
#: Integers are cut to this size either way, so that all distances fit a long.
MOST = 1 << 26
#: Vectors of a block and of a leaf, at most.
BLOCK_ROWS, LEAF_ROWS = 2048, 16
#: Up to this size distances in 64 components are whole numbers that doubles hold exactly.
EXACT_IN_DOUBLES = 1 << 21
#: Nodes that meet the centroids at once.
NODES_AT_ONCE = 128


@dataclass
class Tree:
    """Vectors in the order of the leaves, and the nodes, parents first: range of vectors, first child (or -1), box and sums."""

    vectors: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    def packed(self) -> list[bytes]:
        kind = np.int16 if max(-int(self.low[0].min()), int(self.high[0].max())) < 1 << 15 else np.int32
        return [x.astype(k).tobytes() for x, k in zip(self._parts(), (kind, *FIXED, kind, kind, np.int64), strict=True)]

    def _parts(self) -> tuple[np.ndarray, ...]:
        return self.vectors, self.start, self.end, self.child, self.low, self.high, self.total


FIXED = (np.int32, np.int32, np.int32)


def unpacked(parts: list[bytes], n: int) -> Tree:
    kind = {2: np.int16, 4: np.int32}[len(parts[0]) // (n * (d := len(parts[6]) // 8 // (len(parts[1]) // 4)))]
    found = [np.frombuffer(x, k) for x, k in zip(parts, (kind, *FIXED, kind, kind, np.int64), strict=True)]
    return Tree(*(x if at in (1, 2, 3) else x.reshape(-1, d).astype(np.int64) for at, x in enumerate(found)))


def grow(vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The kd-tree of integer vectors, split at the median of the widest side of each box, and the order it puts them in.  Equal vectors are one leaf, however many."""
    order = np.arange(len(vectors))
    start, end, child, low, high, total = [0], [len(vectors)], [], [], [], []
    while (at := len(child)) < len(start):
        a, b = start[at], end[at]
        part = vectors[order[a:b]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        total.append(part.sum(axis=0))
        side = int((high[at] - low[at]).argmax())
        if b - a <= LEAF_ROWS or high[at][side] == low[at][side]:
            child.append(-1)
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, side], middle)]
        child.append(len(start))
        start += [a, a + middle]
        end += [a + middle, b]
    return Tree(vectors[order], *(np.array(x) for x in (start, end, child, low, high, total))), order


def undominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """(nodes, centroids): which of the ``allowed`` stay: those that the one nearest to a box's middle isn't strictly closer than at every point of the box.

    Of two centroids the difference of squared distances is linear over the box, so its corner that lies
    farthest towards the other one decides.
    """
    middle = (low + high) / 2
    near = (centroids.astype(float) ** 2).sum(axis=1) - 2 * middle @ centroids.T.astype(float)
    best = centroids[np.where(allowed, near, np.inf).argmin(axis=1)]
    away = centroids[None] - best[:, None]
    corner = np.where(away > 0, high[:, None], low[:, None])
    return allowed & ((away * (centroids[None] + best[:, None] - 2 * corner)).sum(axis=2) <= 0)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids): exact squared distances."""
    size = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if size <= EXACT_IN_DOUBLES and vectors.shape[1] <= 64 else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v**2).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c**2).sum(axis=1)).astype(np.int64)


def settled(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whole, places, centroid of each): nodes that go to one centroid as a whole, and single vectors of open leaves.

    ``centroids`` are distinct, in the order that decides ties.
    """
    open_nodes = [(np.zeros(1, int), np.ones((1, len(centroids)), bool))]
    while open_nodes:
        nodes, allowed = open_nodes.pop()
        if len(nodes) > NODES_AT_ONCE:
            open_nodes += [(nodes[NODES_AT_ONCE:], allowed[NODES_AT_ONCE:])]
            nodes, allowed = nodes[:NODES_AT_ONCE], allowed[:NODES_AT_ONCE]
        allowed = undominated(tree.low[nodes], tree.high[nodes], centroids, allowed)
        one = allowed.sum(axis=1) == 1
        if one.any():
            yield True, nodes[one], allowed[one].argmax(axis=1)
        nodes, allowed = nodes[~one], allowed[~one]
        leaf = tree.child[nodes] < 0
        if leaf.any():
            sizes = (tree.end - tree.start)[nodes[leaf]]
            rows = np.repeat(tree.start[nodes[leaf]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            far = np.where(np.repeat(allowed[leaf], sizes, axis=0), distances(tree.vectors[rows], centroids), np.iinfo(np.int64).max)
            yield False, rows, far.argmin(axis=1)
        if not leaf.all():
            below = tree.child[nodes[~leaf]]
            open_nodes.append((np.concatenate([below, below + 1]), np.concatenate([allowed[~leaf]] * 2)))


def sums(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors are nearest to each centroid, and their sums."""
    count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for whole, places, who in settled(tree, centroids):
        np.add.at(count, who, (tree.end - tree.start)[places] if whole else 1)
        np.add.at(total, who, tree.total[places] if whole else tree.vectors[places])
    return count, total


def labels(tree: Tree, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, in the tree's order."""
    found = np.empty(len(tree.vectors), int)
    for whole, places, who in settled(tree, centroids):
        if whole:
            for a, b, k in zip(tree.start[places], tree.end[places], who, strict=True):
                found[a:b] = k
        else:
            found[places] = who
    return found


def integers(column: Column, scale: int = SCALE) -> Column:
    """The components as integers: floor(scale * x), cut at ``MOST`` either way."""
    scaled = lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale)))
    return F.transform(column, lambda x: scaled(x).cast("int"))


def fit_to_cluster(column: Column, dimensions: int) -> Column:
    """Whether a vector has exactly ``dimensions`` components, none null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(column) == dimensions) & F.forall(column, finite), F.lit(False))


#: What is told of a cluster.
ABOUT = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
TREE = ("vectors", "start", "end", "child", "low", "high", "total")


def blocks(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``keys`` and the tree, a row for each block of vectors that lie in one partition."""
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in TREE)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in handed_back(batches):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        keys, vectors = (whole.column(c).combine_chunks() for c in (0, 1))
        tree, order = grow(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1).astype(np.int64))
        keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([keys, *(pa.array([x], pa.binary()) for x in tree.packed())], names=schema.names)

    return rows.select(key, column).mapInArrow(pack, schema)


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in handed_back(batches):
        for i in range(batch.num_rows):
            keys = batch.column(0)[i].values
            yield keys, unpacked([batch.column(k)[i].as_py() for k in range(1, 8)], len(keys))


def distinct(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct centroids in order, and the (smallest) number of each: of equal ones only the first can get vectors."""
    first = {tuple(c): k for k, c in reversed(list(enumerate(centroids)))}
    numbers = sorted(first.values())
    return np.array([centroids[k] for k in numbers], np.int64), np.array(numbers)


def moved(packed: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floored means of the vectors nearest to each; one without vectors stays."""
    rows, numbers = distinct(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(rows), np.int64), np.zeros(rows.shape, np.int64)
        for _, tree in trees(batches):
            n, s = sums(tree, rows)
            count += n
            total += s
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[full], pa.int32()), pa.array(count[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = packed.mapInArrow(run, "cluster int, n long, total array<long>")
    # Sums of sums outgrow a long only beyond what a table can hold; decimals say so instead of wrapping round
    whole = [F.sum(F.get("total", F.lit(d)).cast("decimal(20,0)")).alias(f"d{d}") for d in range(rows.shape[1])]
    found = [list(c) for c in centroids]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row for each centroid
        found[r["cluster"]] = [int(r[f"d{d}"]) // r["n"] for d in range(rows.shape[1])]
    return found


def assigned(packed: DataFrame, centroids: list[list[int]], key: T.StructField) -> DataFrame:
    """key, cluster, distance of every vector."""
    rows, numbers = distinct(centroids)
    schema = T.StructType([key, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, tree in trees(batches):
            who = labels(tree, rows)
            far = ((tree.vectors - rows[who]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([keys, pa.array(numbers[who], pa.int32()), pa.array(far)], names=schema.names)

    return packed.mapInArrow(run, schema)


def cluster(vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256, a row for each vector that is kept.

    Vectors of another length, null, or with a null or non-finite component take no part.  A component is
    floor(256 * x), cut at 2**26 either way.  The first centroids are the vectors whose ``seed`` and id have the smallest
    SHA-256 (a null id is an empty one), equal hashes by the vectors; where fewer rows are kept there are fewer.  Ties in distance go to the
    smaller number, empty centroids stay, means are floored.  Repeated rows count as often as they stand there.  An empty table gives an empty one.
    Sums of distances beyond a long are null.  Only ``key`` and ``column`` are read.  The driver holds the centroids, nothing else.
    """
    spark, field = vectors.sparkSession, vectors.select(key).schema[0]
    kept = vectors.where(fit_to_cluster(F.col(column), dimensions)).select(key, integers(F.col(column)).alias("__v"))
    packed = written(blocks(kept, key, "__v"), "trees")
    mark = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    centroids = [list(r["__v"]) for r in kept.select(mark.alias("mark"), "__v").orderBy("mark", "__v").limit(clusters).collect()]
    if not centroids:
        return spark.createDataFrame([], T.StructType([field, *T.StructType.fromDDL(f"distance long, {ABOUT}")])).select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    found = written(assigned(packed, centroids, field), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    about = [(k, fits(n), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, n in inertia.items()]
    # A row for each centroid
    return found.join(F.broadcast(spark.createDataFrame(about, ABOUT)), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds() -> str:
    """The rounds in SQL, one after another."""
    near = "SELECT r, c, dist FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS dist FROM parts JOIN c{k} USING (d) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1"
    mean = "SELECT c, d, CAST(coalesce((s - ((s % n) + n) % n) // n, y) AS BIGINT) AS y FROM c{k} LEFT JOIN (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts JOIN n{k} USING (r) GROUP BY c, d) USING (c, d)"
    return ",\n".join([f"n{k} AS MATERIALIZED ({near.format(k=k)}),\nc{k + 1} AS MATERIALIZED ({mean.format(k=k)})" for k in range(ROUNDS)] + [f"n{ROUNDS} AS MATERIALIZED ({near.format(k=ROUNDS)})"])


#: The same with all distances of all vectors.
ORACLE = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, i AS d, v[i] AS x FROM kept, range(1, {DIMENSIONS + 1}) t(i)),
c0 AS MATERIALIZED (SELECT c, i AS d, v[i] AS y FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept) f, range(1, {DIMENSIONS + 1}) t(i) WHERE c < {CLUSTERS}),
{_rounds()},
marks AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n{ROUNDS} JOIN kept USING (r) JOIN marks USING (c)
"""
