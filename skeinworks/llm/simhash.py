"""SimHash near-duplicates, found with tables of distances to pivot fingerprints.

A document's fingerprint takes each bit by majority over the hashes of its word shingles.
Documents of one fingerprint are one row from there on.

For every fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints are read
off precomputed tables, block by block of the 64 bits.  Two fingerprints that differ in at most
``bits`` bits differ in at most as many of ``bits + 3`` blocks, so in three blocks at least all
their partial distances agree: rows meet by the partial distances of each three blocks.
Where rows meet, pairs are discarded if any whole distance to a pivot differs by more than
``bits`` (the triangle inequality), and the survivors are verified.  Nothing is lost: the keys
and the discarding follow from the distances alone.

Small meetings are compared all at once, large ones in blocks; blocks whose fingerprints are
all linked already are passed over, and links are emitted as stars, not pairs.  A meeting of
more than ``MEETING`` fingerprints is cut into chunks, and each two chunks meet in a task of
their own: memory stays bounded, and the work, which can grow with the square, is spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinworks.llm.common import handed_back, text_or_empty, written
from skeinworks.llm.components import components

#: Reference fingerprints, and the blocks whose partial distances must agree.
PIVOTS, AGREEING = 32, 3
#: Hashes that are counted at once.
COUNT_AT_ONCE = 1 << 16
#: Fingerprints whose keys are made at once.
DEALT = 2048
#: Fingerprints up to which a meeting is compared along with others; those of larger ones that are compared at once.
SMALL, BLOCK = 32, 512
#: Fingerprints of one key that meet in one task; of more, chunks of this size meet two by two.
MEETING = 1 << 14
#: Documents of a group that are checked in one task, about.
GROUP_ROWS = 10_000


# ---- fingerprints ----


def fingerprint(text: bytes, shingle: int = 3, repeats: bool = True, seed: int = 42) -> int:
    """The SimHash of a text in UTF-8: A-Z in lower case, words between ASCII white space, shingles of ``shingle`` words (fewer words: all of them), counted as often as they occur or once, XXH64; 0 for no words."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends, digest = ends[shingle - 1 :].tolist(), xxhash.xxh64_intdigest
    hashes_of = (np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + COUNT_AT_ONCE], ends[at : at + COUNT_AT_ONCE], strict=True)], "<u8") for at in range(0, n, COUNT_AT_ONCE))
    if not repeats:
        once = np.unique(np.concatenate(list(hashes_of)))
        n, hashes_of = len(once), (once[at : at + COUNT_AT_ONCE] for at in range(0, len(once), COUNT_AT_ONCE))
    counts = np.zeros(64, np.int64)
    for hashes in hashes_of:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 3, repeats: bool = True, out: str = "fp") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint as a signed long."""
    others = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handed_back(batches):
            found = np.array([fingerprint(x.as_py(), shingle, repeats) for x in batch.column(len(others))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in others), text_or_empty(text).cast("binary").alias(text)).mapInArrow(run, schema)


# ---- tables of distances ----


def distance(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other)


class PivotTables:
    """Distances of any fingerprint to the pivots, by blocks of bits."""

    def __init__(self, bits: int, pivots: int = PIVOTS):
        rng = np.random.default_rng(11)
        self.bits, self.pivots = bits, rng.integers(0, 1 << 64, pivots, dtype=np.uint64)
        n = bits + AGREEING
        edges = [64 * i // n for i in range(n + 1)]
        self.blocks = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.tables = [distance(np.arange(int(mask) + 1, dtype=np.uint64)[:, None], (self.pivots >> shift & mask)[None, :]) for shift, mask in self.blocks]
        # A row of partial distances as one number
        odd = rng.integers(0, 1 << 63, (n, pivots), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.coded = [(t.astype(np.uint64) * odd[k]).sum(axis=1, dtype=np.uint64) for k, t in enumerate(self.tables)]

    def _values(self, fps: np.ndarray) -> list[np.ndarray]:
        return [(fps >> shift & mask).astype(np.int64) for shift, mask in self.blocks]

    def distances(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprints, pivots): the sums of the partial distances."""
        out = np.zeros((len(fps), len(self.pivots)), np.int8)
        for table, values in zip(self.tables, self._values(fps), strict=True):
            out += table[values].astype(np.int8)
        return out

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprints, choices of agreeing blocks): a number for the choice and the partial distances in its blocks."""
        codes = [coded[v] for coded, v in zip(self.coded, self._values(fps), strict=True)]
        columns = []
        for k, chosen in enumerate(combinations(range(len(self.blocks)), AGREEING)):
            key = np.full(len(fps), k * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            for b in chosen:
                key = (key ^ codes[b]) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(32)
            columns.append(key)
        return np.stack(columns, axis=1)

    def close(self, fps: np.ndarray, far: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are close: those the distances to the pivots can't tell apart, verified."""
        on = np.flatnonzero(np.abs(far[i] - far[j]).max(axis=1, initial=0) <= self.bits)
        return on[distance(fps[i[on]], fps[j[on]]) <= self.bits]

    def among_equal(self, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the close pairs of equal keys, for ascending keys: each with the next, the next but one, and so on."""
        far, found = self.distances(fps), []
        for step in range(1, len(keys)):
            i = np.flatnonzero(keys[step:] == keys[:-step])
            if not len(i):
                break
            on = self.close(fps, far, i, i + step)
            found.append((i[on], i[on] + step))
        return tuple(np.concatenate([f[side] for f in found]) if found else np.empty(0, np.int64) for side in (0, 1))

    def linked(self, fps: np.ndarray) -> np.ndarray:
        """For each fingerprint the smallest place that it is linked to over close pairs, directly or not."""
        far = self.distances(fps)
        order = np.argsort(far[:, 0], kind="stable")
        fps, far, root = fps[order], far[order], np.arange(len(fps))
        for a in range(0, len(fps), BLOCK):
            for b in range(a, len(fps), BLOCK):
                here, there = slice(a, a + BLOCK), slice(b, b + BLOCK)
                if far[b, 0] - far[here][-1, 0] > self.bits:
                    break
                if root[here].min() == root[here].max() == root[there].min() == root[there].max():
                    continue
                near = np.ones((len(fps[here]), len(fps[there])), bool)
                for one, other in zip(far[here].T, far[there].T, strict=True):
                    near &= np.abs(one[:, None] - other[None, :]) <= self.bits
                i, j = np.nonzero(near)
                on = distance(fps[here][i], fps[there][j]) <= self.bits
                join(root, i[on] + a, j[on] + b)
        out = np.full(len(fps), len(fps))
        np.minimum.at(out, root, order)
        final = np.empty(len(fps), np.int64)
        final[order] = out[root]
        return final


def join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Take pairs into a forest in which every place points at the root of its tree."""
    while len(i):
        ri, rj = root[i], root[j]
        apart = ri != rj
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def _rows(a: np.ndarray | None, b: np.ndarray | None, key: int | None, chunk: int | None) -> pa.RecordBatch:
    n = 1 if b is None else len(b)
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
    same = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.full(n, x, np.int64)) for x in (key, chunk)]
    return pa.RecordBatch.from_arrays([*longs, *same], names=["a", "b", "key", "chunk"])


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b) for a column ``fp`` of distinct fingerprints: links that give the same components as all pairs that differ in at most ``bits`` bits."""
    tables, most = PivotTables(bits), MEETING

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in (batch.column(0).to_numpy().view(np.uint64)[at : at + DEALT] for batch in handed_back(batches) for at in range(0, batch.num_rows, DEALT)):
            keys = tables.keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    def meet(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.unique(fps)
        root = tables.linked(fps)
        at = np.flatnonzero(root != np.arange(len(fps)))
        return fps[at], fps[root[at]]

    def whole_meetings(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of meetings that are there in full."""
        edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        sizes = np.diff(edges)
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        i, j = tables.among_equal(keys[small], fps[small])
        pairs = np.unique(np.stack([fps[small][i], fps[small][j]], axis=1), axis=0)
        yield pairs[:, 0], pairs[:, 1]
        for k in np.flatnonzero(sizes > SMALL).tolist():
            yield meet(fps[edges[k] : edges[k + 1]])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each meeting, as (a, b, null, null); of one that is cut its fingerprints, as (null, fp, key, chunk), and the number of its chunks, as (null, null, key, chunks)."""
        keys, fps, cut, chunk = np.empty(0, np.int64), np.empty(0, np.uint64), None, 0

        def end_of_cut(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield _rows(None, part, cut, chunk)
            yield _rows(None, None, cut, chunk + 1)

        for batch in handed_back(batches):
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            if cut is not None and keys[-1] != cut:
                last = int(np.searchsorted(keys, cut, "right"))
                yield from end_of_cut(fps[:last])
                keys, fps, cut, chunk = keys[last:], fps[last:], None, 0
            # The last meeting may go on in the next batch
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                for a, b in whole_meetings(keys[:last], fps[:last]):
                    yield _rows(a, b, None, None)
                keys, fps = keys[last:], fps[last:]
            while len(keys) > most:
                cut = int(keys[0])
                yield _rows(None, fps[:most], cut, chunk)
                keys, fps, chunk = keys[most:], fps[most:], chunk + 1
        if cut is not None:
            yield from end_of_cut(fps)
        elif len(keys):
            for a, b in whole_meetings(keys, fps):
                yield _rows(a, b, None, None)

    def link_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in handed_back(batches):
            names = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)
            fps = batch.column(3).to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1).tolist(), len(fps)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if (name := tuple(names[start].tolist())) != last:
                    if held:
                        yield _links(*meet(np.concatenate(held)))
                    held, last = [], name
                held.append(fps[start:end])
        if held:
            yield _links(*meet(np.concatenate(held)))

    dealt = distinct.select("fp").mapInArrow(deal, "key long, fp long")
    out = written(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long, key long, chunk long"), "meetings")
    near = out.where("a IS NOT NULL").select("a", "b")
    cut = out.where("b IS NULL").select("key", F.col("chunk").alias("chunks"))
    if not cut.isEmpty():
        rows = out.where("a IS NULL AND b IS NOT NULL").select("key", "chunk", F.col("b").alias("fp")).join(cut, "key")
        rows = rows.withColumn("other", F.explode(F.expr("filter(sequence(0L, chunks - 1), x -> x <> chunk)")))
        two = rows.select("key", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "fp")
        near = near.unionByName(two.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(link_two, "a long, b long"))
    return near.distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, repeats: bool = True, bits: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, ``fp`` (a signed long), ``component_id``: the smallest key that can be reached over links of at most ``bits`` differing bits.

    A row for each row of ``docs``; other columns are not read.  A null or empty text has the
    fingerprint 0 and is linked like any other.  A null key is no one's component, so rows that
    reach only null keys have null.  An empty table gives an empty result.
    """
    rows = written(fingerprints(docs.select(F.col(key).alias("key"), *keep, text), text=text, shingle=shingle, repeats=repeats), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(links(groups, bits))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("key").alias(key), *keep, "fp", "component_id")


# ---- exact similarity ----


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``words`` words, cut and lowered as for ``fingerprint``."""
    tokens = text.lower().split()
    n = max(1, len(tokens) - words + 1) if tokens else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words])) for i in range(n)], np.uint64))


class Kept:
    """Shingle sets of the documents kept so far, found by their least hashes: sets of a similarity of ``least`` or more share one of those."""

    def __init__(self, least: float):
        self.least, self.sets, self.having, self.empty = least, [], {}, False

    def _prefix(self, found: np.ndarray) -> list[int]:
        # A little less than the share, as a product of floats may come out too large
        return found[: len(found) - math.ceil(self.least * len(found) - 1e-9) + 1].tolist()

    def has_like(self, found: np.ndarray) -> bool:
        """Whether a set so far is similar; empty ones are alike."""
        if not len(found):
            return self.empty
        for k in {k for h in self._prefix(found) for k in self.having.get(h, ())}:
            other = self.sets[k]
            if min(len(found), len(other)) < self.least * max(len(found), len(other)) - 1e-9:
                continue
            both = len(np.intersect1d(found, other, assume_unique=True))
            if both >= self.least * (len(found) + len(other) - both) - 1e-9:
                return True
        return False

    def add(self, found: np.ndarray) -> None:
        if not len(found):
            self.empty = True
            return
        for h in self._prefix(found):
            self.having.setdefault(h, []).append(len(self.sets))
        self.sets.append(found)


def _sifted(rows: DataFrame, keys: list[str], order: list, *, words: int, least: float, adding: bool) -> DataFrame:
    """The rows of ``rows`` (with ``__text`` and ``__seed``) that aren't seeds, and not similar to a seed of their ``keys`` or, if ``adding``, to a row that came out before.

    Rows of the same keys are streamed in one task, seeds first; it holds the shingle hashes of seeds and of what came out.
    """
    schema = rows.schema
    places, text, seed = [schema.names.index(k) for k in keys], schema.names.index("__text"), schema.names.index("__seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last = Kept(least), None
        for batch in handed_back(batches):
            on = []
            columns = [batch.column(at).to_pylist() for at in places]
            for name, is_seed, value in zip(zip(*columns, strict=True), batch.column(seed).to_pylist(), batch.column(text), strict=True):
                if name != last:
                    kept, last = Kept(least), name
                found = shingle_set(value.as_py(), words)
                new = not is_seed and not kept.has_like(found)
                if is_seed or (new and adding):
                    kept.add(found)
                on.append(new)
            yield batch.filter(pa.array(on, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("__seed"), *order).mapInArrow(run, schema)


def unlike(groups: DataFrame, *, group: str, order: list[Column], text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``groups`` (without ``text``) that are kept: in each group none is similar to another, and each that goes is similar to one that stays.

    Similar are rows whose sets of ``words``-word shingles have a Jaccard similarity of ``least`` or
    more.  A row goes for one before it in ``order`` (ascending, columns that tell all rows of a group apart); the first of a group always stays.  No
    pair is missed, and the size of a group changes nothing.

    Of a group of more than ``GROUP_ROWS`` the first so many in order are sifted in one task; what they keep is
    held against all others, in parts of bounded size; and so on with the first of those that are left, until none is.  So a row is decided only when all before it are.
    """
    others = [c for c in groups.columns if c != text]
    place = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))).alias("__order")
    sizes = groups.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    rows = groups.select(*others, place, text_or_empty(text).cast("binary").alias("__text"), F.lit(False).alias("__seed")).join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    parts = F.ceil(F.col("__n") / GROUP_ROWS).cast("int")
    rows = rows.withColumn("__parts", parts).withColumn("__part", F.pmod(F.xxhash64(*others), parts)).drop("__g", "__n")
    sift = lambda df, keys, adding=True: _sifted(df, keys, ["__order"], words=words, least=least, adding=adding)
    kept = sift(rows.where("__parts = 1"), [group]).select(others)
    if sizes.where(F.col("__n") > GROUP_ROWS).isEmpty():
        return kept
    left = written(rows.where("__parts > 1"), "undecided")
    # Spark keeps only so many rows of a group in each task before these thin rows meet
    rank = F.row_number().over(Window.partitionBy(group).orderBy("__order"))
    while not left.isEmpty():
        first = left.select(group, "__order").withColumn("__rank", rank).where(F.col("__rank") <= GROUP_ROWS)
        upto = written(first.groupBy(F.col(group).alias("__g")).agg(F.max("__order").alias("__upto")), "firsts")
        both = left.join(upto, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
        new = written(sift(both.where("__order <= __upto").select(left.columns), [group]), "new")
        kept = kept.unionByName(new.select(others))
        everywhere = new.withColumn("__seed", F.lit(True)).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts").cast("long") - 1)))
        later = both.where("__order > __upto").select(left.columns).unionByName(everywhere.select(left.columns))
        left = written(sift(later, [group, "__part"], False), "undecided")
    return kept
