"""Ranked lexical search: windowed bucket scoring of whole documents for every query text.

A first pass counts the terms of each document and keeps those that any query has, as thin postings in the
shared folder; totals and document frequencies come from these.  A second pass goes over the postings in
windows of a fixed number of documents, in order of their ids: what a posting adds to a score is computed once, and each query adds its terms'
postings to an array of the window, one place a document, small enough for a processor's cache.  Bits that say which places were hit are
joined term by term; only these are harvested, into the query's heap of best documents.  A task emits its best for each query, and a ranking over
these rows gives the best of all: scores don't depend on how documents are dealt out.

Queries come in groups of bounded size, as their terms are sent to all tasks; more of them are more passes.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from skeinworks.llm.common import handed_back, text_or_empty, text_slices, written
from skeinworks.llm.words import stretches

#: A term, of bytes and of characters: letters A-Z in lower case, digits, and everything beyond ASCII.
TERM, TERM_PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents found for a query.
BEST = 10
#: Terms (of distinct texts, each once) of the queries that are searched for at once, about.
TERMS_AT_ONCE = 1 << 20
#: Documents of a window (its array of scores takes 64 kB), and postings at most: a window ends early rather than hold more.
WINDOW_DOCS, WINDOW_POSTINGS = 8192, 1 << 21
#: Terms of a window whose bits are remembered.
KEPT_BITS = 8192
#: Text of a batch, in bytes.
BYTES_AT_ONCE = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """``__key`` and ``__terms`` of the distinct texts that have a term."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0)))
    found = queries.select(F.sha2(text_or_empty(text), 256).alias("__key"), terms.alias("__terms")).where(F.size("__terms") > 0)
    return found.dropDuplicates(["__key"])


def weights(n: int, frequencies: np.ndarray) -> np.ndarray:
    """What a term weighs that ``frequencies`` of ``n`` documents hold."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


def lengths(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """The documents' lengths against the mean of all, in hundredths, mixed with a tenth of it."""
    return np.array([100 - 90 + 90 * int(s) * n // total for s in sizes], np.int64)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], *, key: str, text: str) -> DataFrame:
    """key, size (terms with repeats) and the ``vocabulary``'s terms in it with their counts, for each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([docs.select(key).schema[0], *T.StructType.fromDDL("size long, terms array<int>, counts array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_slices(handed_back(batches), 1, BYTES_AT_ONCE):
            rows, size, terms, counts, edges = [], [], [], [], [0]
            for at, raw in enumerate(part.column(1).cast(pa.binary())):
                seen = Counter()
                for words in stretches(raw.as_py(), TERM):
                    seen.update(words)
                if seen:
                    rows.append(at)
                    size.append(seen.total())
                    found = sorted((known[w], n) for w, n in seen.items() if w in known)
                    terms += [t for t, _ in found]
                    counts += [n for _, n in found]
                    edges.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()), *lists], names=schema.names)

    return docs.select(key, text_or_empty(text).alias(text)).mapInArrow(run, schema)


def document_frequencies(held: DataFrame, n: int) -> np.ndarray:
    """How many documents hold each of the ``n`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n, np.int64)
        for batch in handed_back(batches):
            count += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some])], names=["term", "n"])

    found = np.zeros(n, np.int64)
    for r in held.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each query term
        found[r["term"]] = r["n"]
    return found


class Postings:
    """The postings of some documents, by term, with what each adds to a score."""

    def __init__(self, terms: np.ndarray, slots: np.ndarray, adds: np.ndarray, docs: int):
        order = np.argsort(terms, kind="stable")
        self.slots, self.adds = slots[order], adds[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.docs, self.known = docs, {}
        self.scores = np.zeros(docs, np.int64)

    def bits(self, at: int) -> np.ndarray:
        """Which documents of the window hold its term number ``at``."""
        found = self.known.get(at)
        if found is None:
            here = np.zeros(self.docs, bool)
            here[self.slots[self.starts[at] : self.starts[at + 1]]] = True
            found = np.packbits(here)
            if len(self.known) < KEPT_BITS:
                self.known[at] = found
        return found

    def harvest(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places (ascending) that any of the ``wanted`` terms hit with a score above 0, and their scores."""
        found = np.searchsorted(self.terms, wanted)
        found = found[self.terms[np.minimum(found, len(self.terms) - 1)] == wanted]
        hit = np.zeros((self.docs + 7) // 8, np.uint8)
        for at in found:
            a, b = self.starts[at], self.starts[at + 1]
            self.scores[self.slots[a:b]] += self.adds[a:b]
            hit |= self.bits(at)
        places = np.flatnonzero(np.unpackbits(hit, count=self.docs))
        scores = self.scores[places]
        self.scores[places] = 0
        return places[scores > 0], scores[scores > 0]


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows, in order, by windows."""
    held, docs, size = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = min(at + WINDOW_DOCS - docs, int(np.searchsorted(sizes, before + WINDOW_POSTINGS - size, "right")))
            if end <= at and held:
                yield held
                held, docs, size = [], 0, 0
                continue
            end = max(end, at + 1)
            held.append(batch.slice(at, end - at))
            docs, size, at = docs + end - at, size + int(sizes[end - 1]) - before, end
            if docs >= WINDOW_DOCS or size >= WINDOW_POSTINGS:
                yield held
                held, docs, size = [], 0, 0
    if held:
        yield held


def best_of_parts(held: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n: int, total: int, *, best: int) -> DataFrame:
    """query (its place in ``queries``), key, score: the best documents of each partition for each query, in whatever order."""
    shared = held.sparkSession.sparkContext.broadcast((queries, weight))
    key = held.schema[0]
    key_type = to_arrow_type(key.dataType)
    schema = T.StructType([T.StructField("query", T.IntegerType()), key, T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weighs = shared.value
        heaps: list[list[tuple[int, int, pa.Scalar]]] = [[] for _ in asked]
        before = 0
        for parts in windows(handed_back(batches)):
            whole = pa.Table.from_batches(parts).combine_chunks()
            keys, sizes, terms, counts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns)
            slots = np.repeat(np.arange(len(keys)), terms.value_lengths().to_numpy(zero_copy_only=False))
            length = lengths(sizes.to_numpy(zero_copy_only=False), n, total)
            terms, counts = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, counts))
            if not len(terms):
                before += len(keys)
                continue
            window = Postings(terms, slots, weighs[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * length[slots])), len(keys))
            for wanted, heap in zip(asked, heaps, strict=True):
                places, scores = window.harvest(wanted)
                if len(heap) == best:  # ids ascend, so equal scores come too late
                    over = scores > heap[0][0]
                    places, scores = places[over], scores[over]
                for at in np.argsort(-scores, kind="stable")[:best]:
                    entry = (int(scores[at]), -before - int(places[at]), keys[int(places[at])])
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
            before += len(keys)
        found = [(q, k.as_py(), score) for q, heap in enumerate(heaps) for score, _, k in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f) for k, f in enumerate((pa.int32(), key_type, pa.int64()))], names=schema.names)

    # In order of the ids inside each partition, nulls last: no shuffle
    return held.sortWithinPartitions(F.asc_nulls_last(key.name)).mapInArrow(run, schema)


def search(docs: DataFrame, queries: DataFrame, *, query_key: str = "item_id", query_text: str = "text", key: str = "doc_id", text: str = "text", best: int = BEST, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """query_key, rank (from 1), key, score: the ``best`` documents with a score above 0 for each query, equal scores by ascending key, nulls last.

    A query's score of a document sums over its distinct terms, whole numbers throughout but for a term's weight.
    Null texts have no terms; such documents don't count, and such queries find nothing.  Repeated rows of
    documents are documents of their own; a wholly repeated query is one, and queries that share a key are ranked each
    for itself.  Empty tables give an empty one.  Other columns aren't read.
    """
    spark = docs.sparkSession
    asked = written(query_terms(queries, query_text), "queries")
    total_terms = asked.agg(F.coalesce(F.sum(F.size("__terms")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total_terms // terms_at_once))
    shape = T.StructType([T.StructField("__key", T.StringType()), docs.select(key).schema[0], T.StructField("score", T.LongType())])
    found = None
    for group in range(groups):
        # Bounded by ``terms_at_once``
        rows = asked.where(F.pmod(F.xxhash64("__key"), F.lit(groups)) == group).orderBy("__key").collect()
        vocabulary: dict[bytes, int] = {}
        wanted = [np.unique([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r["__terms"]]) for r in rows]
        held = written(postings(docs, vocabulary, key=key, text=text), "postings")
        n, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not rows or not n:
            continue
        weight = weights(n, document_frequencies(held, len(vocabulary)))
        parts = best_of_parts(held, wanted, weight, n, total, best=best)
        keys = spark.createDataFrame(list(enumerate(r["__key"] for r in rows)), "query int, __key string")
        part = parts.join(F.broadcast(keys), "query").select("__key", key, "score")  # a row for each query of the group
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], shape)
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("score"), F.asc_nulls_last(key)))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= best).withColumnRenamed(key, "__doc")
    named = queries.select(F.col(query_key).alias("__query"), F.sha2(text_or_empty(query_text), 256).alias("__key")).dropDuplicates()
    return named.join(ranked, "__key").select(F.col("__query").alias(query_key), "rank", F.col("__doc").alias(key), "score")


#: The same from all postings at once.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM s),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM t) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT item_id, text, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN s USING (r), t GROUP BY item_id, text, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x JOIN s USING (r) WHERE score > 0 QUALIFY rank <= 10
"""
