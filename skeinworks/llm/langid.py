"""Language identification by known words, with backoff to character n-grams.

A known word adds the log of its frequency in each language.  An unseen word adds the mean
over its longest n-grams that are known, tried from ``MAX_GRAM`` characters down to one.  The
language with the largest sum wins; the score is its share after exponentials.

Words and n-grams of all lengths are counted in Spark in one pass over a sample of labelled
rows of documented size; all that occur in it are kept, as sorted arrays of their XXH64, and
broadcast.  Scoring works on Arrow batches: words are split and numbered by Arrow, each
distinct word of a slice is looked up once, and sums per document are made by NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.llm.common import sampled, text_slices

MAX_GRAM = 5
#: Labelled rows to learn from, about at most.
FIT_ROWS = 8_000
#: Added to every count.
SMOOTHING = 0.1
UNKNOWN = "und"
#: Spark's seed for XXH64.
SEED = 42
#: Characters of unseen words that are cut into n-grams at once.
CHARS_AT_ONCE = 1 << 20


def hashed(terms: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(t, SEED) for t in terms], np.uint64)


@dataclass
class Table:
    """Ascending hashes of terms, and for each a row of log frequencies by language."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each, -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


@dataclass
class LanguageModel:
    """Languages in order, a table of words, and one for each length of n-grams, from 1."""

    languages: list[str]
    words: Table
    grams: list[Table]

    def backoff(self, words: list[str]) -> np.ndarray:
        """For each word the mean over its longest known n-grams between its marks; zeros where none is known."""
        out, left, marked = np.zeros((len(words), len(self.languages)), np.float32), np.arange(len(words)), [f"^{w}$" for w in words]
        for n in range(MAX_GRAM, 0, -1):
            table, still = self.grams[n - 1], []
            sizes = np.cumsum([len(marked[i]) for i in left]) if len(left) else np.zeros(0)
            start = 0
            while start < len(left):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHARS_AT_ONCE, "right")))
                some = left[start:end]
                counts = [max(0, len(marked[i]) - n + 1) for i in some]
                owner = np.repeat(np.arange(len(some)), counts)
                at = table.find(hashed([marked[i][k : k + n] for i, c in zip(some, counts, strict=True) for k in range(c)]))
                owner, at = owner[at >= 0], at[at >= 0]
                found = np.bincount(owner, minlength=len(some))
                if len(at):
                    firsts = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
                    out[some[owner[firsts]]] = np.add.reduceat(table.rows[at], firsts, axis=0) / found[owner[firsts], None]
                still.append(some[found == 0])
                start = end
            left = np.concatenate(still) if still else left
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        """A row for each word; an empty one adds nothing."""
        at = self.words.find(hashed(words))
        out = np.zeros((len(words), len(self.languages)), np.float32)
        out[at >= 0] = self.words.rows[at[at >= 0]]
        unseen = [i for i in np.flatnonzero(at < 0).tolist() if words[i]]
        if unseen:
            out[unseen] = self.backoff([words[i] for i in unseen])
        return out

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}]+")
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        letters = np.array([bool(w) for w in words], bool)
        codes, ends = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        n = len(texts)
        total, counted = np.zeros((n, len(self.languages))), np.zeros(n)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        if len(codes):
            rows, first = self.rows(words), ends[:-1]  # no list is empty: splitting gives one string at least
            counted = np.add.reduceat(letters[codes].astype(np.int64), first)
            for k in range(len(self.languages)):
                total[:, k] = np.add.reduceat(rows[:, k][codes].astype(np.float64), first)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        has = counted > 0
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


def _table(hashes: np.ndarray, language: np.ndarray, n: np.ndarray, languages: int) -> Table:
    keys, at = np.unique(hashes, return_inverse=True)
    counts = np.zeros((len(keys), languages))
    np.add.at(counts, (at, language), n)
    totals = counts.sum(axis=0)
    return Table(keys, np.log((counts + SMOOTHING) / (totals + SMOOTHING * (len(keys) + 1))).astype(np.float32))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from ``docs``: rows with a null language don't count; of more than ``fit_rows`` others a fixed sample does.

    Every word and n-gram of the sample is kept, a row of a few bytes each; that table comes to the driver.
    """
    rows = sampled(docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")), fit_rows, "text", "lang")
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    words = rows.select("lang", word.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    kinds = [F.array(F.struct(F.lit(0).alias("kind"), F.xxhash64("word").alias("h")))]
    for k in range(1, MAX_GRAM + 1):
        spots = f"if(length(m) >= {k}, sequence(1, length(m) - {k - 1}), array())"
        kinds.append(F.expr(f"transform({spots}, i -> struct({k} AS kind, xxhash64(substring(m, i, {k})) AS h))"))
    terms = words.withColumn("m", F.concat(F.lit("^"), "word", F.lit("$"))).select("lang", "n", F.explode(F.concat(*kinds)).alias("t"))
    found = terms.groupBy("lang", "t.kind", "t.h").agg(F.sum("n").alias("n")).toArrow()
    # Rows without a word tell of their language, too
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    place = {lang: i for i, lang in enumerate(languages)}
    coded = found.column("lang").combine_chunks().dictionary_encode()
    language = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    kind, hashes, n = (found.column(c).to_numpy() for c in ("kind", "h", "n"))
    hashes = hashes.astype(np.int64).view(np.uint64)
    tables = [_table(hashes[kind == k], language[kind == k], n[kind == k], len(languages)) for k in range(MAX_GRAM + 1)]
    return LanguageModel(languages, tables[0], tables[1:])


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` without ``text``, with the predicted language and its score from 0 to 1.

    A text that is null, or has no letter, is ``und`` with score 0; so is every text under a
    model that saw no language.  Ties go to the smaller name.  Repeated rows agree, an empty
    table gives an empty one; columns named like the outputs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_out, score_out)
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, len(others)):
            names, scores = shared.value.score(part.column(len(others)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(text).cast("string").alias(text)).mapInArrow(score, schema)
