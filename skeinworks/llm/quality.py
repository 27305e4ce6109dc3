"""A quality classifier: nearest labelled neighbours vote in a latent-semantic space.

A document's terms are its words, all of them, and how its tokens are written: their shapes,
and repeats of the token before.  Every character of a text is part of a term; long runs are
cut into consecutive windows.  Both groups of terms, damped, weighted by rarity and scaled
alike, are projected on the leading singular vectors of a sample of labelled documents.  That
sample's vectors and labels, of documented size, are broadcast; every document is compared
with all of them by exact blocked cosine products, and its nearest vote with weights that grow
with the similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.llm.common import handed_back, sampled, text_or_empty, text_slices

#: Labelled documents that are kept, about at most; dimensions of the latent space; neighbours that vote.
FIT_ROWS, DIMENSIONS, NEIGHBOURS = 4_000, 48, 15
#: Buckets of terms: shapes of tokens, repeats, what has no token, then words.
SHAPES, WORDS = 1022, 8192
REPEAT, EMPTY = SHAPES, SHAPES + 1
FIRST_WORD = SHAPES + 2
TERMS = FIRST_WORD + WORDS
#: Characters of a word's window, signs of a shape's and the characters that it spans, at most.
WORD_WINDOW, SHAPE_WINDOW, SHAPE_SPAN = 24, 12, 48
#: What words weigh beside shapes.
WORD_WEIGHT = 0.5
#: Power of the similarity that is a vote's weight, and the weight of the prior.
SHARPNESS, PRIOR_WEIGHT = 8, 0.05
#: Bytes of texts, tokens counted, entries projected, and labelled documents multiplied at once; rounds and spare dimensions of the decomposition.
BYTES_AT_ONCE, TOKENS_AT_ONCE, ENTRIES_AT_ONCE, ROWS_AT_ONCE, ROUNDS, SPARE = 1 << 19, 1 << 17, 1 << 15, 500, 8, 16
_WORD = re.compile(r"[^\W_]+")


class _Signs(dict):
    """Character to its sign, for ``str.translate``: capitals, other letters and digits are alike, others as they are; filled as needed."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        sign = self[code] = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        return sign


_SIGNS, _RUN = _Signs(), re.compile(r"([Xx9])\1+")


def shapes(token: str) -> list[str]:
    """The token's windows, each with a run of capitals, other letters and digits as one sign, other characters as they are; together they hold the whole token."""
    signs, found, start = token.translate(_SIGNS), [], 0
    while start < len(signs):
        window = signs[start : start + SHAPE_SPAN]
        short = _RUN.sub(r"\1", window)
        if len(short) > SHAPE_WINDOW:
            # As far as the signs go that a window has
            window = re.match(rf"(?:X+|x+|9+|[^Xx9]){{{SHAPE_WINDOW}}}", window, re.DOTALL)[0]
            short = short[:SHAPE_WINDOW]
        found.append(short)
        start += len(window)
    return found


def words(token: str) -> list[str]:
    """The token's runs of letters and digits in lower case, long ones in windows."""
    return [run[at : at + WORD_WINDOW] for run in _WORD.findall(token.lower()) for at in range(0, len(run), WORD_WINDOW)]


def terms_of(token: str) -> list[int]:
    return [*(zlib.crc32(x.encode()) % SHAPES for x in shapes(token)), *(FIRST_WORD + zlib.crc32(x.encode()) % WORDS for x in words(token))]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, minlength=len(found))


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count), by row and term, of the terms of each text.  A text without tokens has one, ``EMPTY``."""
    lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[\x20\x09-\x0D]+")
    coded = lists.values.dictionary_encode()
    tokens = coded.dictionary.to_pylist()
    codes, ends = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    found = [terms_of(t) if t else [] for t in tokens]
    sizes = np.array([len(f) for f in found], np.int64)
    flat, starts = np.array([x for f in found for x in f], np.int64), np.cumsum(sizes) - sizes
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]) & (sizes[codes[1:]] > 0)
    parts = [(row[again] * TERMS + REPEAT, np.ones(int(again.sum())))]
    for at in range(0, len(codes), TOKENS_AT_ONCE):
        some = codes[at : at + TOKENS_AT_ONCE]
        n = sizes[some]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        keys, counts = np.unique(np.repeat(row[at : at + TOKENS_AT_ONCE], n) * TERMS + flat[np.repeat(starts[some], n) + inside], return_counts=True)
        parts.append((keys, counts))
    has = np.bincount(row, sizes[codes] > 0, minlength=len(texts)) > 0
    empty = np.flatnonzero(~has)
    parts.append((empty * TERMS + EMPTY, np.ones(len(empty))))
    keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    return keys // TERMS, keys % TERMS, counts


def weighed(row: np.ndarray, term: np.ndarray, count: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The weight of each entry: words and shapes of a row are vectors of fixed lengths, and the whole has length 1."""
    n = int(row[-1]) + 1 if len(row) else 0
    group = 2 * row + (term >= FIRST_WORD)
    weight = np.sqrt(count / np.bincount(group, count, minlength=2 * n)[group]) * rarity[term]
    length = np.sqrt(np.bincount(group, weight**2, minlength=2 * n))
    weight *= np.where(term >= FIRST_WORD, WORD_WEIGHT, 1.0) / np.maximum(length[group], 1e-12)
    return weight / np.sqrt(np.bincount(row, weight**2, minlength=n))[row]


def product(at: np.ndarray, other: np.ndarray, weight: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``weight`` times the rows ``other`` of ``matrix``, for each of ``n`` places ``at`` (ascending)."""
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    for start in range(0, len(at), ENTRIES_AT_ONCE):
        part = slice(start, start + ENTRIES_AT_ONCE)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(at[part])) + 1))
        out[at[part][edges]] += np.add.reduceat(matrix[other[part]] * weight[part, None].astype(matrix.dtype), edges, axis=0)
    return out


def leading(row: np.ndarray, term: np.ndarray, weight: np.ndarray, dimensions: int) -> np.ndarray:
    """(TERMS, dimensions): the leading right singular vectors of the entries' matrix, by subspace iteration from a fixed start; some rows at a time are dense."""
    n = int(row[-1]) + 1
    basis = np.random.default_rng(3).normal(size=(TERMS, dimensions + SPARE)).astype(np.float32)
    edges = np.searchsorted(row, np.arange(0, n + ROWS_AT_ONCE, ROWS_AT_ONCE))
    for _ in range(ROUNDS):
        basis, gram = np.linalg.qr(basis)[0], np.zeros_like(basis)
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            rows = np.zeros((ROWS_AT_ONCE, TERMS), np.float32)
            rows[row[a:b] - k * ROWS_AT_ONCE, term[a:b]] = weight[a:b]
            gram += rows.T @ (rows @ basis)
        last, basis = basis, gram
    strength, turned = np.linalg.eigh((last.T @ gram).astype(np.float64))
    kept = turned[:, ::-1][:, : min(dimensions, n)]
    return last @ kept.astype(np.float32) * (strength[::-1][: kept.shape[1]] > 1e-6)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class QualityModel:
    """Term weights, the projection, and the labelled vectors (unit length) with their labels."""

    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, texts: pa.Array) -> np.ndarray:
        row, term, count = bags(texts)
        return _unit(product(row, term, weighed(row, term, count, self.rarity), self.projection, len(texts)))

    def score(self, texts: pa.Array) -> np.ndarray:
        """The weighted share of label 1 among each text's nearest labelled vectors; 0.5 without any."""
        if not len(self.labels) or not len(texts):
            return np.full(len(texts), 0.5)
        prior, k = float(self.labels.mean()), min(NEIGHBOURS, len(self.labels))
        latent, out = self.latent(texts), np.empty(len(texts))
        for at in range(0, len(texts), 512):
            near = latent[at : at + 512] @ self.vectors.T
            top = np.argpartition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
            weight = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 0) ** SHARPNESS
            out[at : at + 512] = ((weight * self.labels[top]).sum(axis=1) + PRIOR_WEIGHT * prior) / (weight.sum(axis=1) + PRIOR_WEIGHT)
        return np.clip(out, 0.0, 1.0)


def learn(row: np.ndarray, term: np.ndarray, count: np.ndarray, labels: np.ndarray) -> QualityModel:
    """The model of labelled documents, given by their entries."""
    n = len(labels)
    rarity = np.log((1 + n) / (1 + np.bincount(term, minlength=TERMS))) + 1
    weight = weighed(row, term, count, rarity)
    projection = leading(row, term, weight, DIMENSIONS)
    return QualityModel(rarity, projection, _unit(product(row, term, weight, projection, n)), labels)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from documents with a label, joined on doc_id: about ``fit_rows`` at most, chosen by a hash of id and label.

    Null labels and ids don't count; an id that either table repeats counts once, with its
    smallest label and text.  Only this sample's terms come to the driver, at most ``TERMS`` for each.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    # A sample of bounded size, so the documents needn't be shuffled to meet it
    pairs = docs.select("doc_id", text_or_empty(text).alias("text")).join(F.broadcast(sampled(chosen, fit_rows, "doc_id", "label")), "doc_id")
    once = pairs.groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("p")).select("doc_id", "p.label", "p.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(handed_back(batches), 2, BYTES_AT_ONCE):
            row, term, n = bags(part.column(2))
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            packed = [[x[a:b].astype("<i4").tobytes() for a, b in zip(edges, edges[1:], strict=False)] for x in (term, n)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), *(pa.array(x, pa.binary()) for x in packed)], names=["doc_id", "label", "terms", "counts"])

    kept = sorted(once.mapInArrow(count, "doc_id string, label int, terms binary, counts binary").collect())
    if not kept:
        return QualityModel(np.ones(TERMS), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    terms = [np.frombuffer(r["terms"], "<i4").astype(np.int64) for r in kept]
    counts = np.concatenate([np.frombuffer(r["counts"], "<i4") for r in kept]).astype(np.float64)
    return learn(np.repeat(np.arange(len(kept)), [len(t) for t in terms]), np.concatenate(terms), counts, np.array([float(r["label"] == 1) for r in kept]))


def scored(docs: DataFrame, model: QualityModel, *, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (without ``text``, unless kept) with ``out``, from 0 to 1: the likelihood of label 1.

    A null or empty text is scored by what empty texts were labelled.  Rows are independent:
    repeated rows agree, an empty table gives an empty one.  A column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)
    others = [c for c in docs.columns if keep_text or c != text]
    at = others.index(text) if keep_text else len(others)
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(handed_back(batches), at, BYTES_AT_ONCE):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(shared.value.score(part.column(at)))], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in [*others, text][: max(at + 1, len(others))])).mapInArrow(run, schema)
