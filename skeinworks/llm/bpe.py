"""Byte-level BPE: encoding with a rank queue on a hierarchical bitmap, and decoding.

A text is split by a pattern into pre-tokens.  A pre-token that the vocabulary has as a
whole is one id.  Any other starts as a doubly linked list of bytes; each adjacent pair
with a rank waits in the bucket of that rank, as the position of its left part.  A bitmap
with a level above it says which buckets hold anything, so the lowest rank is found by one
find-first-set per level.  Merging a pair changes the pairs to its left and right;
their old entries stay in their buckets and are skipped when they come up ("stale").  Each
byte costs a bounded number of entries, so a pre-token of n bytes takes O(n log n) time
at worst and never the n * n of repeated scans.

Texts stream through Arrow batches, without a shuffle; the tasks read the rank file
themselves, as every worker has it (its path is a parameter).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.llm.common import handed_back

#: Pre-tokens kept with their ids by a worker, and the longest that is kept; a full table starts anew.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64
#: Pairs of ids whose rank is kept.
CACHE_PAIRS = 200_000
#: Ids (or bytes) at which an output batch is closed.
BATCH_ITEMS = 2_000_000


class RankQueue:
    """A priority queue of (rank, position): lowest rank, then leftmost position, first.

    ``buckets[rank]`` holds positions; ``words`` has a bit for each rank whose bucket holds any,
    256 to a word, and ``top`` a bit for each word that isn't zero.
    """

    __slots__ = ("buckets", "top", "words")

    def __init__(self, size: int):
        self.buckets: list[list[int] | None] = [None] * size
        self.words, self.top = [0] * ((size >> 8) + 1), 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 8
        self.words[word] |= 1 << (rank & 255)
        self.top |= 1 << word

    def pop(self) -> tuple[int, int]:
        """Only while ``top`` isn't 0."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        rank = (word << 8) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        self.buckets[rank] = None
        bits &= bits - 1
        self.words[word] = bits
        if not bits:
            self.top = top & (top - 1)
        return rank, bucket[0]


class _Pairs(dict):
    """(left id, right id) in one integer to the rank of the joined bytes, -1 where they are no token; filled as needed and bounded."""

    def __init__(self, vocabulary: RankVocabulary):
        self.tokens, self.ranks = vocabulary.tokens, vocabulary.ranks

    def __missing__(self, key: int) -> int:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        rank = self[key] = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF], -1)
        return rank


class RankVocabulary:
    """The ranks of a tiktoken file: token bytes to ids, and back.  A file that lacks a single byte is an error, as some text would have no ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.size = max(self.ranks.values(), default=-1) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        if -1 in self.of_byte:
            raise ValueError(f"{path} has no rank for the byte {self.of_byte.index(-1)}")
        self.pairs, self.queue = _Pairs(self), RankQueue(self.size)

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, pairs, queue = len(piece), self.pairs, self.queue
        ids = [self.of_byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [-1] * n  # the rank of the pair that begins here, while it can be merged
        push = queue.push
        for i in range(n - 1):
            rank = pairs[ids[i] << 32 | ids[i + 1]]
            if rank >= 0:
                waits[i] = rank
                push(rank, i)
        while queue.top:
            rank, left = queue.pop()
            if waits[left] != rank:
                continue  # stale: this pair has changed since
            right = after[left]
            ids[left], ids[right], waits[right] = rank, -1, -1
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                waits[left] = new = pairs[rank << 32 | ids[beyond]]
                if new >= 0:
                    push(new, left)
            else:
                waits[left] = -1
            previous = before[left]
            if previous >= 0:
                waits[previous] = new = pairs[ids[previous] << 32 | rank]
                if new >= 0:
                    push(new, previous)
        return [i for i in ids if i >= 0]


class _Encoded(dict):
    """Pre-token to the little-endian 32-bit ids, filled as needed and bounded."""

    def __init__(self, vocabulary: RankVocabulary, entries: int):
        self.vocabulary, self.entries = vocabulary, entries

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode(piece.encode()), dtype="<i4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> RankVocabulary:
    return RankVocabulary(path)


@lru_cache(maxsize=2)
def _encoded(path: str, entries: int) -> _Encoded:
    """One for all tasks of a worker."""
    return _Encoded(_vocabulary(path), entries)


def _with_column(batch: pa.RecordBatch, array: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, array], names=[*batch.schema.names, name])


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, out: str, entries: int) -> Iterator[pa.RecordBatch]:
    cache, split = _encoded(path, entries), regex.compile(pattern).findall
    ids_of = cache.__getitem__

    for batch in handed_back(batches):
        at = batch.schema.names.index(text)
        start, held, ends = 0, [], [0]
        for row, value in enumerate(batch.column(at)):
            ids = b"".join(map(ids_of, split(value.as_py() or "")))
            held.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
            if ends[-1] >= BATCH_ITEMS or row == batch.num_rows - 1:
                values = pa.array(np.frombuffer(b"".join(held), dtype="<i4"))
                array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield _with_column(batch.slice(start, row + 1 - start), array, out)
                start, held, ends = row + 1, [], [0]


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids", cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """``docs`` with ``out array<int>``: the ids of the whole text.

    A null or empty text has no ids.  All columns of ``docs`` are kept; one named ``out`` is replaced.
    Rows are independent: repeated rows get the same ids, an empty table gives an empty one.
    Special tokens are never recognised; their letters are ordinary text.  A worker remembers up
    to ``cache_entries`` pre-tokens, about 200 bytes each; the ids don't depend on it.
    """
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda batches: _encode_batches(batches, ranks_path, pattern, text, out, cache_entries), schema)


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary(path)
    token_of = vocabulary.tokens.__getitem__
    for batch in handed_back(batches):
        column = batch.column(batch.schema.names.index(ids))
        start, held, size = 0, [], 0
        for row, value in enumerate(column):
            found = value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.empty(0, np.int64)
            held.append(b"".join(map(token_of, found.tolist())))
            size += len(held[-1])
            if size >= 8 * BATCH_ITEMS or row == batch.num_rows - 1:
                yield _with_column(batch.slice(start, row + 1 - start), pa.array(held, pa.binary()), out)
                start, held, size = row + 1, [], 0


def decode(encoded: DataFrame, *, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out binary``: the bytes that the ids stand for; null ids give no bytes.  An unknown id is an error."""
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])
    return encoded.mapInArrow(lambda batches: _decode_batches(batches, ranks_path, ids, out), schema)


def digests(docs: DataFrame, *, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, decode, and per document the number of ids and the SHA-256 of ids and decoded bytes.

    ``docs`` without ``text``, a row for each row; columns named like the results are replaced.  A null
    or empty text has no ids, and the digests of nothing.  Repeated rows agree, an empty table gives an empty one.
    """
    plain = encode(docs, ranks_path=ranks_path, pattern=pattern, text=text, out="__ids").drop(text)
    both = decode(plain, ranks_path=ranks_path, ids="__ids", out="__decoded")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    return both.select(
        *kept,
        F.size("__ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("__ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("__decoded"), 256).alias("decoded_sha256"),
    )
