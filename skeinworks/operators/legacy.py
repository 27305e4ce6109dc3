"""Two earlier classifiers: batches of short transcripts, and overlapping chunks merged by rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.messages import USER, turn_labels
from skeinworks.functions.text import elide
from skeinworks.operators.inference import retried

#: What stands for the middle of a long message; a fixed value.
MIDDLE = "\n[…message middle omitted…]\n"

#: Labels from weak to strong; fixed values.
ORDERS = {"consumption": ("no", "uncertain", "yes"), "extension": ("none", "potential", "clear"), "review": ("no", "maybe", "yes")}


def _limit(message: Column, user: int, assistant: int) -> Column:
    return F.when(message["role"] == USER, user).otherwise(assistant)


def screened(messages: Column, *, user: int = 500, assistant: int = 300) -> Column:
    """A transcript of elided turns, one to a line; users and assistants have limits of their own."""

    def line(label: Column, m: Column) -> Column:
        short = F.when(m["role"] == USER, elide(m["content"], user)).otherwise(elide(m["content"], assistant))
        return F.concat(F.lit("["), label, F.lit("] "), short)

    return F.array_join(F.zip_with(turn_labels(messages), messages, line), "\n")


def truncated_count(messages: Column, *, user: int = 500, assistant: int = 300) -> Column:
    """How many messages ``screened`` elides."""
    return F.size(F.filter(messages, lambda m: F.length(m["content"]) > _limit(m, user, assistant)))


def exchanges(messages: Column, *, limit: int = 3_000) -> Column:
    """Each message as ``[U1] text``, the middle of those beyond ``limit`` left out; an array, for ``overlapping_chunks``."""
    return F.zip_with(turn_labels(messages), messages, lambda label, m: F.concat(F.lit("["), label, F.lit("] "), elide(m["content"], limit, 80, MIDDLE)))


def ordinal_argmax(parts: DataFrame, key: str, name: str, *, chunk: str = "chunk", label: str | None = None, confidence: str = "confidence") -> DataFrame:
    """For each ``key`` the strongest label, its largest confidence, and the earliest chunk with both."""
    label = label or name
    rank = F.array_position(F.array(*(F.lit(x) for x in ORDERS[name])), F.col(label))
    best = F.max(F.struct(rank.alias("rank"), F.col(confidence).alias("confidence"), (-F.col(chunk)).alias("neg"), F.col(label).alias("label")))
    return parts.groupBy(key).agg(best.alias("best")).select(key, F.col("best.label").alias(label), F.col("best.confidence").alias(confidence), (-F.col("best.neg")).alias(chunk))


def merged(parts: DataFrame, key: str, *, chunk: str = "chunk") -> DataFrame:
    """The chunks' answers of one conversation as one: for each of ``ORDERS`` (columns struct<label, confidence>) what ``ordinal_argmax`` would keep, in a single pass."""

    def strongest(name: str) -> Column:
        rank = F.array_position(F.array(*(F.lit(x) for x in ORDERS[name])), F.col(name)["label"])
        return F.max_by(F.col(name), F.struct(rank, F.col(name)["confidence"], -F.col(chunk))).alias(name)

    return parts.groupBy(key).agg(*(strongest(name) for name in ORDERS), F.count(F.lit(1)).alias("chunks"))


def classify_chunks(chunks: DataFrame, call: Callable[[str, int, int], dict], *, key: str = "id", attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """key, chunk, a struct<label, confidence> for each of ``ORDERS``, and ``error``, from a model called on each chunk's text, its number and how many there are.

    Chunks are independent, so a conversation's chunks may be tasks apart; ``merged`` joins what they say.
    """
    ask = retried(call, attempts, pause)
    of = chunks.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("__of"))
    answer = ", ".join(f"{name} struct<label:string,confidence:double>" for name in ORDERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, chunk, total, text in zip(batch[key], batch["chunk"], batch["__of"], batch["text"], strict=True):
                try:
                    found = ask(text, chunk + 1, total)
                    out.append((k, chunk, *(found[name] for name in ORDERS), None))
                except Exception as error:  # the chunk goes to the error ledger
                    out.append((k, chunk, *(None for _ in ORDERS), f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[key, "chunk", *ORDERS, "error"])

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.join(of, key).select(key, "chunk", "__of", "text").mapInPandas(run, f"`{key}` {kind}, chunk int, {answer}, error string")


def chunk_bounds(lengths: list[int], limit: int, overlap: int, gap: int) -> list[tuple[int, int]]:
    """(first, last) of each chunk: from running sums, how far a chunk from each piece would reach; then the chunks are the jumps from the first piece on."""
    if not lengths:
        return []
    upto = np.cumsum(np.asarray(lengths, np.int64) + gap)
    before = np.concatenate(([0], upto[:-1]))
    reach = np.searchsorted(upto - gap, before + limit, "right")
    reach = np.maximum(reach, np.arange(1, len(lengths) + 1)).tolist()
    bounds = [(0, reach[0])]
    while (end := bounds[-1][1]) < len(lengths):
        first = max(bounds[-1][0] + 1, end - overlap)
        bounds.append((first, reach[first]))
    return bounds


def overlapping_chunks(rows: DataFrame, pieces: str, *, key: str = "id", limit: int = 72_000, overlap: int = 4, separator: str = "\n\n") -> DataFrame:
    """key, chunk, first, last (exclusive), text: pieces in order, each chunk starting ``overlap`` pieces before the end of the last.

    A chunk holds at least one piece and starts after the one before.  The bounds come from
    the pieces' lengths in Arrow batches; rows are independent.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, parts in zip(batch[key], batch[pieces], strict=True):
                bounds = chunk_bounds([len(p) for p in parts], limit, overlap, len(separator))
                out += [(k, n, a, b, separator.join(parts[a:b])) for n, (a, b) in enumerate(bounds)]
            yield pd.DataFrame(out, columns=[key, "chunk", "first", "last", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, pieces).mapInPandas(cut, f"`{key}` {kind}, chunk int, first int, last int, text string")


def filled(lengths: list[int], max_items: int, max_characters: int, items: int = 0, held: int = 0) -> tuple[list[int], int, int]:
    """For each record the number of batches begun before its own, and items and characters of the last batch, from a batch with ``items`` and ``held``.

    How far a batch reaches is looked up in the running sums.
    """
    n, upto = len(lengths), np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64))))

    def reach(at: int, room: int, characters: int) -> int:
        return max(at, min(n, at + room, int(np.searchsorted(upto, upto[at] + characters, "right")) - 1))

    begins, at = [], reach(0, max_items - items, max_characters - held) if items else 0
    while at < n:
        begins.append(at)
        at = max(at + 1, reach(at, max_items, max_characters))
    numbers = (np.searchsorted(begins, np.arange(n), "right") - (items == 0)).tolist()
    if begins:
        return numbers, n - begins[-1], int(upto[n] - upto[begins[-1]])
    return numbers, items + n, held + int(upto[n])


def pack_batches(rows: DataFrame, *, key: str, position: str, length: str, max_items: int = 8, max_characters: int = 44_000, block: int = 100_000) -> DataFrame:
    """key, block, batch: records in source order filled into batches as in one pass; ``batch`` is unique over the table.

    Greedy filling depends on all that came before, but a batch that comes into a block of the
    source ends before one of its first ``max_items`` + 1 records, or not in the block.  Blocks are
    filled from each of these records, and thin rows, one a block, chain what comes true.
    """
    at = F.col(position)
    thin = rows.select(F.col(key), at.cast("long").alias("__at"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("__n"), F.floor(at / block).cast("long").alias("block"))

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        lengths = part.sort_values(["__at", key], kind="stable")["__n"].tolist()
        found = [filled(lengths[k:], max_items, max_characters) for k in range(min(max_items + 1, len(lengths)))]
        return pd.DataFrame([(int(part["block"].iloc[0]), lengths[: max_items + 1], [n[-1] for n, _, _ in found], [i for _, i, _ in found], [h for _, _, h in found])], columns=["block", "head", "cuts", "items", "held"])

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        batch, items, held, out = 0, 0, 0, []
        for r in part.sort_values("block").itertuples():
            out.append((r.block, batch, items, held))
            numbers, i, h = filled(list(r.head), max_items, max_characters, items, held)
            begun = numbers.index(1) if 1 in numbers else None
            if items == 0:
                batch, items, held = batch + r.cuts[0], r.items[0], r.held[0]
            elif begun is None:
                # No batch ends in the block, so it has no more records than its head
                items, held = i, h
            else:
                batch, items, held = batch + 1 + r.cuts[begun], r.items[begun], r.held[begun]
        return pd.DataFrame(out, columns=["block", "first", "items", "held"])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__at", key], kind="stable")
        first, items, held = (int(part[c].iloc[0]) for c in ("first", "items", "held"))
        numbers, _, _ = filled(part["__n"].tolist(), max_items, max_characters, items, held)
        return part.assign(batch=[first + n for n in numbers])[[key, "block", "batch"]]

    kind = rows.schema[key].dataType.simpleString()
    blocks = thin.groupBy("block").applyInPandas(ends, "block long, head array<long>, cuts array<long>, items array<long>, held array<long>")
    starts = blocks.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(chain, "block long, first long, items long, held long")
    return thin.join(starts, "block").groupBy("block").applyInPandas(fill, f"`{key}` {kind}, block long, batch long")
