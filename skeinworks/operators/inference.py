"""Running a model that the caller brings: retries, later parts only where the first calls for them, batches that fall back to single items.

Each function takes plain callables, which must be picklable, and runs them inside tasks on
Arrow batches of rows.  A row's failure becomes its ``error``; it doesn't fail the task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Call = Callable[..., dict]


def retried(call: Callable, attempts: int = 3, pause: float = 1.0) -> Callable:
    """``call``, tried again after pauses that double; the last failure is raised."""

    def run(*args):
        for left in reversed(range(attempts)):
            try:
                return call(*args)
            except Exception:
                if not left:
                    raise
                time.sleep(pause * 2 ** (attempts - 1 - left))
        raise ValueError("no attempts")

    return run


def is_positive(answer: dict) -> bool:
    """The rule of ``audit.first_part_positive`` on one answer."""
    return answer["c"] != "no" or any(answer[k] for k in "eauxdz") or answer["r"] != "none" or answer["q"] != "no"


ASSESSED = "assessment string, findings array<string>, total_chunks int, audited_chunks int, error string"


def assess_in_parts(rows: DataFrame, first: Call, more: Callable[[dict, str], dict], *, key: str = "id", chunks: str = "chunks", attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """key and the columns of ``ASSESSED`` for each conversation, given as an array of chunks.

    The first chunk is assessed alone.  Only if that is positive are the others, in order,
    each call seeing the assessment so far; what each finds (``f``) is kept.
    """
    begin, go_on = retried(first, attempts, pause), retried(more, attempts, pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, parts in zip(batch[key], batch[chunks], strict=True):
                try:
                    answer, findings, audited = begin(parts[0]), [], 1
                    if is_positive(answer):
                        for part in parts[1:]:
                            answer = go_on(answer, part)
                            findings.append(str(answer.pop("f", "")))
                            audited += 1
                    out.append((k, json.dumps(answer, ensure_ascii=False, separators=(",", ":")), findings, len(parts), audited, None))
                except Exception as error:  # the row goes to the error ledger
                    out.append((k, None, [], len(parts), 0, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[key, *(c.split()[0] for c in ASSESSED.split(", "))])

    return rows.select(key, chunks).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {ASSESSED}")


def screen_batches(batches: DataFrame, call: Callable[[list[str]], dict[int, dict]], *, key: str = "id", attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """key, c, r, q, error for the items (array<struct<key, text>>) of each batch.

    A batch is one call.  One that fails, or doesn't answer exactly its items, is tried again;
    when the attempts are used up its items are asked one by one, each with attempts of its own.
    An item that has no answer then is an error by itself.
    """

    def complete(texts: list[str]) -> list[dict]:
        found = call(texts)
        if found.keys() != set(range(len(texts))):
            raise ValueError(f"expected {len(texts)} answers, received {sorted(found)}")
        return [found[i] for i in range(len(texts))]

    ask = retried(complete, attempts, pause)

    def answers(texts: list[str]) -> list[tuple]:
        try:
            return [(a["c"], a["r"], a["q"], None) for a in ask(texts)]
        except Exception as error:
            if len(texts) > 1:
                return [answers([text])[0] for text in texts]
            return [(None, None, None, f"{type(error).__name__}: {error}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(i[key], *a) for items in frame["items"] for i, a in zip(items, answers([i["text"] for i in items]), strict=True)]
            yield pd.DataFrame(out, columns=[key, "c", "r", "q", "error"])

    kind = batches.schema["items"].dataType.elementType[key].dataType.simpleString()
    return batches.select("items").mapInPandas(run, f"`{key}` {kind}, c string, r string, q string, error string")


def faithful(sources: list[str], translations: list[str], *, least: int = 240, times: int = 7) -> bool:
    """As many translations as sources, none empty, none far longer than its source."""
    return len(sources) == len(translations) and all(t and len(t) <= max(least, times * len(s)) for s, t in zip(sources, translations, strict=True))


def faithful_answers(sources: Column, answers: Column, *, least: int = 240, times: int = 7) -> Column:
    """The rule of ``faithful`` on columns of stored texts; a null answer is empty."""
    said = lambda t, s: (F.length(F.coalesce(t, F.lit(""))) > 0) & (F.length(t) <= F.greatest(F.lit(least), times * F.length(s)))
    return (F.size(sources) == F.size(answers)) & F.forall(F.zip_with(sources, answers, lambda s, t: F.coalesce(said(t, s), F.lit(False))), lambda x: x)


def translate_batches(pieces: DataFrame, call: Callable[[list[str]], list[str]], *, key: str = "id", attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """key, message_index, part_index, translation, error for batched pieces (``translate.batched``): a batch is one call, an unfaithful answer is tried again."""

    def checked(texts: list[str]) -> list[str]:
        found = call(texts)
        if not faithful(texts, found):
            raise ValueError("unfaithful translation")
        return found

    ask = retried(checked, attempts, pause)
    place = F.struct("message_index", "part_index", "text")
    grouped = pieces.groupBy(key, "batch").agg(F.array_sort(F.collect_list(place)).alias("p"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, parts in zip(frame[key], frame["p"], strict=True):
                try:
                    found, error = ask([p["text"] for p in parts]), None
                except Exception as failure:
                    found, error = [None] * len(parts), f"{type(failure).__name__}: {failure}"
                out += [(k, p["message_index"], p["part_index"], t, error) for p, t in zip(parts, found, strict=True)]
            yield pd.DataFrame(out, columns=[key, "message_index", "part_index", "translation", "error"])

    kind = pieces.schema[key].dataType.simpleString()
    return grouped.mapInPandas(run, f"`{key}` {kind}, message_index int, part_index int, translation string, error string")


def summed_metrics(parts: DataFrame, key: str, *names: str) -> DataFrame:
    """Sums over the parts of each key; a missing number is 0, seconds are rounded half to even to a thousandth."""
    return parts.groupBy(key).agg(*(F.bround(F.sum(F.coalesce(n, F.lit(0))), 3).alias(n) for n in names))


def progress(rows: DataFrame, name: str = "progress") -> DataFrame:
    """``rows`` observed under ``name``: how many were processed and how many of these failed, for a listener to read."""
    return rows.observe(name, F.count(F.lit(1)).alias("processed"), F.count("error").alias("failed"))


def run_status(results: DataFrame, total: int, seconds: float) -> DataFrame:
    """One row for a run's report: processed, failed, total, and records per hour to a tenth (null without time)."""
    found = results.agg(F.count(F.lit(1)).alias("processed"), F.count("error").alias("failed"))
    rate = F.bround(F.col("processed") * 3600.0 / F.when(F.lit(float(seconds)) > 0, F.lit(float(seconds))), 1)
    return found.select("processed", "failed", F.lit(total).cast("long").alias("total"), rate.alias("per_hour"))
