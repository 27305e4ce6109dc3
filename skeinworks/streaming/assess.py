"""Assessing conversations in parts with state: what a model has answered so far survives failures, and waits are timers, not sleeping tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skeinworks.operators.inference import is_positive

#: The state store that keeps states and timers of many keys; a batch writes what it has changed, not the store's files.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: What is known of a conversation that isn't done: its parts, the assessment so far, findings, the next part, and failures of that part.
_TEXTS = T.ArrayType(T.StringType())
SO_FAR = T.StructType([T.StructField(name, kind) for name, kind in (("chunks", _TEXTS), ("assessment", T.StringType()), ("findings", _TEXTS), ("next", T.IntegerType()), ("failures", T.IntegerType()))])
ASSESSED = "assessment string, findings array<string>, total_chunks int, audited_chunks int, error string"


class InParts(StatefulProcessor):
    """The first part alone; only if that is positive the others in order, each on top of the assessment so far.

    A part that fails is tried again when its pause is over, from the state as it is then: parts that have been answered are
    not asked again.  Pauses double; when the attempts at a part are used up, the conversation becomes an error.
    """

    def __init__(self, key: T.StructField, first: Callable[[str], dict], more: Callable[[dict, str], dict], attempts: int, pause: float):
        self.key, self.first, self.more, self.attempts, self.pause = key, first, more, attempts, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.so_far = handle.getValueState("so_far", SO_FAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for chunks in part["chunks"]:
                if not self.so_far.exists():  # a conversation at work isn't begun again
                    yield from self._go_on(key, timerValues, (chunks, None, [], 0, 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.so_far.exists():
            yield from self._go_on(key, timerValues, self.so_far.get())

    def close(self) -> None:
        pass

    def _go_on(self, key, timers, so_far: tuple) -> Iterator[pd.DataFrame]:
        chunks, assessment, findings, at, failures = so_far
        chunks, findings, answer = list(chunks), list(findings), json.loads(assessment) if assessment else None
        text = lambda: None if answer is None else json.dumps(answer, ensure_ascii=False, separators=(",", ":"))
        while at < len(chunks) and (at == 0 or is_positive(answer) or at > 1):
            try:
                answer = self.first(chunks[0]) if at == 0 else self.more(dict(answer), chunks[at])
            except Exception as error:
                failures += 1
                if failures < self.attempts:
                    self.so_far.update((chunks, text(), findings, at, failures))
                    self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.pause * 2 ** (failures - 1) * 1000))
                    return
                yield self._done(key, None, [], len(chunks), 0, f"{type(error).__name__}: {error}")
                return
            if at:
                findings.append(str(answer.pop("f", "")))
            at, failures = at + 1, 0
        yield self._done(key, text(), findings, len(chunks), at, None)

    def _done(self, key, *values) -> pd.DataFrame:
        self.so_far.clear()
        return pd.DataFrame([(key[0], *values)], columns=[self.key.name, *(c.split()[0] for c in ASSESSED.split(", "))])


def assess_in_parts(stream: DataFrame, first: Callable[[str], dict], more: Callable[[dict, str], dict], *, key: str = "id", attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """key and the columns of ``ASSESSED`` for each conversation (``chunks``) of a stream, when it is done.

    The session needs the settings of ``STORE``.  Calls of a batch that fails as a whole are made again, as a stream gives
    its results, not its calls, exactly once.
    """
    field = stream.schema[key]
    shape = T.StructType([field, *T.StructType.fromDDL(ASSESSED)])
    processor = InParts(field, first, more, attempts, pause)
    return stream.select(key, "chunks").groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=shape, outputMode="append", timeMode="ProcessingTime")


def run_until_idle(assessed: DataFrame, ledger: str, checkpoint: str, *, every: float = 1.0) -> None:
    """Batches ``every`` so many seconds until all that has arrived is done; what is done is appended to the ledger, a part for each batch.

    A stream with timers always has a next batch, so it is stopped when one had no rows and left no conversation at work.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{ledger}/batch={number}")

    query = assessed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(every * 1000)} milliseconds").start()
    try:
        while not (idle := query.awaitTermination(every)):
            last = query.lastProgress
            idle = last is not None and not last["numInputRows"] and bool(last["stateOperators"]) and not sum(o["numRowsTotal"] for o in last["stateOperators"])
            if idle:
                break
    finally:
        query.stop()
