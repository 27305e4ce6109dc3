"""Assessing a growing corpus: a stream that takes each record once and appends to the ledger."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinworks.sources import ledger as ledgers


def new_records(spark: SparkSession, path: str, schema, *, key: str = "id", per_trigger: int = 64) -> DataFrame:
    """Records of JSON files as they arrive, repeats by ``key`` left out.

    Ids never expire, so the state grows with the distinct ids, as the ledger itself does.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path).dropDuplicates([key])


#: A row of a run's progress.
PROGRESS = "processed long, failed long, processed_so_far long, failed_so_far long, total long, seconds double, per_hour double"


def run_available(stream: DataFrame, assess: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str, *, progress: str | None = None, total: int | None = None, clock: Callable[[], float] = time.monotonic) -> StreamingQuery:
    """Assess what is there and stop.

    A batch that is tried again replaces its own part of the ledger: parts are named by the
    batch's number, so each record stands in the ledger once.

    With ``progress``, a folder, each batch leaves a row there (``PROGRESS``), under its number, too: how many records it processed and how many
    of these have an ``error``, as observed while they are written, so nothing is computed twice; the same of all batches so far; of how
    many in all; and its seconds and records per hour.
    """

    def write(batch: DataFrame, number: int) -> None:
        began, found, seen = clock(), assess(batch), Observation()
        if progress:
            error = F.col("error") if "error" in found.columns else F.lit(None)
            found = found.observe(seen, F.count(F.lit(1)).alias("processed"), F.count(error).alias("failed"))
        found.write.mode("overwrite").json(f"{ledger}/batch={number}")
        if progress:
            _note(batch.sparkSession, progress, number, seen.get, clock() - began, total)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _note(spark: SparkSession, path: str, number: int, seen: dict, seconds: float, total: int | None) -> None:
    before = [(r["processed"], r["failed"]) for r in read_progress(spark, path).where(F.col("batch") < number).collect()] if ledgers.exists(spark, path) else []  # a row for each batch
    so_far = [seen[name] + sum(r[k] for r in before) for k, name in enumerate(("processed", "failed"))]
    rate = round(seen["processed"] * 3600 / seconds, 1) if seconds > 0 else None
    row = (seen["processed"], seen["failed"], *so_far, total, float(seconds), rate)
    spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").json(f"{path}/batch={number}")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """batch and the columns of ``PROGRESS``."""
    return spark.read.schema(f"{PROGRESS}, batch long").json(path)
