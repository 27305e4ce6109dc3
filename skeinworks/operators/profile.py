"""Distributions of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.messages import ASSISTANT, USER, alternates, role_count
from skeinworks.sources.inventory import require_shards


def turn_histogram(rows: DataFrame, turns: str) -> DataFrame:
    """n_turns, conversations; null turns don't count."""
    return rows.where(F.col(turns).isNotNull()).groupBy(F.col(turns).cast("long").alias("n_turns")).agg(F.count(F.lit(1)).alias("conversations"))


def sharded_histogram(spark: SparkSession, path: str, *, shards: int, turns: str = "turn") -> DataFrame:
    """``turn_histogram`` of a parquet release that must have so many shards; only the column of turns is read."""
    return turn_histogram(require_shards(spark.read.parquet(path).select(turns), shards), turns)


def turn_summary(rows: DataFrame, turns: str) -> DataFrame:
    """One row: totals, extremes, mean, nearest-rank quantiles, and shares (null without rows)."""
    n = F.col(turns).cast("long")
    total = F.count(n)
    share = lambda test: (F.count_if(test) / F.when(total > 0, total)).alias
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CAST(`{turns}` AS BIGINT))")
    return rows.agg(
        total.alias("total"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"),
        rank(0.5).alias("median"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
        F.count_if(n == 1).alias("one_turn"), F.count_if(n >= 5).alias("five_plus"), F.count_if(n >= 10).alias("ten_plus"), F.count_if(n == 0).alias("zero_turn"),
        share(n == 1)("one_turn_share"), share(n >= 5)("five_plus_share"), share(n >= 10)("ten_plus_share"),
    )


def dense_distribution(histogram: DataFrame) -> DataFrame:
    """n_turns from 1 to the largest, with 0 conversations where there are none, and the share of all (those with 0 turns included)."""
    bounds = histogram.agg(F.max("n_turns").alias("top"), F.sum("conversations").alias("total"))
    every = bounds.where("top >= 1").select("total", F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("n_turns"))
    found = every.join(histogram, "n_turns", "left")
    return found.select("n_turns", F.coalesce("conversations", F.lit(0)).alias("conversations"), (F.coalesce("conversations", F.lit(0)) / F.col("total")).alias("share"))


def validation(rows: DataFrame, turns: str) -> DataFrame:
    """One row: how many conversations disagree with their own turn count, have unequal roles, or don't alternate."""
    users, assistants = role_count(F.col("messages"), USER), role_count(F.col("messages"), ASSISTANT)
    return rows.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col(turns) != users).alias("turn_mismatch"),
        F.count_if(users != assistants).alias("role_mismatch"),
        F.count_if(~alternates(F.col("messages"))).alias("non_alternating"),
    )


def serialized_counts(rows: DataFrame, text: str, *, question: str = r"['\"]user_question['\"]\s*:", answer: str = r"['\"]AI_response['\"]\s*:") -> DataFrame:
    """``rows`` with the numbers of serialized question and answer keys in a cell."""
    return rows.withColumns({"questions": F.regexp_count(text, F.lit(question)).cast("long"), "answers": F.regexp_count(text, F.lit(answer)).cast("long")})


def key_mismatches(rows: DataFrame, turns: str, text: str, *, by: str) -> DataFrame:
    """by, checked, question_mismatch, answer_mismatch: how many cells of serialized pairs disagree with their number of turns."""
    counted = serialized_counts(rows, text)
    wrong = lambda c: F.count_if(~F.col(c).eqNullSafe(F.col(turns)))
    return counted.groupBy(by).agg(F.count(F.lit(1)).alias("checked"), wrong("questions").alias("question_mismatch"), wrong("answers").alias("answer_mismatch"))


def described(summary: DataFrame, validation: DataFrame, *, dataset: str, scope: str, status: str, source: str) -> DataFrame:
    """A row of the report: the numbers of ``turn_summary``, what they are of, and the counts of a one-row ``validation`` as a map."""
    checks = F.map_from_arrays(F.array(*(F.lit(c) for c in validation.columns)), F.array(*(F.col(c).cast("long") for c in validation.columns)))
    named = {"dataset": dataset, "scope": scope, "status": status, "source": source}
    return summary.join(validation.select(checks.alias("validation"))).select(*(F.lit(v).alias(k) for k, v in named.items()), *summary.columns, "validation")
