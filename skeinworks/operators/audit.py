"""Scheduling conversations for assessment, and turning raw assessments into checked labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.messages import turn_labels

#: Names of the levels, and the level of each locus; fixed values.
LEVEL_NAMES = {0: "instrumental_task", 1: "capability_extension", 2: "project_possession_extension", 3: "representational_extension", 4: "reflexive_extension", 5: "enacted_extension"}
LOCUS_LEVELS = {"none": 0, "capability": 1, "owned_project": 2, "self_representation": 3, "self_assessment": 4, "possible_self_enactment": 5}
STAGES = ("externalization", "ai_reflection", "user_uptake", "recursive_reentry")
CANDIDATES = ("clear", "potential")


def lookup(table: dict, value: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


# ---- what to assess, in what order ----


def pending(corpus: DataFrame, done: DataFrame, *, key: str = "id", only: Sequence[str] = ()) -> DataFrame:
    """The records that aren't done; with ``only``, of these ids."""
    rows = corpus.where(F.col(key).isin(*only)) if only else corpus
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def wanted(corpus: DataFrame, ids: DataFrame, *, key: str = "id") -> DataFrame:
    """The records of the given ids; an id that the corpus lacks is an error, raised where the records are computed."""
    found = ids.select(key).distinct().join(corpus.withColumn("__has", F.lit(True)), key, "left")
    lacking = F.when(F.col("__has").isNull(), F.raise_error(F.concat(F.lit("missing conversation: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
    return found.where(lacking).select(corpus.columns)


def schedule(rows: DataFrame, policy: str = "length", *, limit: int = 0, source_order: str = "position") -> DataFrame:
    """The records in working order: longest first (ties by dataset and id), or as the source has them.

    A limit takes the first of the source before any sorting; 0 means all.
    """
    if policy not in ("length", "source"):
        raise ValueError(f"unknown schedule: {policy}")
    if limit:
        rows = rows.orderBy(source_order).limit(limit)
    return rows.orderBy(source_order) if policy == "source" else rows.orderBy(F.coalesce("characters", F.lit(0)).desc(), "dataset", "id")


def longest_first_rank(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, the place (from 1) in longest-first order, without sorting them all in one task:
    the rows before a length come from a count of each length, and ties are ranked inside it."""
    sized = rows.withColumn("__n", F.coalesce("characters", F.lit(0)).cast("long"))
    before = F.sum("n").over(Window.orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1))
    lengths = sized.groupBy("__n").agg(F.count(F.lit(1)).alias("n")).select("__n", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__n").orderBy("dataset", "id"))
    return sized.withColumn("__inside", inside).join(lengths, "__n").withColumn("rank", F.col("__before") + F.col("__inside")).drop("__n", "__inside", "__before")


def pending_stats(rows: DataFrame, characters: str = "characters") -> DataFrame:
    """One row: the number of records and the least, median (half to even) and most characters; 0 without any."""
    n = F.coalesce(characters, F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("records"), zero(F.min(n)).alias("min"), zero(F.bround(F.median(n))).alias("median"), zero(F.max(n)).alias("max"))


def assess(chunks: DataFrame, classifier: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run a classifier over chunk rows in batches; the model itself lies outside of this library."""
    return chunks.mapInPandas(classifier, schema)


# ---- the normalizer ----


def first_part_positive(c: Column, stages: Sequence[Column], z: Column, r: Column, q: Column) -> Column:
    """Whether the later parts of a conversation are worth assessing."""
    any_stage = F.lit(False)
    for s in stages:
        any_stage = any_stage | s
    return (c != "no") | any_stage | z | (r != "none") | (q != "no")


def normalize(assessments: DataFrame) -> DataFrame:
    """Labels from raw assessments (columns h, e, a, u, x, d, z, he, ae, ue, xe, g, r, q, c) and ``messages``.

    A stage counts only if the one before does, the model affirms it, and its evidence names a
    turn that exists.  Adds ``level``, ``level_name``, ``locus``, a boolean for each stage,
    ``delegation``, ``artifact_recursion``, evidence columns ``ev_*`` (null unless the stage
    holds), ``clear_chain``, ``label``, ``review``, ``adjusted`` and ``positive``.
    """
    labels = turn_labels(F.col("messages"))
    rows = assessments.withColumn("__turns", labels)
    places = {k: F.array_position("__turns", F.col(k)) for k in ("he", "ae", "ue", "xe")}
    valid = {k: F.coalesce(F.col(k).rlike(rf"^{'A' if k == 'ae' else 'U'}[1-9][0-9]*\z") & (p > 0), F.lit(False)) for k, p in places.items()}
    true = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumn("externalization", true((F.col("h") == "strong") & F.col("e")) & valid["he"])
    for stage, before, flag, evidence in (("ai_reflection", "externalization", "a", "ae"), ("user_uptake", "ai_reflection", "u", "ue"), ("recursive_reentry", "user_uptake", "x", "xe")):
        rows = rows.withColumn(stage, F.col(before) & true(F.col(flag)) & valid[evidence])
    level = F.when(F.col("externalization"), F.coalesce(lookup(LOCUS_LEVELS, F.col("g")), F.lit(0))).otherwise(0)
    rows = rows.withColumns({"delegation": F.col("externalization") & true(F.col("d")), "artifact_recursion": true(F.col("z")), "level": level})
    ascending = (places["he"] < places["ae"]) & (places["ae"] < places["ue"]) & (places["ue"] < places["xe"])
    clear = (F.col("level") >= 3) & F.col("recursive_reentry") & true(ascending)
    potential = (F.col("level") >= 1) & (F.col("ai_reflection") | F.col("delegation") | true(F.col("r") == "potential"))
    rows = rows.withColumn("label", F.when(clear, "clear").when(potential, "potential").otherwise("none"))
    rows = rows.withColumn("review", F.when((F.col("label") != "none") & (F.col("q") == "no"), "maybe").otherwise(F.col("q")))
    found = {f"ev_{s}": F.when(F.col(s), F.col(k)) for s, k in zip(STAGES, ("he", "ae", "ue", "xe"), strict=True)}
    return rows.withColumns(
        {
            "level_name": lookup(LEVEL_NAMES, F.col("level")),
            "locus": F.when(F.col("level") > 0, F.col("g")).otherwise("none"),
            "adjusted": ~F.col("label").eqNullSafe(F.col("r")) | ~F.col("review").eqNullSafe(F.col("q")),
            "clear_chain": F.when(F.col("label") == "clear", F.array("he", "ae", "ue", "xe")).otherwise(F.array().cast("array<string>")),
            "positive": first_part_positive(F.col("c"), [F.col(k) for k in "eauxd"], F.col("z"), F.col("r"), F.col("q")),
            **found,
        }
    ).drop("__turns")
