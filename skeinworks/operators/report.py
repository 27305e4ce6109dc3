"""Counts for reports: labels, levels, and the funnel from raw rows to reviewed cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.operators.audit import CANDIDATES, LEVEL_NAMES
from skeinworks.operators.review import require_unique


def label_levels(rows: DataFrame, label: str = "label", level: str = "level") -> DataFrame:
    """Counts by label and level, by label (level null), and in all."""
    return rows.rollup(label, level).agg(F.count(F.lit(1)).alias("n"))


def level_counts(rows: DataFrame, level: str = "level") -> DataFrame:
    """All levels with their names and counts, 0 where there are none."""
    names = F.explode(F.create_map(*(F.lit(x) for pair in LEVEL_NAMES.items() for x in pair))).alias("level", "level_name")
    every = rows.sparkSession.range(1).select(names)
    found = rows.groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "level", "left").select("level", "level_name", F.coalesce("n", F.lit(0)).alias("n"))


def cut_off(audited: DataFrame, cutoff: int | None, line: str = "audit_line") -> DataFrame:
    """The first ``cutoff`` lines of a ledger; more than it has is an error."""
    if cutoff is None:
        return audited
    if cutoff < 0:
        raise ValueError("the cutoff is negative")
    if cutoff > (n := audited.count()):
        raise ValueError(f"the cutoff {cutoff} exceeds {n} rows")
    return audited.where(F.col(line) < cutoff)


def funnel(raw: DataFrame, corpus: DataFrame, audited: DataFrame, reviewed: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row for each dataset of ``raw`` (dataset, rows): raw, included, excluded, audited, not audited, labels, candidates, reviewed and pending.

    Missing counts are 0; a negative difference is an error.
    """
    included = corpus.groupBy("dataset").agg(F.count(F.lit(1)).alias("included"))
    labels = audited.groupBy("dataset").agg(F.count(F.lit(1)).alias("audited"), *(F.count_if(F.col("label") == x).alias(x) for x in ("none", "potential", "clear")))
    seen = reviewed.select("id").distinct().join(audited.where(F.col("label").isin(*CANDIDATES)).select("id", "dataset"), "id").groupBy("dataset").agg(F.count(F.lit(1)).alias("reviewed"))
    rows = raw.select("dataset", F.col("rows").alias("raw")).join(included, "dataset", "left").join(labels, "dataset", "left").join(seen, "dataset", "left")
    if errors is not None:
        rows = rows.join(errors.groupBy("dataset").agg(F.count(F.lit(1)).alias("errors")), "dataset", "left")
    rows = rows.fillna(0)
    positive = lambda c, what: F.when(c >= 0, c).otherwise(F.raise_error(F.concat(F.lit(f"negative {what}: "), F.col("dataset"))))
    return rows.withColumns(
        {
            "excluded": positive(F.col("raw") - F.col("included"), "excluded"),
            "not_audited": positive(F.col("included") - F.col("audited"), "not audited"),
            "candidates": F.col("potential") + F.col("clear"),
            "pending": F.col("potential") + F.col("clear") - F.col("reviewed"),
        }
    )


def campaign_state(corpus: DataFrame, audited: DataFrame, errors: DataFrame, manual: DataFrame, *, sources: int = 0, by: str | None = None, cutoff: int | None = None) -> DataFrame:
    """How far a campaign is: totals, labels and levels (maps) by machine and by hand; one row, or one for each value of the column ``by`` that all four have.

    ``audited`` has id, label, level; ``manual`` conversation_id, label, level, of which only
    the machine's candidates count.  Repeated ids in either are an error.  With ``cutoff`` only the first so many lines of the machine's ledger (``audit_line``, from 0) count.
    ``sources`` is how many records the sources had, for the report to show.

    All four are counted together: a row for each combination of kind, label and level, of which the maps are made.
    """
    seen = require_unique(audited if cutoff is None else audited.where(F.col("audit_line") < cutoff), "audited records")
    known = seen.where(F.col("label").isin(*CANDIDATES)).select(F.col("id").alias("conversation_id"))
    hand = require_unique(manual, "manual records", key="conversation_id").join(known, "conversation_id", "left_semi")
    group = [by] if by else []
    thin = lambda rows, kind, graded=False: rows.select(*group, F.lit(kind).alias("kind"), *((F.col(c).cast("string") if graded else F.lit(None).cast("string")).alias(c) for c in ("label", "level")))
    every = thin(corpus, "corpus").unionByName(thin(seen, "automated", True)).unionByName(thin(errors, "errors")).unionByName(thin(hand, "manual", True))
    counts = every.groupBy(*group, "kind", "label", "level").agg(F.count(F.lit(1)).alias("n"))
    of = counts.groupBy(*group).agg(F.collect_list(F.struct("kind", "label", "level", "n")).alias("c"))
    total = lambda test: F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda s, x: s + x["n"])

    def mapped(test, value: str, kind: str) -> Column:
        names = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter("c", test), lambda x: x[value].cast(kind)), lambda x: x.isNotNull())))
        return F.map_from_arrays(names, F.transform(names, lambda k: total(lambda x: test(x) & (x[value].cast(kind) == k))))

    auto, by_hand = (lambda x: x["kind"] == "automated"), (lambda x: x["kind"] == "manual")
    found = of.select(
        *group, F.lit(sources).cast("long").alias("source_total"), total(lambda x: x["kind"] == "corpus").alias("corpus_total"), total(auto).alias("automated_total"), total(lambda x: x["kind"] == "errors").alias("automated_errors"),
        total(lambda x: auto(x) & x["label"].isin(*CANDIDATES)).alias("automated_candidates"), mapped(auto, "label", "string").alias("automated_labels"), mapped(auto, "level", "long").alias("automated_levels"),
        total(by_hand).alias("manual_total"), mapped(by_hand, "label", "string").alias("manual_labels"), mapped(by_hand, "level", "long").alias("manual_levels"), mapped(lambda x: by_hand(x) & (x["label"] == "clear"), "level", "long").alias("clear_levels"),
    )
    return found.withColumn("manual_pending", F.col("automated_candidates") - F.col("manual_total"))


def in_dataset_order(rows: DataFrame, names: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """``rows`` with ``place``, the dataset's in ``names`` (from 0; others come last), to sort reports by."""
    return rows.withColumn("place", F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(n) for n in names)), F.col(dataset)), F.lit(0)) - 1, F.lit(len(names))).cast("int"))


#: What a funnel counts.
COUNTS = ("raw", "excluded", "included", "audited", "not_audited", "none", "potential", "clear", "candidates", "reviewed", "pending")
#: What follows in the chart, and what leaves it.
DOWN = (("raw", "included"), ("included", "audited"), ("audited", "quiet"), ("audited", "candidates"), ("candidates", "reviewed"), ("reviewed", "clear"), ("reviewed", "potential"), ("reviewed", "none"))
ASIDE = (("raw", "excluded"), ("included", "waiting"), ("candidates", "pending"))


def flow_lines(funnel_rows: DataFrame, outcomes: DataFrame, *, errors: int = 0, names: Sequence[str] = ()) -> DataFrame:
    """place (from 0), line: a Mermaid flow chart of a funnel (a row for each dataset) and the manual outcomes (label, level, n; ``label_levels`` will do).

    Steps go down, what leaves the flow goes aside; datasets are listed in the order of ``names``, then by name.  The
    one row that the lines are made of holds a struct for each dataset, and one for each label and level.
    """
    listed = F.array_sort(F.collect_list(F.struct("place", "dataset", *COUNTS)))
    rows = in_dataset_order(funnel_rows, names).agg(listed.alias("listed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))
    known = outcomes.where("label IS NOT NULL AND level IS NOT NULL").agg(F.collect_list(F.struct("label", "level", "n")).alias("outcomes"))
    number = lambda c: F.format_number(c, 0)
    said = lambda name, parts: F.concat(F.lit(f'  {name}["'), F.concat_ws("<br/>", *parts), F.lit('"]'))
    entry = lambda name, n: F.concat(F.lit(f"{name}: "), number(n))

    def box(name: str, head: str, column: str, *, by_source: bool = False, omit_zero: bool = True, more: Sequence[Column] = ()) -> Column:
        some = F.filter("listed", lambda r: r[column] != 0) if omit_zero else F.col("listed")
        each = F.transform(some, lambda r: F.concat(r["dataset"], F.lit(": "), number(r[column])))
        return said(name, [F.lit(head), F.concat(F.lit("n = "), number(F.col(column))), *([each] if by_source else []), *more])

    def outcome(label: str, levels: Sequence[int]) -> Column:
        count = lambda test: F.aggregate(F.filter("outcomes", lambda x: (x["label"] == label) & test(x)), F.lit(0).cast("long"), lambda n, x: n + x["n"])
        each = [entry(f"level {k}", count(lambda x, k=k: x["level"] == k)) for k in levels]
        return said(label, [F.lit(f"outcome {label}"), F.concat(F.lit("n = "), number(count(lambda x: F.lit(True)))), *each])

    boxes = [
        box("raw", "records collected", "raw", by_source=True, omit_zero=False), box("excluded", "too short or repeated", "excluded"), box("included", "corpus", "included", by_source=True, omit_zero=False),
        box("audited", "assessed", "audited", by_source=True, more=[F.lit(f"errors: {errors:,}")]), box("waiting", "not assessed", "not_audited", by_source=True), box("quiet", "no sign", "none"),
        box("candidates", "candidates", "candidates", more=[entry("potential", F.col("potential")), entry("clear", F.col("clear"))]), box("reviewed", "reviewed by hand", "reviewed"), box("pending", "not reviewed", "pending"),
        outcome("clear", (3, 4, 5)), outcome("potential", (1, 2, 3, 4, 5)), outcome("none", (0,)),
    ]
    arrows = [F.lit(f"  {a} --> {b}") for a, b in DOWN] + [F.lit(f"  {a} -.-> {b}") for a, b in ASIDE]
    return rows.join(known).select(F.posexplode(F.array(F.lit("flowchart TB"), *boxes, *arrows)).alias("place", "line"))
