"""Human decisions: validity, agreement with what is pending, and canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.text import turn_references
from skeinworks.operators.audit import CANDIDATES, STAGES, lookup

#: Level to (name, locus) in human records, which name the fourth locus differently; fixed values.
LEVELS = {
    0: ("instrumental_task", "none"),
    1: ("capability_extension", "capability"),
    2: ("project_possession_extension", "owned_project"),
    3: ("representational_extension", "self_representation"),
    4: ("reflexive_extension", "self_understanding"),
    5: ("enacted_extension", "possible_self_enactment"),
}
LABELS = ("clear", "potential", "none")


def valid_decision(label: Column, level: Column) -> Column:
    """Known label and level; clear needs level 3 or more, none needs 0, potential may have any."""
    known = label.isin(*LABELS) & level.between(0, 5)
    return F.coalesce(known & ((label != "clear") | (level >= 3)) & ((label != "none") | (level == 0)), F.lit(False))


def decision_problems(decisions: DataFrame, waiting: DataFrame, canonical: DataFrame, *, key: str = "conversation_id") -> DataFrame:
    """(key, problem) for decisions without a pending case, pending cases without a decision, repeats,
    cases that are decided already, and invalid labels.  Empty when all is well."""
    ids = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    expected = waiting.select(F.col(key), F.lit(True).alias("wanted")).distinct()
    both = ids.join(expected, key, "full_outer")
    one = both.where("wanted IS NULL").select(key, F.lit("unexpected").alias("problem"))
    two = both.where("n IS NULL").select(key, F.lit("missing").alias("problem"))
    three = ids.where("n > 1").select(key, F.lit("repeated").alias("problem"))
    four = ids.join(canonical.select(key).distinct(), key).select(key, F.lit("decided already").alias("problem"))
    five = decisions.where(~valid_decision(F.col("label"), F.col("level"))).select(key, F.lit("invalid").alias("problem"))
    return one.union(two).union(three).union(four).union(five)


def require_empty(problems: DataFrame, what: str) -> None:
    """Raise if there is any row."""
    if found := problems.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def shared_ids(ledgers: dict[str, DataFrame], *, key: str = "conversation_id") -> DataFrame:
    """Ids that stand in more than one ledger, or more than once in one."""
    all_ids = None
    for name, ledger in ledgers.items():
        part = ledger.select(key, F.lit(name).alias("ledger"))
        all_ids = part if all_ids is None else all_ids.union(part)
    return all_ids.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("ledger")).alias("ledgers")).where("n > 1")


def checked(rows: DataFrame, bad: Column, said: Column) -> DataFrame:
    """``rows``; one that is ``bad`` is an error that says so, raised where the rows are computed, in the same plan."""
    return rows.where(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def require_unique(rows: DataFrame, what: str, *, key: str = "id") -> DataFrame:
    """``rows``; a key in more than one of them is an error."""
    counted = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return checked(counted, F.col("__n") > 1, F.concat(F.lit(f"{what}: repeated "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).drop("__n")


def manual_candidates(manual: DataFrame, audited: DataFrame, *, key: str = "id", ledger: str | None = None) -> DataFrame:
    """Manual records of automated candidates only; calibration cases go.

    A candidate reviewed twice is an error; with ``ledger``, the column that names the ledger
    of a record, so is a label (``label``) that differs from it.
    """
    candidates = audited.where(F.col("label").isin(*CANDIDATES)).select(key).distinct()
    found = require_unique(manual.join(candidates, key, "left_semi"), "manual reviews of candidates", key=key)
    if ledger:
        found = checked(found, ~F.col("label").eqNullSafe(F.col(ledger)), F.concat(F.lit("label in another ledger: "), F.col(key).cast("string")))
    return found


#: What a label's assessment concludes, what holds for every case, and what every record notes; fixed values.
CONCLUSIONS = {
    "clear": "Four distinct and chronologically ordered stages survive within one coherent process.",
    "potential": "The case is lower-level or has an incomplete higher-level chain and therefore does not meet the precision threshold for clear.",
    "none": "The apparent process is impersonal, fictional, fragmented, or otherwise lacks defensible evidence of extension beyond L0.",
}
REASONS = (
    "The complete normalized conversation was reviewed as one individual unit, including all topic segments.",
    "The strongest coherent process was distinguished from unrelated later topics and from mere artifact iteration.",
)
EVIDENCE = "Complete source conversation reviewed; turn references are retained without unnecessarily duplicating sensitive transcript text."
BOUNDARY = "Frozen-boundary one-by-one full-conversation adjudication at automated cutoff %d; manual classification overrides the automated label for substantive reporting."
COMMENTS = (
    "Occupational, educational, entrepreneurial, creative, relational, personal, and health AI use was treated as consumption rather than excluded by domain.",
    "The full transcript remains in the normalized corpus; sensitive text is not unnecessarily duplicated here.",
)


def canonicalize(decisions: DataFrame, audited: DataFrame, cutoff: int, *, key: str = "conversation_id", corpus_file: str = "", audit_file: str = "") -> DataFrame:
    """Decisions (label, level, context, confidence, summary, boundary, evidence per stage) joined with their audit rows, as canonical records that name the files and the line they refer to."""
    source = audited.select(F.col("id").alias(key), "dataset", "source_id", F.col("label").alias("automated_label"), F.col("level").alias("automated_level"), "audit_line")
    rows = decisions.join(source, key)
    names, loci = {k: v[0] for k, v in LEVELS.items()}, {k: v[1] for k, v in LEVELS.items()}
    conclusion = F.coalesce(lookup(CONCLUSIONS, F.col("label")), F.lit(CONCLUSIONS["none"]))
    return rows.select(
        key, "dataset", "source_id", "automated_label", "automated_level", "audit_line", F.lit(corpus_file).alias("corpus_file"), F.lit(audit_file).alias("audit_file"),
        F.col("label").alias("manual_label"), F.lit(cutoff).alias("cutoff"), F.lit(True).alias("consumption_related"), "context", "level",
        lookup(names, F.col("level")).alias("level_name"), lookup(loci, F.col("level")).alias("locus"),
        F.when((F.col("label") == "clear") | (F.col("level") >= 3), "high").otherwise("medium").alias("priority"),
        F.when(F.col("confidence") == "medium", "moderate").otherwise(F.col("confidence")).alias("confidence"),
        "summary", "boundary",
        *(F.struct(turn_references(F.col(s)).alias("turn"), F.lit(EVIDENCE).alias("evidence"), F.col(s).alias("interpretation")).alias(s) for s in STAGES),
        F.array(*(F.lit(x) for x in REASONS), conclusion).alias("reasons"),
        F.array(F.lit(BOUNDARY % cutoff), *(F.lit(x) for x in COMMENTS), F.col("boundary")).alias("comments"),
    )


def evidence_sequence(turns: dict[str, Column]) -> Column:
    """``stage turn; stage turn`` without the empty ones."""
    return F.concat_ws("; ", *(F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit(f"{name} "), t)) for name, t in turns.items()))
