"""A training corpus from the table ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each to the shared
folder and reads it again as the documents of the next.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import bpe, linededup, mixing, quality, similar, simhash
from skeinworks.llm.common import deleted, fresh_path, intermediates, key_crc, table, written

#: Score from which a document is kept.
LEAST_SCORE = 0.5
#: Share of its characters in lines that begin as lines of other texts do, above which a document is a copy, which the next stage takes as a whole.
MOST_SHARED = 0.75
#: Candidates for near copies: groups linked by fingerprints of distinct words that differ in at most 8 bits, none missed.
NEAR_COPIES = {"shingle": 1, "repeats": False, "bits": 8}
#: A near copy: its five-word shingles have this similarity, or more, to those of a document that is kept.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8
#: Pre-tokens that a worker remembers: workers outlive a stage, and the next one needs the memory.
CACHE_ENTRIES = 100_000
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _stored(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written; whatever its operators have written for themselves goes at once, and Spark's cleaner is called for the shuffles that nothing needs any more."""
    path = fresh_path(spark, what)
    with intermediates(spark):
        found = make()
        schema = found.schema
        found.write.parquet(path)
    del found
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def own_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage``, whose own columns begin with two underscores: columns of the caller's that do are renamed while it runs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"kept{c}" for c in docs.columns if c.startswith("__")}
        return stage(spark, docs.withColumnsRenamed(names), sf_dir).withColumnsRenamed({v: k for k, v in names.items()})

    return run


@own_names
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on two thirds of the labels, doesn't reject.

    A null or empty text is judged as empty texts were labelled.  Repeated rows are judged alike, ids
    don't count; without any label nothing is rejected.  An empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels").where(key_crc() % 3 != 1)
    model = quality.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return quality.scored(docs, model, out="__score", keep_text=True).where(F.col("__score") >= LEAST_SCORE).select(docs.columns)


@own_names
def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of an earlier text that recur, long ones from the second text on; ``n_chars`` follows.

    Copies of a text are one document, and copies with edits, three quarters of which begin as other texts' lines do, stay whole.  Null texts
    stay null, empty ones empty; repeated rows agree; an empty table gives an empty one.
    """
    gone = _stored(spark, "gone", lambda: linededup.drops(docs, by_text=True, most_shared=MOST_SHARED))
    kept = linededup.without_templates(docs, gone=gone)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@own_names
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies: of each group of candidates those that are not similar to one that stays, by id, the smallest first.

    Groups are linked by fingerprints; what stays of them is then compared over all, so pairs whose fingerprints lie too far
    apart are found as well, and of those the later document goes, too.

    Rows that agree in id and text are one: of those the one whose other columns come first by a hash,
    and of wholly equal rows one.  Rows without an id come last in their group, so copies of
    documents with one go; among themselves they are candidates if their groups have no id.  Null and
    empty texts, and such without words, are alike.  An empty table gives an empty one.
    """
    marked = docs.withColumns({"__mark": F.xxhash64("text"), "__row": F.xxhash64(*(f"`{c}`" for c in docs.columns))})
    found = _stored(spark, "candidates", lambda: simhash.near_duplicates(marked.select("doc_id", "text", "__mark", "__row"), keep=("__mark", "__row"), **NEAR_COPIES))
    # A row for each text of a group, with the smallest id that has it
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    texts = found.groupBy(F.col("component_id").alias("__group"), F.col("__mark").alias("__own")).agg(F.min(ids).alias("first"))
    texts = written(texts.select("__group", "__own", F.col("first.id").alias("__id"), F.col("first.row").alias("__first")), "texts")
    several = texts.groupBy(F.col("__group").alias("__several")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__several")
    grouped = texts.join(several, F.col("__group").eqNullSafe(F.col("__several"))).drop("__several")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__mark").eqNullSafe(F.col("__own")) & (F.col("__row") == F.col("__first"))
    place = [F.col("__id").isNull(), F.col("__id"), F.col("__own")]

    def sifted() -> DataFrame:
        whole = marked.join(grouped, same).groupBy("__group", "__id", "__own", "__first").agg(F.min("text").alias("text"))
        kept = simhash.unlike(whole, group="__group", order=place, words=SHINGLE_WORDS, least=LEAST_SIMILARITY).select("__id", "__own", "__first")
        alone = texts.join(several, F.col("__group").eqNullSafe(F.col("__several")), "left_anti").select("__id", "__own", "__first")
        return kept.unionByName(alone)

    kept = _stored(spark, "kept", sifted)
    stay = _stored(spark, "stay", lambda: marked.join(kept, same, "left_semi"))
    links = _stored(spark, "links", lambda: similar.pairs(stay, node="__mark", words=SHINGLE_WORDS, least=LEAST_SIMILARITY))
    gone = similar.later_of(links, kept.withColumnRenamed("__own", "node"), F.struct(F.col("__id").isNull(), F.col("__id"), F.col("node")))
    stay = stay.join(gone, stay["__mark"] == gone["node"], "left_anti")
    # Wholly equal rows are few: only these meet
    repeated = found.groupBy(F.col("doc_id").alias("__id"), F.col("__row").alias("__first")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id", "__first")
    again = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__first"))
    once = stay.join(repeated, again, "left_anti").select(docs.columns)
    return once.unionByName(stay.join(repeated, again, "left_semi").select(docs.columns).dropDuplicates())


@own_names
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, to the nearest whole time: up to three rows, or none, each in the place of the slot that takes it, so that sources alternate.

    Rows that share an id (null ids, too) are taken as often as their words together are.  Documents without
    words go; null sources are a source.  An empty table gives an empty one.
    """
    slots = F.array(*(F.min(F.get("slots", F.lit(e))) for e in range(mixing.MOST_EPOCHS)))
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), slots.alias("__slots"))
    times = taken.select("__id", "__slots", F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias("times")).where("times > 0")
    both = docs.join(times, F.col("doc_id").eqNullSafe(F.col("__id"))).select("*", F.posexplode(F.slice("__slots", F.lit(1), F.col("times"))).alias("__time", "__slot"))
    parts = docs.rdd.getNumPartitions()
    return both.repartitionByRange(parts, "__slot").sortWithinPartitions("__slot").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, and whether decoding gives the text again; a row for each row.  A null or empty text has no ids, and an empty table gives an empty one."""
    ids = bpe.encode(docs.select("doc_id", "source", "text"), ranks_path=RANKS, pattern=PATTERN, cache_entries=CACHE_ENTRIES)
    marked = ids.select("doc_id", "source", "token_ids", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    both = bpe.decode(marked, ranks_path=RANKS)
    return both.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.sha2("decoded", 256) == F.col("sha")).alias("exact"))


STAGES = [
    ("quality", good_documents),
    ("line dedup", without_templates),
    ("near dedup", one_of_each),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

#: SQL can't express the stages that learn and the tokenizer: tests/llm checks them one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage.  What a stage and its operators have written for themselves is deleted when the next one's input is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with intermediates(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
