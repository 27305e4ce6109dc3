"""The operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import ann, bpe, clusters, langid, lexical, licenses, linededup, media, mixing, pii, quality, simhash, warc
from skeinworks.llm.common import key_crc, spread, table

#: The vocabulary of the BPE query; any rank file and pattern can be given to the operator.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = key_crc() % 4 == 2
    model = langid.fit(docs.where(F.coalesce(~held_out, F.lit(True))))
    return langid.predict(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pii.counted(pii.find(docs, pii.fit(docs)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.digests(docs, ranks_path=RANKS, pattern=PATTERN)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linededup.without_templates(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels")
    held_out = key_crc() % 3 == 1
    model = quality.fit(docs, labels.where(~held_out))
    found = quality.scored(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.counted(licenses.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {"op1_media": op1_media, "op2_warc": op2_warc, "op3_langid": op3_langid, "op4_ann": op4_ann, "op5_pii": op5_pii, "op6_mixing": op6_mixing, "op7_simhash": op7_simhash, "op9_linededup": op9_linededup, "op10_quality": op10_quality, "op8_bpe": op8_bpe, "op11_clusters": op11_clusters, "op12_lexical": op12_lexical, "op13_licenses": op13_licenses}
ORACLES = {"op2_warc": warc.ORACLE, "op6_mixing": mixing.ORACLE, "op9_linededup": linededup.ORACLE, "op11_clusters": clusters.ORACLE, "op12_lexical": lexical.ORACLE, "op13_licenses": licenses.ORACLE}
