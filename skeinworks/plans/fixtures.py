"""Inputs that the queries derive from the driver's tables: a corpus, raw assessments, ledgers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.functions.messages import transcript_hash
from skeinworks.operators import translate
from skeinworks.operators.audit import normalize
from skeinworks.operators.corpus import conversations, records

DATASET = "conversations"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A path that nobody has used, in the folder that driver and executors share; sessions on one machine that name none get a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="skeinworks-")
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written and read back, so a plan that uses it often doesn't hold it often."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as records."""
    return records(conversations(table(spark, sf_dir, "conversations")), DATASET, F.col("conv_id"))


def controlled(rows: DataFrame) -> DataFrame:
    """``rows`` with control characters for each ``th`` of their messages, and for each ``en`` what looks like one escaped."""
    said = lambda text: F.replace(F.replace(text, F.lit("th"), F.lit("\x0b\x1f")), F.lit("en"), F.lit("\\u001F"))
    return rows.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), said(m["content"]).alias("content"))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts of one message, with dataset, source order and hash."""
    docs = table(spark, sf_dir, "documents")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content")))
    return docs.select("doc_id", F.col("source").alias("dataset"), F.length("text").cast("long").alias("characters"), transcript_hash(messages).alias("hash"), (F.col("doc_id") % 3 == 0).alias("is_base"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw assessments of all conversations, by rules on conv_id, with their messages."""
    c = F.col("conv_id")
    pick = lambda on, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (on + 1).cast("int"))
    third = F.expr("conv_id div 3") % 6
    rows = corpus(spark, sf_dir)
    return rows.withColumns(
        {
            "h": F.when(c % 5 == 0, "weak").when(c % 11 == 0, "absent").otherwise("strong"),
            "e": c % 7 != 0, "a": c % 4 != 1, "u": c % 9 != 2, "x": c % 6 != 3, "d": c % 8 == 0, "z": c % 2 == 0,
            "he": F.lit("U1"), "ae": F.when(c % 13 == 0, "U1").otherwise("A1"), "ue": F.lit("U2"), "xe": pick(c % 3, "U2", "U3", "U03"),
            "g": pick(third, "none", "capability", "owned_project", "self_representation", "self_assessment", "possible_self_enactment"),
            "r": F.when(c % 10 < 3, "clear").when(c % 10 < 6, "potential").otherwise("none"),
            "q": pick(c % 3, "yes", "maybe", "no"), "c": F.when(c % 17 == 0, "no").otherwise("yes"),
        }
    )


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(assessments(spark, sf_dir))


def reviewed(rows: DataFrame) -> DataFrame:
    """Human decisions on three quarters of the audited conversations, every tenth of them set to none."""
    set_back = F.col("conv_id") % 10 == 7
    return rows.where(F.col("conv_id") % 4 != 3).select("id", "conv_id", F.when(set_back, "none").otherwise(F.col("label")).alias("label"), F.when(set_back, 0).otherwise(F.col("level")).alias("level"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited candidates of the wanted levels, two thirds of them in German."""
    rows = audited(spark, sf_dir)
    talks = rows.select("id", "conv_id", "messages", F.when(F.col("conv_id") % 3 == 0, "English").otherwise("German").alias("language"))
    return translate.targets(talks, rows.where("label <> 'none'").select("id", "level"))


#: The same in SQL.
MESSAGES = """m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ord,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role IN ('user', 'assistant')),
lab AS (SELECT *, (CASE WHEN role = 'user' THEN 'U' ELSE 'A' END) || ord AS label FROM m),
conv AS (SELECT conv_id, count(*) FILTER (role = 'user') AS nu, count(*) FILTER (role = 'assistant') AS na, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS ch,
  sha256('[' || string_agg('{"role":"' || role || '","content":' || to_json(text) || '}', ',' ORDER BY turn) || ']') AS hash,
  substr(sha256('conversations' || chr(0) || conv_id::VARCHAR), 1, 24) AS id FROM m GROUP BY conv_id)"""

AUDITED = MESSAGES + """,
raw AS (SELECT conv_id, id, ch,
  CASE WHEN conv_id % 5 = 0 THEN 'weak' WHEN conv_id % 11 = 0 THEN 'absent' ELSE 'strong' END AS h,
  conv_id % 7 <> 0 AS e, conv_id % 4 <> 1 AS a, conv_id % 9 <> 2 AS u, conv_id % 6 <> 3 AS x, conv_id % 8 = 0 AS d, conv_id % 2 = 0 AS z,
  'U1' AS he, CASE WHEN conv_id % 13 = 0 THEN 'U1' ELSE 'A1' END AS ae, 'U2' AS ue, CASE conv_id % 3 WHEN 0 THEN 'U2' WHEN 1 THEN 'U3' ELSE 'U03' END AS xe,
  (['none', 'capability', 'owned_project', 'self_representation', 'self_assessment', 'possible_self_enactment'])[(conv_id // 3) % 6 + 1] AS g, (conv_id // 3) % 6 AS lvl,
  CASE WHEN conv_id % 10 < 3 THEN 'clear' WHEN conv_id % 10 < 6 THEN 'potential' ELSE 'none' END AS r,
  CASE conv_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'maybe' ELSE 'no' END AS q, CASE WHEN conv_id % 17 = 0 THEN 'no' ELSE 'yes' END AS c FROM conv),
v AS (SELECT raw.*, p1.pos AS p1, p2.pos AS p2, p3.pos AS p3, p4.pos AS p4 FROM raw
  LEFT JOIN lab p1 ON p1.conv_id = raw.conv_id AND p1.label = he AND regexp_full_match(he, 'U[1-9][0-9]*')
  LEFT JOIN lab p2 ON p2.conv_id = raw.conv_id AND p2.label = ae AND regexp_full_match(ae, 'A[1-9][0-9]*')
  LEFT JOIN lab p3 ON p3.conv_id = raw.conv_id AND p3.label = ue AND regexp_full_match(ue, 'U[1-9][0-9]*')
  LEFT JOIN lab p4 ON p4.conv_id = raw.conv_id AND p4.label = xe AND regexp_full_match(xe, 'U[1-9][0-9]*')),
s1 AS (SELECT *, h = 'strong' AND e AND p1 IS NOT NULL AS ext FROM v),
s2 AS (SELECT *, ext AND a AND p2 IS NOT NULL AS refl FROM s1),
s3 AS (SELECT *, refl AND u AND p3 IS NOT NULL AS upt FROM s2),
s4 AS (SELECT *, upt AND x AND p4 IS NOT NULL AS re, ext AND d AS del, CASE WHEN ext THEN lvl ELSE 0 END AS level FROM s3),
audited AS (SELECT *, CASE WHEN level >= 3 AND re AND p1 < p2 AND p2 < p3 AND p3 < p4 THEN 'clear' WHEN level >= 1 AND (refl OR del OR r = 'potential') THEN 'potential' ELSE 'none' END AS label FROM s4),
reviewed AS (SELECT id, conv_id, CASE WHEN conv_id % 10 = 7 THEN 'none' ELSE label END AS label, CASE WHEN conv_id % 10 = 7 THEN 0 ELSE level END AS level FROM audited WHERE conv_id % 4 <> 3)"""

DOCUMENTS = """docs AS (SELECT doc_id, source AS dataset, CAST(length(text) AS BIGINT) AS characters,
  sha256('[{"role":"user","content":' || to_json(coalesce(text, '')) || '}]') AS hash, doc_id % 3 = 0 AS is_base FROM documents)"""
