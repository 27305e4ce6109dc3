"""Readers of conversation releases: each gives the records of one shape of file.

Every reader takes a path and a dataset name, and returns ``records`` with metadata columns,
plus ``source_file`` and, where order matters, ``row``, so the sources can be put in order
(``union_sources``).  Rows that the source's own gate excludes are dropped before messages are cleaned.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions.messages import ROLE_NAMES, USER, clean, falsy_or, from_pairs, realized_path, role_count, transcript_hash
from skeinworks.operators.corpus import long_by_turns, qualifying, records, run_keys, runs
from skeinworks.sources import gzips, ranges
from skeinworks.sources.inventory import require_shards  # noqa: F401

SAID = "array<struct<role:string,content:string>>"
CELLS = {"multiLine": "true", "quote": '"', "escape": '"'}


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def turn_sample(spark: SparkSession, path: str, first: int) -> DataFrame:
    """The first rows of each parquet shard."""
    return _named(spark.read.parquet(path)).withColumn("row", F.col("_metadata.row_index")).where(F.col("row") < first)


def nested_parquet(spark: SparkSession, path: str, dataset: str, *, key: str = "conversation_hash", min_turns: int = 10, min_per_role: int | None = None) -> DataFrame:
    """Parquet with ``conversation[{role, content}]`` and ``turn``: gated by the native turns, and with ``min_per_role`` by both roles too."""
    raw = _named(spark.read.parquet(path)).withColumn("row", F.col("_metadata.row_index"))
    raw = long_by_turns(raw.select(key, "conversation", "turn", "model", "language", "source_file", "row"), min_turns=min_turns)
    rows = raw.withColumn("messages", clean(F.col("conversation"))).drop("conversation")
    found = records(rows, dataset, F.col(key), exchanges=None if min_per_role else F.col("turn")).drop(key, "turn")
    return qualifying(found, min_per_role) if min_per_role else found


def typed_jsonl(spark: SparkSession, path: str, dataset: str, *, min_turns: int = 10) -> DataFrame:
    """JSON lines whose messages carry their role in ``type``; exchanges are user messages."""
    raw = _named(spark.read.schema("id string, messages array<struct<type:string,content:string>>, model_name string, task_summary string").json(path))
    rows = raw.withColumn("messages", clean(F.col("messages"), role="type")).withColumns({"model": F.col("model_name"), "language": F.lit("English")})
    rows = rows.withColumn("users", role_count(F.col("messages"), USER)).where(F.col("users") >= min_turns)
    return records(rows.withColumnRenamed("id", "raw_id"), dataset, F.col("raw_id"), exchanges=F.col("users")).drop("raw_id", "users", "model_name")


#: Escapes of a literal's strings that are set aside while it is cut, by characters of the private use area, and what JSON writes for them.
ASIDE = {"\\\\": ("\ue000", "\\\\"), "\\'": ("\ue001", "'"), '\\"': ("\ue002", '\\"')}
#: What a literal is made of then: strings in either quotes, names and numbers, marks, space.
TOKEN = r"""(?s)"[^"]*"|'[^']*'|[A-Za-z0-9_.+-]+|[\[\]{}:,]|\s+"""
#: Escapes that JSON doesn't have, or that mean something else there; and the characters that stand for others.
UNSHARED, RESERVED = r"\\(?![nrtbf])", "[\ue000-\ue002]"


def literal_as_json(cell: Column) -> Column:
    """The text of a Python literal as JSON, by expressions; null where it has what can't be told from a token: other escapes, the characters set aside.

    The cell is cut into tokens, each is rewritten, and they are joined.  The result may be no JSON, where the cell is no such literal.
    """
    plain = cell
    for escape, (mark, _) in ASIDE.items():
        plain = F.replace(plain, F.lit(escape), F.lit(mark))
    tokens = F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))

    def string(token: Column) -> Column:
        body = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit('"'), F.lit('\\"'))
        for mark, json_text in ASIDE.values():
            body = F.replace(body, F.lit(mark), F.lit(json_text))
        return F.concat(F.lit('"'), body, F.lit('"'))

    names = lambda t: F.when(t == "None", "null").when(t == "True", "true").when(t == "False", "false").otherwise(t)
    covered = F.length(F.array_join(tokens, "")) == F.length(plain)
    fit = covered & ~cell.rlike(RESERVED) & ~plain.rlike(UNSHARED)
    return F.when(fit, F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[\"']"), string(t)).otherwise(names(t))), ""))


@F.pandas_udf(T.StringType())
def _evaluated(cells: pd.Series) -> pd.Series:
    """What expressions couldn't read, as JSON; anything but a list is an error."""

    def parse(cell: str | None) -> str | None:
        if cell is None:
            return None
        try:
            value = json.loads(cell)
        except ValueError:
            value = ast.literal_eval(cell)
        if not isinstance(value, list):
            raise ValueError("the conversation cell is not a list")
        return json.dumps(value, ensure_ascii=False)

    return cells.map(parse)


def parsed_cells(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the text column ``conversation``, lists as JSON or Python literals, parsed to ``schema``.

    Cells of JSON, and literals that ``literal_as_json`` can read, never leave the JVM: the function in Python gets nulls for them.
    """
    as_list = lambda text: F.when(F.col(text).rlike(r"^\s*\[") & F.call_function("try_parse_json", F.col(text)).isNotNull(), F.col(text))
    read = rows.withColumn("__json", as_list("conversation"))
    read = read.withColumn("__literal", F.when(F.col("__json").isNull(), literal_as_json(F.col("conversation"))))
    read = read.withColumn("__json", F.coalesce("__json", as_list("__literal")))
    rest = F.when(F.col("__json").isNull(), F.col("conversation"))
    return read.withColumn("conversation", F.from_json(F.coalesce("__json", _evaluated(rest)), schema)).drop("__json", "__literal")


def literal_csv(spark: SparkSession, path: str, dataset: str, *, min_turns: int = 10) -> DataFrame:
    """CSV whose ``conversation`` is a literal list of question and answer pairs; gated by ``num_turns``."""
    named = {"conversation_id": "conversation_id", "conversation": "conversation", "LLM_type": "model", "user_id": "user_id"}
    raw = csv_cells(spark, path).select(_cell("num_turns").cast("long").alias("num_turns"), *(_cell(c).alias(n) for c, n in named.items()), "source_file", F.col("number").alias("row"))
    rows = parsed_cells(raw.where(F.col("num_turns") >= min_turns), "array<struct<user_question:string,AI_response:string>>")
    rows = rows.withColumn("messages", from_pairs(F.col("conversation"), question="user_question", answer="AI_response")).withColumn("language", F.lit(None).cast("string"))
    return records(rows, dataset, F.col("conversation_id"), exchanges=F.col("num_turns")).drop("conversation", "conversation_id", "num_turns")


def array_json(spark: SparkSession, path: str, dataset: str, *, min_per_role: int = 10) -> DataFrame:
    """A JSON array of conversations with ``from`` and ``value``, read in ranges (``ranges.json_records``); ``row`` is a record's number in its file."""
    schema = "id string, conversations array<struct<`from`:string,value:string>>, `$modelId` string, language string, consecutive_turns string"
    raw = ranges.json_records(spark, path).select(F.from_json("record", schema).alias("r"), _file(F.col("path")).alias("source_file"), F.col("number").alias("row")).select("r.*", "source_file", "row")
    rows = raw.withColumn("messages", clean(F.col("conversations"), role="from", content="value", roles=ROLE_NAMES)).withColumns({"model": F.col("`$modelId`"), "raw_id": F.col("id")})
    return qualifying(records(rows.drop("id", "conversations", "$modelId"), dataset, F.col("raw_id")), min_per_role).drop("raw_id")


def candidate_jsonl(spark: SparkSession, path: str, dataset: str, *, min_per_role: int = 10) -> DataFrame:
    """JSON lines with several replies a turn: the chosen ones make the conversation."""
    schema = "conversation_id string, conversation_history array<struct<role:string,content:string,if_chosen:boolean>>, user_id string, conversation_type string"
    raw = _named(spark.read.schema(schema).json(path))
    rows = raw.withColumn("messages", clean(realized_path(F.coalesce("conversation_history", F.array().cast("array<struct<role:string,content:string,if_chosen:boolean>>"))), roles=ROLE_NAMES))
    return qualifying(records(rows, dataset, F.col("conversation_id")), min_per_role).drop("conversation_id", "conversation_history")


def csv_cells(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """source_file, path, number (from 1), block, names, cells: the rows of CSV files, each with the header of its own file.

    Files are read in ranges (``ranges.csv_records``), all in one plan; an earlier job finds the widest header.
    """
    every = ranges.csv_records(spark, path, **options)
    heads = every.where("number = 0").select(F.col("path").alias("__path"), F.col("record").alias("__head"))
    width = heads.agg(F.max(F.length("__head") - F.length(F.replace("__head", F.lit(","), F.lit(""))) + 1).alias("n")).first()["n"]
    if width is None:
        raise ValueError(f"no CSV files with a header below {path}")
    schema = ", ".join(f"c{k} string" for k in range(width))
    fields = lambda c: F.array(*(F.from_csv(c, F.lit(schema), CELLS)[f"c{k}"] for k in range(width)))
    heads = heads.select("__path", fields(F.col("__head")).alias("names"))
    rows = every.where("number > 0").join(heads, F.col("path") == F.col("__path"))
    return rows.select(_file(F.col("path")).alias("source_file"), "path", "number", "block", "names", fields(F.col("record")).alias("cells"))


def _cell(name: str):
    """The cell under ``name``; null where the file has no such column."""
    at = F.array_position("names", F.lit(name)).cast("int")
    return F.when(at > 0, F.get("cells", at - 1))


def _file(path):
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def conversation_rows(raw: DataFrame, dataset: str, *, min_per_role: int = 10) -> DataFrame:
    """The records of ``csv_cells`` rows that hold a conversation each."""
    meta = {c: _cell(c) for c in ("conversation_id", "url", "platform", "language", "fine_grained_topic", "high_level_category")}
    rows = parsed_cells(raw.select(_cell("conversation").alias("conversation"), *(c.alias(n) for n, c in meta.items()), "source_file", F.col("number").alias("row")), SAID)
    rows = rows.withColumn("messages", clean(F.col("conversation"), roles=ROLE_NAMES))
    stem = F.regexp_replace("source_file", r"\.csv$", "")
    rows = rows.withColumns({"platform": falsy_or(F.col("platform"), stem), "raw_id": falsy_or(F.col("conversation_id"), falsy_or(F.col("url"), transcript_hash(F.col("messages"))))})
    return qualifying(records(rows, dataset, F.col("raw_id")), min_per_role).drop("conversation", "conversation_id", "url", "raw_id")


def conversation_csv(spark: SparkSession, path: str, dataset: str, *, min_per_role: int = 10) -> DataFrame:
    """CSV with a conversation in each row; its id is conversation_id, else url, else the transcript's hash."""
    return conversation_rows(csv_cells(spark, path), dataset, min_per_role=min_per_role)


def turn_rows(raw: DataFrame, dataset: str, *, min_per_role: int = 10) -> DataFrame:
    """The records of ``csv_cells`` rows that hold a message each; runs of keys are found by the ranges that rows were read in."""
    names = ("conversation_id", "url", "role", "plain_text", "content", "message_index", "turn", "platform", "detected_language_final", "language", "fine_grained_topic", "high_level_category", "topic")
    rows = raw.select(*(_cell(c).alias(c) for c in names), "source_file", "path", "block", F.col("number").alias("row"))
    key = falsy_or(F.col("conversation_id"), falsy_or(F.col("url"), F.raise_error(F.concat(F.lit("no conversation key in "), "source_file")).cast("string")))
    rows = runs(rows.withColumn("key", key), key="key", order="row", part="block", within=["path"])
    at = falsy_or(F.col("message_index"), falsy_or(F.col("turn"), "0")).cast("int")
    said = F.struct(at.alias("at"), "row", "role", falsy_or(F.col("plain_text"), falsy_or(F.col("content"))).alias("content"))
    first = lambda c, other=None: F.min_by(falsy_or(F.col(c), F.col(other)) if other else F.col(c), "row")
    stem = F.regexp_replace("source_file", r"\.csv$", "")
    found = rows.groupBy("path", "source_file", "run", "key").agg(
        F.array_sort(F.collect_list(said)).alias("said"), F.min("row").alias("row"), F.min_by(falsy_or(F.col("platform"), stem), "row").alias("platform"),
        first("detected_language_final", "language").alias("language"), *(first(c).alias(c) for c in ("fine_grained_topic", "high_level_category", "topic")),
    )
    keys = run_keys(rows, key="key", part="block", within=["path"]).select("path", "run", "run_key")
    found = found.join(keys, ["path", "run"]).withColumn("messages", clean(F.col("said"), roles=ROLE_NAMES))
    return qualifying(records(found, dataset, F.col("run_key")), min_per_role).drop("said", "key", "run", "run_key", "path")


def turn_csv(spark: SparkSession, path: str, dataset: str, *, min_per_role: int = 10) -> DataFrame:
    """CSV with a message in each row: stretches of one key are conversations, a key's later ones numbered.

    Messages are ordered by message_index, else turn, else 0, then file order; what describes
    the conversation comes from its first row in the file.  A row without a key is an error.
    """
    return turn_rows(csv_cells(spark, path), dataset, min_per_role=min_per_role)


def platform_csvs(spark: SparkSession, path: str, dataset: str, *, min_per_role: int = 10, recursive: bool = False) -> DataFrame:
    """All CSV files in ``path`` (``recursive``: and below it): the header of each says whether its rows are conversations or messages."""
    raw = csv_cells(spark, path, pathGlobFilter="*.csv", recursiveFileLookup=str(recursive).lower())
    whole = F.array_contains("names", "conversation")
    parts = [conversation_rows(raw.where(whole), dataset, min_per_role=min_per_role), turn_rows(raw.where(~whole), dataset, min_per_role=min_per_role)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources with ``source_order``, their place in the list; columns that a source lacks are null."""
    found = None
    for k, source in enumerate(sources):
        part = source.withColumn("source_order", F.lit(k))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def corpus_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A gzipped corpus of JSON lines: by its members where it has an index (``gzips``); a file of another writer can't be split, and is dealt out after reading."""
    if gzips.is_indexed(spark, path):
        return gzips.read(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
    return spark.read.schema(schema).json(path).repartition(spark.sparkContext.defaultParallelism)


def positions(rows: DataFrame, order: str = "row") -> DataFrame:
    """``position`` of each row inside its source and file, from 0."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("source_order", "source_file").orderBy(order)) - 1)
