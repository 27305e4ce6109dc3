"""Readers and sinks: the test conversations are written in the shape of each release and read back; the SQL works on the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.messages import clean, compact_json, transcript_hash
from skeinworks.operators import corpus as co
from skeinworks.operators import profile
from skeinworks.plans import fixtures as fx
from skeinworks.plans.fixtures import MESSAGES
from skeinworks.plans.registry import query
from skeinworks.sources import corpora, inventory, readers

#: Turns, or messages of each role, that the queries ask for: no test conversation has ten.
LEAST = 3
COLUMNS = ("id", "source_id", "exchanges", "user_messages", "assistant_messages", "message_turns", "characters")


def _talks(spark: SparkSession, sf: str, roles: dict[str, str] | None = None) -> DataFrame:
    """conv_id, users, talk: all messages of a conversation in order, those of the system too, with the role names of a release."""
    names = {"user": "user", "assistant": "assistant", "system": "system"} | (roles or {})
    turns = fx.table(spark, sf, "conversations").withColumn("role", F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("role")))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(said.alias("talk"), F.count_if(F.col("role") == names["user"]).alias("users"))


def _told(role: str = "role", content: str = "content") -> Column:
    return F.transform("talk", lambda m: F.struct(m["role"].alias(role), m["text"].alias(content)))


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*COLUMNS, *more, transcript_hash(F.col("messages")).alias("hash"))


def _records(dataset: str, source_id: str, *, exchanges: str = "least(nu, na)", gate: str = f"nu >= {LEAST} AND na >= {LEAST}", more: str = "", table: str = "conv") -> str:
    return f"""WITH {MESSAGES} SELECT substr(sha256('{dataset}' || chr(0) || {source_id}), 1, 24) AS id, {source_id} AS source_id, {exchanges} AS exchanges, nu AS user_messages, na AS assistant_messages,
  n AS message_turns, ch AS characters, {more} hash FROM {table} WHERE {gate}"""


# ---- one query for each shape ----


def _parquet(spark: SparkSession, sf: str, *, null_turns: bool = False) -> str:
    path = fx.scratch(spark, "parquet")
    turns = F.when(F.col("conv_id") % 4 == 0, None).otherwise(F.col("users")) if null_turns else F.col("users")
    rows = _talks(spark, sf).select(F.concat(F.lit("h"), F.col("conv_id").cast("string")).alias("conversation_hash"), _told().alias("conversation"), turns.cast("int").alias("turn"), F.lit("m").alias("model"), F.lit("en").alias("language"), "conv_id")
    rows.repartitionByRange(4, "conv_id").sortWithinPartitions("conv_id").write.parquet(path)
    return path


@query(_records("wild", "'h' || conv_id", exchanges="nu", gate=f"nu >= {LEAST}"))
def s05_nested_parquet(spark, sf):
    return _shown(readers.nested_parquet(spark, _parquet(spark, sf), "wild", min_turns=LEAST).withColumn("exchanges", F.col("exchanges").cast("long")))


@query(_records("wild", "'h' || conv_id", gate=f"conv_id % 4 <> 0 AND nu >= {LEAST} AND na >= {LEAST}"))
def s06_gated_parquet(spark, sf):
    return _shown(readers.nested_parquet(spark, _parquet(spark, sf, null_turns=True), "wild", min_turns=LEAST, min_per_role=LEAST))


@query(f"WITH {MESSAGES} SELECT nu AS n_turns, count(*) AS conversations FROM conv WHERE conv_id % 4 <> 0 GROUP BY nu")
def s01_sharded_histogram(spark, sf):
    return profile.sharded_histogram(spark, _parquet(spark, sf, null_turns=True), shards=4)


@query("WITH c AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT conv_id, ntile(4) OVER (ORDER BY conv_id) AS shard FROM c) SELECT count(*) AS shards, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT shard, least(3, count(*)) AS n FROM s GROUP BY shard)")
def s04_turn_sample(spark, sf):
    sample = readers.turn_sample(spark, _parquet(spark, sf), 3)
    return sample.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"))


def sampled_shards(spark: SparkSession, sf: str, first: int) -> DataFrame:
    """The first rows of four shards in order of conv_id, with their own number of turns, one too many for each third, and messages."""
    path = fx.scratch(spark, "shards")
    numbered = _talks(spark, sf).withColumn("shard", F.ntile(4).over(fx.Window.orderBy("conv_id")))
    rows = numbered.select("conv_id", "shard", (F.col("users") + (F.col("conv_id") % 3 == 0).cast("int")).alias("turn"), _told().alias("conversation"))
    rows.repartition(4, "shard").sortWithinPartitions("shard", "conv_id").write.partitionBy("shard").parquet(path)
    return readers.turn_sample(spark, path, first).withColumn("messages", clean(F.col("conversation")))


@query("SELECT conv_id % 4 AS shard, count(DISTINCT conv_id) AS conversations, count(*) AS messages, true AS wrong_number_refused FROM conversations GROUP BY 1")
def s03_require_shards(spark, sf):
    """What each shard of a release holds, read only if they are as many as expected."""
    path = fx.scratch(spark, "shards")
    _talks(spark, sf).select((F.col("conv_id") % 4).alias("shard"), "talk").repartition(4, "shard").write.partitionBy("shard").parquet(path)
    found = readers.require_shards(spark.read.parquet(path), 4)
    try:
        readers.require_shards(spark.read.parquet(path), 5)
        refused = False
    except ValueError:
        refused = True
    number = F.regexp_extract(F.col("_metadata.file_path"), "shard=([0-9]+)", 1).cast("long")
    return found.groupBy(number.alias("shard")).agg(F.count(F.lit(1)).alias("conversations"), F.sum(F.size("talk")).alias("messages"), F.lit(refused).alias("wrong_number_refused"))


@query(_records("typed", "conv_id::VARCHAR", exchanges="nu", gate=f"nu >= {LEAST}"))
def s07_typed_jsonl(spark, sf):
    path = fx.scratch(spark, "typed")
    _talks(spark, sf).select(F.col("conv_id").cast("string").alias("id"), _told("type").alias("messages"), F.lit("m").alias("model_name")).write.json(path)
    return _shown(readers.typed_jsonl(spark, path, "typed", min_turns=LEAST))


PAIRS = f"""WITH {MESSAGES}, q AS (SELECT conv_id, turn, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, role FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS q, CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS a FROM q WHERE role = 'user'),
pair AS (SELECT conv_id, count(*) AS nu, CAST(sum(length(q) + length(a)) AS BIGINT) AS ch,
  sha256('[' || string_agg('{{"role":"user","content":' || to_json(q) || '}},{{"role":"assistant","content":' || to_json(a) || '}}', ',' ORDER BY turn) || ']') AS hash FROM p GROUP BY conv_id)
"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id and ``pairs``: each question with the answer that follows it, if one does."""
    said = F.expr("filter(talk, m -> m.role IN ('user', 'assistant'))")
    paired = F.expr("""transform(filter(transform(said, (m, i) -> struct(m.role AS role, m.text AS q, get(said, i + 1) AS next)), x -> x.role = 'user'),
      x -> struct(x.q AS user_question, if(x.next.role = 'assistant', x.next.text, CAST(NULL AS STRING)) AS AI_response))""")
    return _talks(spark, sf).withColumn("said", said).select("conv_id", paired.alias("pairs"))


def _python_literal(json: Column) -> Column:
    """JSON as the text of a Python literal."""
    return F.replace(json, F.lit('"AI_response":null'), F.lit('"AI_response":None'))


@query(PAIRS + f"""SELECT substr(sha256('preview' || chr(0) || conv_id), 1, 24) AS id, conv_id::VARCHAR AS source_id, nu AS exchanges, nu AS user_messages, nu AS assistant_messages, 2 * nu AS message_turns, ch AS characters, hash
FROM pair WHERE nu >= {LEAST}""")
def s08_literal_csv(spark, sf):
    path = fx.scratch(spark, "literal")
    rows = _pairs(spark, sf).select(F.col("conv_id").alias("conversation_id"), F.size("pairs").alias("num_turns"), _python_literal(compact_json(F.col("pairs"))).alias("conversation"), F.lit("m").alias("LLM_type"), F.lit("u").alias("user_id"))
    rows.write.options(header=True, quoteAll=True, escape='"').csv(path)
    return _shown(readers.literal_csv(spark, path, "preview", min_turns=LEAST))


@query(_records("array", "conv_id::VARCHAR"))
def s09_array_json(spark, sf):
    path = fx.scratch(spark, "array")
    rows = _talks(spark, sf, {"user": "human", "assistant": "gpt"}).select("conv_id", F.struct(F.col("conv_id").cast("string").alias("id"), _told("from", "value").alias("conversations"), F.lit("g").alias("$modelId")).alias("r"))
    files = rows.groupBy((F.col("conv_id") % 3).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json("r")), ","), F.lit("]")).alias("value"))
    files.repartition(3, "part").write.partitionBy("part").text(path)
    return _shown(readers.array_json(spark, path, "array", min_per_role=LEAST))


@query(_records("chosen", "conv_id::VARCHAR"))
def s10_candidate_jsonl(spark, sf):
    path = fx.scratch(spark, "chosen")
    # Each answer stands beside one that wasn't chosen, and one of which nothing is known
    both = F.expr("""flatten(transform(talk, m -> if(m.role = 'model', array(struct(m.role AS role, 'other' AS content, false AS if_chosen), struct(m.role AS role, m.text AS content, true AS if_chosen),
      struct(m.role AS role, 'other' AS content, CAST(NULL AS BOOLEAN) AS if_chosen)), array(struct(m.role AS role, m.text AS content, CAST(NULL AS BOOLEAN) AS if_chosen)))))""")
    _talks(spark, sf, {"assistant": "model"}).select(F.col("conv_id").cast("string").alias("conversation_id"), both.alias("conversation_history"), F.lit("u").alias("user_id"), F.lit("open").alias("conversation_type")).write.json(path)
    return _shown(readers.candidate_jsonl(spark, path, "chosen", min_per_role=LEAST))


def _cells(spark: SparkSession, sf: str, path: str) -> None:
    """Conversations as cells of CSV: the id in one of two columns, or in neither."""
    c = F.col("conv_id")
    key = lambda on, prefix: F.when(c % 3 == on, F.concat(F.lit(prefix), c.cast("string")))
    rows = _talks(spark, sf, {"assistant": "llm"}).select(key(0, "c").alias("conversation_id"), key(1, "u").alias("url"), compact_json(_told()).alias("conversation"), F.when(c % 2 == 0, "site").alias("platform"))
    rows.write.options(header=True, quoteAll=True, escape='"', nullValue="", emptyValue="").csv(path)


CELL_ID = "CASE conv_id % 3 WHEN 0 THEN 'c' || conv_id WHEN 1 THEN 'u' || conv_id ELSE hash END"


@query(_records("share", CELL_ID, more="conv_id % 2 = 0 AS known,"))
def s12_conversation_csv(spark, sf):
    path = fx.scratch(spark, "cells")
    _cells(spark, sf, path)
    return _shown(readers.conversation_csv(spark, path, "share", min_per_role=LEAST).withColumn("known", F.col("platform") == "site"), "known")


def _rows(spark: SparkSession, sf: str, path: str) -> None:
    """Messages as rows of CSV, every conversation's last turn first, those of multiples of five under one key."""
    c = F.col("conv_id")
    rows = fx.table(spark, sf, "conversations").select(
        F.when(c % 5 == 0, "again").otherwise(F.concat(F.lit("k"), c.cast("string"))).alias("conversation_id"), F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"),
        F.when(c % 2 == 0, F.col("text")).alias("plain_text"), F.when(c % 2 == 1, F.col("text")).alias("content"), F.when(c % 3 == 0, F.col("turn")).alias("message_index"), F.when(c % 3 != 0, F.col("turn")).alias("turn"), "conv_id", F.col("turn").alias("at"),
    )
    # A conversation under the shared key follows one with a key of its own, so each is a stretch
    ordered = rows.coalesce(1).sortWithinPartitions("conv_id", F.desc("at")).drop("conv_id", "at")
    ordered.write.options(header=True, quoteAll=True, escape='"', nullValue="", emptyValue="").csv(path)


NUMBERED = f"""(SELECT *, CASE WHEN conv_id % 5 <> 0 THEN 'k' || conv_id WHEN nth = 1 THEN 'again' ELSE 'again#occurrence=' || nth END AS key
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id % 5 = 0 ORDER BY conv_id) AS nth FROM conv))"""


@query(_records("share", "key", table=NUMBERED))
def s13_turn_csv(spark, sf):
    path = fx.scratch(spark, "rows")
    _rows(spark, sf, path)
    return _shown(readers.turn_csv(spark, path, "share", min_per_role=LEAST))


@query(f"""WITH {MESSAGES}, good AS (SELECT * FROM conv WHERE nu >= {LEAST} AND na >= {LEAST})
SELECT 'cells' AS kind, count(*) AS conversations, CAST(sum(ch) AS BIGINT) AS characters FROM good UNION ALL SELECT 'rows', count(*), CAST(sum(ch) AS BIGINT) FROM good""")
def s14_platform_csvs(spark, sf):
    path = fx.scratch(spark, "platforms")
    _cells(spark, sf, f"{path}/cells")
    _rows(spark, sf, f"{path}/rows")
    # A conversation's id in the two shapes tells them apart
    found = readers.platform_csvs(spark, path, "share", min_per_role=LEAST, recursive=True)
    kind = F.when(F.col("source_id").rlike("^(k[0-9]+|again.*)$"), "rows").otherwise("cells")
    return found.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("conversations"), F.sum("characters").alias("characters"))


# ---- sources in order, and the corpus as a whole ----


def _two_sources(spark: SparkSession, sf: str) -> DataFrame:
    first = readers.nested_parquet(spark, _parquet(spark, sf), "wild", min_turns=LEAST)
    return readers.union_sources([first, readers.nested_parquet(spark, _parquet(spark, sf), "later", min_turns=LEAST, min_per_role=LEAST)])


@query(f"""WITH {MESSAGES}, two AS (SELECT 0 AS source_order, 'wild' AS dataset, conv_id FROM conv WHERE nu >= {LEAST} UNION ALL SELECT 1, 'later', conv_id FROM conv WHERE nu >= {LEAST} AND na >= {LEAST})
SELECT source_order, dataset, 'h' || conv_id AS source_id, row_number() OVER (PARTITION BY source_order ORDER BY conv_id) - 1 AS place FROM two""")
def t01_ordered_union(spark, sf):
    placed = corpora.in_order(_two_sources(spark, sf))
    first = F.min("position").over(fx.Window.partitionBy("source_order"))
    return placed.select("source_order", "dataset", "source_id", (F.col("position") - first).alias("place"))


BOTH = f"""WITH {MESSAGES}, every AS (SELECT 'wild' AS dataset, 'h' || conv_id AS source_id, nu, ch, hash, 0 AS s, conv_id FROM conv WHERE nu >= {LEAST}
  UNION ALL SELECT 'later', 'h' || conv_id, nu, ch, hash, 1, conv_id FROM conv WHERE nu >= {LEAST} AND na >= {LEAST})"""


@query(BOTH + " SELECT row_number() OVER (ORDER BY s, conv_id) - 1 AS place, dataset, source_id, ch AS characters, hash FROM every")
def k01_ordered_corpus(spark, sf):
    """A corpus as parts of gzipped JSON lines in source order, read back by part and line."""
    path = fx.scratch(spark, "corpus")
    corpora.write_ordered(corpora.in_order(_two_sources(spark, sf)).select("id", "dataset", "source_id", "characters", "messages", "position"), path)
    back = corpora.read_ordered(spark, path, "id string, dataset string, source_id string, characters long, messages array<struct<role:string,content:string>>")
    return back.select("place", "dataset", "source_id", "characters", transcript_hash(F.col("messages")).alias("hash"))


@query(BOTH + " SELECT dataset, count(*) AS conversations, CAST(sum(ch) AS BIGINT) AS characters FROM every GROUP BY dataset")
def s15_corpus_jsonl(spark, sf):
    path = fx.scratch(spark, "corpus")
    corpora.write_ordered(corpora.in_order(_two_sources(spark, sf)).select("dataset", "characters", "position"), path)
    return readers.corpus_jsonl(spark, path, "dataset string, characters long").groupBy("dataset").agg(F.count(F.lit(1)).alias("conversations"), F.sum("characters").alias("characters"))


@query(BOTH + """, old AS (SELECT * FROM every WHERE s = 0), fresh AS (SELECT * FROM every WHERE s = 1), sums AS (SELECT dataset, count(*) AS n, CAST(sum(ch) AS BIGINT) AS ch, max(ch) AS top FROM every GROUP BY dataset)
SELECT dataset, n AS conversations, ch AS characters, top AS max_characters, (SELECT CAST(sum(n) AS BIGINT) FROM sums) AS total, (SELECT CAST(sum(ch) AS BIGINT) FROM sums) AS total_characters FROM sums""")
def k06_manifest_json(spark, sf):
    path = fx.scratch(spark, "manifest")
    corpora.write_json(corpora.manifest_document(co.manifest(_two_sources(spark, sf)), minimum=LEAST), path)
    found = corpora.read_json(spark, path, "minimum int, counts map<string,long>, characters map<string,long>, maximum_characters map<string,long>, total_conversations long, total_characters long")
    one = found.select(F.explode("counts").alias("dataset", "conversations"), "characters", "maximum_characters", F.col("total_conversations").alias("total"), "total_characters")
    return one.select("dataset", "conversations", F.element_at("characters", F.col("dataset")).alias("characters"), F.element_at("maximum_characters", F.col("dataset")).alias("max_characters"), "total", "total_characters")


@query(f"""WITH {MESSAGES}, h AS (SELECT nu AS n_turns, count(*) AS n FROM conv GROUP BY nu), t AS (SELECT sum(n) AS total FROM h)
SELECT 'talk' AS dataset, i AS n_turns, coalesce(n, 0) AS conversations, coalesce(n, 0) / total AS share FROM t, range(1, (SELECT max(n_turns) FROM h) + 1) r(i) LEFT JOIN h ON n_turns = i""")
def k07_distribution_csv(spark, sf):
    path = fx.scratch(spark, "distribution")
    corpora.write_csv(profile.dense_distribution(profile.turn_histogram(fx.corpus(spark, sf), "user_messages")).select(F.lit("talk").alias("dataset"), "n_turns", "conversations", "share"), path)
    return spark.read.option("header", True).schema("dataset string, n_turns long, conversations long, share double").csv(path)


@query(f"""WITH {MESSAGES} SELECT dataset, CAST(total AS BIGINT) AS rows FROM (SELECT CASE conv_id % 2 WHEN 0 THEN 'even' ELSE 'odd numbers' END AS dataset, count(*) AS total FROM conv GROUP BY 1)""")
def s24_raw_counts(spark, sf):
    """Raw counts out of a JSON document of summaries, one dataset under a name of the corpus."""
    path = fx.scratch(spark, "summaries")
    halves = fx.corpus(spark, sf).groupBy(F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("dataset")).agg(F.count(F.lit(1)).alias("total_conversations"))
    corpora.write_json(halves.agg(F.array_sort(F.collect_list(F.struct("dataset", "total_conversations"))).alias("summaries")), path)
    return corpora.raw_counts(spark, path, renamed={"odd": "odd numbers"})


@query(f"""WITH {MESSAGES} SELECT dataset, count(*) AS n FROM (SELECT CASE conv_id % 3 WHEN 0 THEN 'base' ELSE 'more' END AS dataset FROM conv) WHERE dataset = 'base' GROUP BY dataset""")
def f04_base_only(spark, sf):
    rows = fx.corpus(spark, sf).withColumn("dataset", F.when(F.col("conv_id") % 3 == 0, "base").otherwise("more"))
    return co.of_datasets(rows, ["base"], ["base", "more"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MESSAGES}, e AS (SELECT conv_id, hash, conv_id % 2 = 0 AS is_base FROM conv), f AS (SELECT hash, min(conv_id) AS first FROM e WHERE NOT is_base GROUP BY hash)
SELECT conv_id FROM e WHERE is_base OR (hash NOT IN (SELECT hash FROM e WHERE is_base) AND conv_id = (SELECT first FROM f WHERE f.hash = e.hash))""")
def t06_rebuilt_expansion(spark, sf):
    """Expanding an expanded corpus again from its base rows gives the same corpus."""
    rows = co.with_hash(fx.corpus(spark, sf)).withColumn("dataset", F.when(F.col("conv_id") % 2 == 0, "base").otherwise("more"))
    once = co.expand(rows.where("dataset = 'base'"), rows.where("dataset = 'more'"), order=["conv_id"])
    base = co.of_datasets(once, ["base"], ["base", "more"])
    return co.expand(base, rows.where("dataset = 'more'"), order=["conv_id"]).select("conv_id")


@query("""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 7 < 3 THEN 'p' || (doc_id % 3) END AS platform, doc_id % 3 = 0 AS is_base FROM documents), f AS (SELECT text, min(doc_id) AS first FROM d WHERE NOT is_base GROUP BY text),
s AS (SELECT d.*, CASE WHEN text IS NULL THEN 'included' WHEN text IN (SELECT text FROM d WHERE is_base AND text IS NOT NULL) THEN 'base_dup' WHEN doc_id = (SELECT first FROM f WHERE f.text = d.text) THEN 'included' ELSE 'expansion_dup' END AS status FROM d WHERE NOT is_base)
SELECT platform, count(*) AS qualifying, count(*) FILTER (status = 'base_dup') AS base_dup, count(*) FILTER (status = 'expansion_dup') AS expansion_dup, count(*) FILTER (status = 'included') AS included FROM s GROUP BY platform""")
def a07_by_platform(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 7 < 3, F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"))).alias("platform"))
    found = co.dedup_status(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), order=["doc_id"])
    return co.expansion_manifest(found, by="platform")


# ---- cleaning ----


@query(f"""WITH x AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS text FROM conversations)
SELECT conv_id, 'renamed' AS how, count(*) FILTER (role IN ('user', 'model')) AS messages, CAST(coalesce(sum(length(text)) FILTER (role IN ('user', 'model')), 0) AS BIGINT) AS characters FROM x GROUP BY conv_id
UNION ALL SELECT conv_id, 'exact', count(*) FILTER (role = 'user'), CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) FROM x GROUP BY conv_id
UNION ALL SELECT conv_id, 'fallback', count(*) FILTER (role IN ('user', 'system')), CAST(coalesce(sum(length(text)) FILTER (role IN ('user', 'system')), 0) AS BIGINT) FROM x GROUP BY conv_id""")
def p01_cleaned(spark, sf):
    """The three ways to clean: roles renamed, exact roles only, and a second field for those without a role."""
    from skeinworks.functions.messages import ROLE_NAMES, characters

    raw = F.transform("talk", lambda m: F.struct(F.when(m["role"] != "system", m["role"]).alias("role"), F.when(m["role"] == "system", "user").alias("type"), F.when(m["turn"] % 3 != 0, m["text"]).alias("content")))
    rows = _talks(spark, sf, {"assistant": "model"}).select("conv_id", raw.alias("raw"))
    found = None
    for how, options in (("renamed", {"roles": ROLE_NAMES}), ("exact", {}), ("fallback", {"role_fallback": "type"})):
        messages = clean(F.col("raw"), **options)
        part = rows.select("conv_id", F.lit(how).alias("how"), F.size(messages).cast("long").alias("messages"), characters(messages).alias("characters"))
        found = part if found is None else found.unionByName(part)
    return found


# ---- files ----


@query("""SELECT f AS file, CASE f WHEN 'a' THEN 'complete' WHEN 'b' THEN 'partial' WHEN 'c' THEN 'oversize' ELSE 'missing' END AS state, 'd' AS dataset, n AS bytes
FROM (SELECT unnest(['a', 'b', 'c', 'e']) AS f), (SELECT 10 + count(*) AS n FROM documents)""")
def s26_file_states(spark, sf):
    n = 10 + fx.table(spark, sf, "documents").count()
    path = fx.scratch(spark, "files")
    sizes = spark.createDataFrame([("a", n - 1), ("b", n - 3), ("c", n + 5)], "name string, n int")
    sizes.select("name", F.repeat(F.lit("x"), F.col("n")).alias("value")).repartition(3, "name").write.partitionBy("name").text(path)
    pinned = inventory.inventory(spark, [("d", f, n) for f in "abce"])
    # The folder that holds a file names it here
    present = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "name=([a-z])", 1).alias("file"), "length")
    return inventory.verify_sizes(pinned, present).select("file", "state", "dataset", "bytes")


#: Each source's documents as a release, a file for each language.
PINNED = """p AS (SELECT source AS dataset, 'org/' || source AS repository, substr(sha256(source), 1, 40) AS revision, replace(source, 'src', 's_') AS folder, 'data/' || lang || '.jsonl' AS remote, lang || '.jsonl' AS file, CAST(sum(strlen(text)) AS BIGINT) AS bytes
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL GROUP BY source, lang)"""


def _pinned(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL").groupBy("source", "lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    file = F.concat("lang", F.lit(".jsonl"))
    return rows.select(F.col("source").alias("dataset"), F.concat(F.lit("org/"), "source").alias("repository"), F.substring(F.sha2("source", 256), 1, 40).alias("revision"), F.replace("source", F.lit("src"), F.lit("s_")).alias("folder"), F.concat(F.lit("data/"), file).alias("remote"), file.alias("file"), "bytes")


@query(f"""WITH {PINNED} SELECT dataset, dataset || ': ' || any_value(repository) || '@' || any_value(revision) || ' (' || count(*) || ' files, ' || printf('%.3f', sum(bytes) / 1e9) || ' GB) -> raw/' || any_value(folder) AS said, true AS unknown_refused
FROM p WHERE dataset IN ('src1', 'src2') GROUP BY dataset""")
def s25_pinned_releases(spark, sf):
    """Two of the pinned releases as they are described, and one that isn't pinned refused."""
    pinned = _pinned(spark, sf)
    try:
        inventory.selected(pinned, ["src1", "none"]).collect()
        refused = False
    except Exception:  # whichever way Spark wraps it
        refused = True
    return inventory.described(inventory.selected(pinned, ["src1", "src2", "src1"]), "raw").withColumn("unknown_refused", F.lit(refused))


@query(f"""WITH {PINNED}, h AS (SELECT *, CASE strlen(dataset || file) % 4 WHEN 0 THEN bytes WHEN 1 THEN bytes // 2 WHEN 2 THEN bytes + 1 END AS length FROM p)
SELECT dataset, file, CASE WHEN length IS NULL THEN 'missing' WHEN length < bytes THEN 'partial' ELSE 'oversize' END AS state, 'https://huggingface.co/datasets/' || repository || '/resolve/' || revision || '/' || remote AS url,
  CASE WHEN length < bytes THEN length ELSE 0 END AS start FROM h WHERE length IS NULL OR length <> bytes""")
def s25_fetch_list(spark, sf):
    """What is still to be fetched of releases of which some files are there, in full, in part, or too long."""
    pinned = _pinned(spark, sf)
    k = F.octet_length(F.concat("dataset", "file")) % 4
    length = F.when(k == 0, F.col("bytes")).when(k == 1, F.floor(F.col("bytes") / 2)).when(k == 2, F.col("bytes") + 1)
    return inventory.fetch_list(pinned, pinned.withColumn("length", length).where("length IS NOT NULL").select("folder", "file", "length"))
