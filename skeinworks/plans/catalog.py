"""All registered corpus queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinworks.functions import text as tx
from skeinworks.functions.messages import alternates, stable_id, turn_labels
from skeinworks.operators import audit, fingerprint, legacy, profile, report, review, translate
from skeinworks.operators import corpus as co
from skeinworks.operators.overlap import overlap_report
from skeinworks.plans import fixtures as fx
from skeinworks.plans import releases, runs  # noqa: F401  (they register theirs)
from skeinworks.plans.fixtures import AUDITED, DOCUMENTS, MESSAGES
from skeinworks.plans.registry import ORACLES, QUERIES, query  # noqa: F401

# ---- profile ----


@query(f"WITH {MESSAGES} SELECT nu AS n_turns, count(*) AS conversations FROM conv GROUP BY nu")
def a01_turn_histogram(spark, sf):
    return profile.turn_histogram(fx.corpus(spark, sf), "user_messages")


@query(f"""WITH {MESSAGES} SELECT count(nu) AS total, min(nu) AS min, max(nu) AS max, avg(nu) AS mean,
  quantile_disc(nu, 0.5) AS median, quantile_disc(nu, 0.95) AS p95, quantile_disc(nu, 0.99) AS p99,
  count(*) FILTER (nu = 1) AS one_turn, count(*) FILTER (nu >= 5) AS five_plus, count(*) FILTER (nu >= 10) AS ten_plus, count(*) FILTER (nu = 0) AS zero_turn,
  count(*) FILTER (nu = 1) / count(*) AS one_turn_share, count(*) FILTER (nu >= 5) / count(*) AS five_plus_share, count(*) FILTER (nu >= 10) / count(*) AS ten_plus_share FROM conv""")
def a02_turn_summary(spark, sf):
    return profile.turn_summary(fx.corpus(spark, sf), "user_messages")


@query("""SELECT lang, quantile_disc(n_chars, 0.5) AS median, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, count(n_chars) AS total FROM documents GROUP BY lang""")
def a03_nearest_rank(spark, sf):
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars)")
    return fx.table(spark, sf, "documents").groupBy("lang").agg(rank(0.5).alias("median"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.count("n_chars").alias("total"))


@query(f"""WITH {MESSAGES}, roles AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS said FROM m GROUP BY conv_id)
SELECT count(*) AS checked, count(*) FILTER (n // 2 <> nu) AS turn_mismatch, count(*) FILTER (nu <> na) AS role_mismatch,
  count(*) FILTER (said <> coalesce(substr(repeat(',user,assistant', nu), 2), '')) AS non_alternating FROM conv JOIN roles USING (conv_id)""")
def a04_validation(spark, sf):
    return profile.validation(fx.corpus(spark, sf).withColumn("turn", F.expr("message_turns div 2")), "turn")


@query(f"""WITH {MESSAGES}, r AS (SELECT nu, conv_id % 3 AS part, conv_id % 7 = 0 AS again, nu + CAST(conv_id % 5 = 0 AS INT) AS told FROM conv)
SELECT 'part ' || part AS dataset, count(*) AS checked, count(*) FILTER (told <> nu) AS question_mismatch, count(*) FILTER (told <> nu + CAST(again AS INT)) AS answer_mismatch FROM r GROUP BY part""")
def a04_key_mismatches(spark, sf):
    """Cells of serialized pairs against their own number of turns, a turn too many for each fifth, an answer's key too many for each seventh."""
    pairs = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: F.struct(m["content"].alias("user_question"), F.lit("x").alias("AI_response")))
    cell = F.concat(F.to_json(pairs), F.when(F.col("conv_id") % 7 == 0, "{'AI_response' : 'y'}").otherwise(""))
    rows = fx.corpus(spark, sf).select(F.concat(F.lit("part "), (F.col("conv_id") % 3).cast("string")).alias("dataset"), (F.col("user_messages") + (F.col("conv_id") % 5 == 0).cast("int")).alias("num_turns"), cell.alias("conversation"))
    return profile.key_mismatches(rows, "num_turns", "conversation", by="dataset")


@query(f"""WITH {MESSAGES}, s AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY conv_id) AS place FROM (SELECT *, ntile(4) OVER (ORDER BY conv_id) AS shard FROM (SELECT DISTINCT conv_id FROM conversations))),
f AS (SELECT conv.*, nu + CAST(conv_id % 3 = 0 AS INT) AS turn FROM s JOIN conv USING (conv_id) WHERE place <= 5), t AS (SELECT count(*) AS total, min(turn) AS low, max(turn) AS high, avg(turn) AS mean, count(*) FILTER (turn = 1) AS one FROM f)
SELECT 'wild' AS dataset, 'first rows of each shard' AS scope, 'sampled' AS status, 'https://example.org/wild' AS source, total, low AS min, high AS max, mean, one AS one_turn, (SELECT count(*) FROM f WHERE turn <> nu) AS turn_mismatch, (SELECT count(*) FROM f WHERE nu <> na) AS role_mismatch FROM t""")
def a04_sample_summary(spark, sf):
    """The first rows of each shard, validated and summed up as a row of the report."""
    rows = releases.sampled_shards(spark, sf, 5)
    found = profile.described(profile.turn_summary(rows, "turn"), profile.validation(rows, "turn"), dataset="wild", scope="first rows of each shard", status="sampled", source="https://example.org/wild")
    return found.select("dataset", "scope", "status", "source", "total", "min", "max", "mean", "one_turn", *(F.element_at("validation", c).alias(c) for c in ("turn_mismatch", "role_mismatch")))


@query(f"""WITH {MESSAGES}, h AS (SELECT nu AS n_turns, count(*) AS n FROM conv GROUP BY nu), t AS (SELECT max(n_turns) AS top, sum(n) AS total FROM h)
SELECT i AS n_turns, coalesce(n, 0) AS conversations, coalesce(n, 0) / total AS share FROM t, range(1, (SELECT max(n_turns) FROM h) + 1) r(i) LEFT JOIN h ON n_turns = i""")
def w05_dense_distribution(spark, sf):
    return profile.dense_distribution(profile.turn_histogram(fx.corpus(spark, sf), "user_messages"))


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(length(text) - length(replace(text, 'th', 'h')) AS BIGINT) END AS questions, CASE WHEN text IS NOT NULL THEN CAST(length(text) - length(replace(text, 'en', 'n')) AS BIGINT) END AS answers FROM documents""")
def p22_serialized_counts(spark, sf):
    """Cells with a key of each kind, and one that only looks like it, for certain letters of a text."""
    cell = F.replace(F.replace("text", F.lit("th"), F.lit("""'user_question' : "user_question" """)), F.lit("en"), F.lit("""{"AI_response": AI_response: """))
    return profile.serialized_counts(fx.table(spark, sf, "documents").select("doc_id", cell.alias("cell")), "cell").select("doc_id", "questions", "answers")


# ---- corpus ----


@query(f"""WITH {MESSAGES} SELECT id, least(nu, na) AS exchanges, nu AS user_messages, na AS assistant_messages, n AS message_turns, ch AS characters FROM conv WHERE nu >= 2 AND na >= 2""")
def f02_long_corpus(spark, sf):
    found = co.qualifying(fx.corpus(spark, sf), 2)
    return found.select("id", "exchanges", "user_messages", "assistant_messages", "message_turns", "characters")


@query("SELECT doc_id, substr(sha256(source || chr(0) || doc_id::VARCHAR), 1, 24) AS id FROM documents")
def p07_stable_id(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", stable_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


#: Texts with a control character for each ``th``, and for each ``en`` what looks like one escaped.
CONTROLLED = """replace(replace(to_json(text), 'th', '\\u000b\\u001f'), 'en', '\\\\u001F')"""


@query(f"WITH {MESSAGES} SELECT conv_id, sha256('[' || string_agg('{{\"role\":\"' || role || '\",\"content\":' || {CONTROLLED} || '}}', ',' ORDER BY turn) || ']') AS hash FROM m GROUP BY conv_id")
def p08_transcript_hash(spark, sf):
    return co.with_hash(fx.controlled(fx.corpus(spark, sf))).select("conv_id", "hash")


@query(f"""WITH {DOCUMENTS} SELECT dataset, count(*) AS conversations, CAST(sum(characters) AS BIGINT) AS characters, max(characters) AS max_characters FROM docs GROUP BY ROLLUP (dataset)""")
def a05_manifest(spark, sf):
    return co.manifest(fx.documents(spark, sf))


STATUS = f"""WITH {DOCUMENTS}, first AS (SELECT hash, min(doc_id) AS first FROM docs WHERE NOT is_base GROUP BY hash), known AS (SELECT DISTINCT hash FROM docs WHERE is_base),
status AS (SELECT doc_id, dataset, CASE WHEN is_base THEN 'base' WHEN k.hash IS NOT NULL THEN 'base_dup' WHEN doc_id = f.first THEN 'included' ELSE 'expansion_dup' END AS status
  FROM docs d LEFT JOIN known k ON d.hash = k.hash LEFT JOIN first f ON d.hash = f.hash)"""


def _statuses(spark, sf):
    docs = fx.documents(spark, sf)
    return co.dedup_status(docs.where("is_base"), docs.where("NOT is_base"), order=["doc_id"])


@query(STATUS + " SELECT doc_id, status FROM status")
def t03_exact_dedup(spark, sf):
    return _statuses(spark, sf).select("doc_id", "status")


@query(STATUS + " SELECT doc_id FROM status WHERE status IN ('base', 'included')")
def t02_expanded_corpus(spark, sf):
    docs = fx.documents(spark, sf)
    return co.expand(docs.where("is_base"), docs.where("NOT is_base"), order=["doc_id"]).select("doc_id")


@query(STATUS + """ SELECT dataset, count(*) AS qualifying, count(*) FILTER (status = 'base_dup') AS base_dup, count(*) FILTER (status = 'expansion_dup') AS expansion_dup,
  count(*) FILTER (status = 'included') AS included FROM status WHERE status <> 'base' GROUP BY dataset""")
def a06_expansion_manifest(spark, sf):
    return co.expansion_manifest(_statuses(spark, sf))


@query(f"""WITH {MESSAGES}, old AS (SELECT * FROM conv WHERE conv_id % 2 = 0), long AS (SELECT * FROM conv WHERE conv_id % 7 <> 0 AND nu + conv_id % 2 >= 3), good AS (SELECT * FROM long WHERE nu >= 3 AND na >= 3),
k AS (SELECT g.*, conv_id IN (SELECT conv_id FROM old) AS s, hash IN (SELECT hash FROM old) AS t FROM good g)
SELECT (SELECT count(*) FROM conv) AS rows, (SELECT count(*) FROM old) AS existing_rows, (SELECT count(DISTINCT conv_id) FROM old) AS existing_sources, (SELECT count(DISTINCT hash) FROM old) AS existing_transcripts,
  count(*) AS qualifying, count(*) FILTER (s) AS source_overlap, count(*) FILTER (NOT s) AS source_new, count(*) FILTER (t) AS transcript_overlap, count(*) FILTER (NOT t) AS transcript_new,
  count(*) FILTER (s AND t) AS both_overlap, count(DISTINCT conv_id) AS distinct_sources, count(DISTINCT hash) AS distinct_transcripts, count(DISTINCT conv_id) FILTER (NOT s) AS new_sources, count(DISTINCT hash) FILTER (NOT t) AS new_transcripts,
  count(*) - count(DISTINCT conv_id) AS repeated_sources, count(*) - count(DISTINCT hash) AS repeated_transcripts, (SELECT count(*) FROM conv) - count(*) AS not_qualifying, (SELECT count(*) FROM long) - count(*) AS long_not_qualifying FROM k""")
def a08_overlap_report(spark, sf):
    """The release says a turn more than there is for every other conversation, and nothing for each seventh."""
    rows = co.with_hash(fx.corpus(spark, sf)).withColumn("turn", F.when(F.col("conv_id") % 7 != 0, F.col("user_messages") + F.col("conv_id") % 2))
    return overlap_report(rows.where("conv_id % 2 = 0"), rows, min_per_role=3, turns="turn")


RUNS = """WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM s)"""


@query(RUNS + " SELECT event_id, run FROM r")
def w02_contiguous_runs(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("part", F.expr("event_id div 1000"))
    return co.runs(events, key="event_type", order="event_id", part="part", within=["user_id"]).select("event_id", "run")


@query(RUNS + """, g AS (SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY run) AS occurrence FROM g)
SELECT user_id, run, n AS rows, CASE WHEN occurrence = 1 THEN event_type ELSE event_type || '#occurrence=' || occurrence END AS run_key FROM o""")
def w03_occurrences(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("part", F.expr("event_id div 1000"))
    stretches = co.runs(events, key="event_type", order="event_id", part="part", within=["user_id"])
    return co.run_keys(stretches, key="event_type", part="part", within=["user_id"]).select("user_id", "run", "rows", "run_key")


# ---- scheduling and text ----


@query(f"WITH {DOCUMENTS} SELECT doc_id, row_number() OVER (ORDER BY coalesce(characters, 0) DESC, dataset, doc_id) AS rank FROM docs")
def o01_longest_first(spark, sf):
    return audit.longest_first_rank(fx.documents(spark, sf).withColumnRenamed("doc_id", "id")).select(F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {MESSAGES}, f AS (SELECT * FROM conv ORDER BY conv_id LIMIT 40) SELECT conv_id, ch AS characters FROM f")
def o03_limit_before_sort(spark, sf):
    return audit.schedule(fx.corpus(spark, sf), limit=40, source_order="conv_id").select("conv_id", "characters")


@query(f"""WITH {MESSAGES} SELECT count(*) AS records, coalesce(min(ch), 0) AS min, CAST(coalesce(round_even(median(ch), 0), 0) AS BIGINT) AS median, coalesce(max(ch), 0) AS max FROM conv WHERE conv_id % 3 <> 0""")
def a10_pending_stats(spark, sf):
    rows = fx.corpus(spark, sf)
    return audit.pending_stats(audit.pending(rows, rows.where("conv_id % 3 = 0")))


@query(f"WITH {MESSAGES} SELECT id FROM conv WHERE conv_id % 3 <> 0")
def j01_resume_pending(spark, sf):
    rows = fx.corpus(spark, sf)
    return audit.pending(rows, rows.where("conv_id % 3 = 0")).select("id")


@query(f"WITH {MESSAGES} SELECT conv_id, pos, label FROM lab")
def w01_turn_labels(spark, sf):
    return fx.corpus(spark, sf).select("conv_id", F.posexplode(turn_labels(F.col("messages"))).alias("pos", "label")).withColumn("pos", F.col("pos").cast("long"))


SEGMENTS = """, cut AS (SELECT conv_id, turn, label, text, greatest(1, (length(text) + 335) // 336) AS parts FROM lab),
seg AS (SELECT conv_id, turn, i, '[' || label || CASE WHEN parts > 1 THEN ' part ' || (i + 1) || '/' || parts ELSE '' END || '] ' || substr(text, i * 336 + 1, 336) AS segment FROM cut, range(0, 200) t(i) WHERE i < parts)"""


@query(f"WITH {MESSAGES}{SEGMENTS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS place, segment FROM seg")
def p14_segments(spark, sf):
    found = fx.corpus(spark, sf).select("conv_id", F.posexplode(tx.segments(F.col("messages"), 400)).alias("place", "segment"))
    return found.withColumn("place", F.col("place").cast("long"))


@query(f"""WITH RECURSIVE {MESSAGES}{SEGMENTS}, num AS (SELECT conv_id, segment, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS k FROM seg),
walk AS (SELECT conv_id, k, 0 AS chunk, segment AS body FROM num WHERE k = 1 UNION ALL
  SELECT n.conv_id, n.k, CASE WHEN length(w.body) + 2 + length(n.segment) > 2500 THEN w.chunk + 1 ELSE w.chunk END,
    CASE WHEN length(w.body) + 2 + length(n.segment) > 2500 THEN n.segment ELSE w.body || chr(10) || chr(10) || n.segment END FROM walk w JOIN num n ON n.conv_id = w.conv_id AND n.k = w.k + 1)
SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, arg_max(body, k) AS text FROM walk GROUP BY conv_id, chunk""")
def c01_greedy_chunks(spark, sf):
    chunks = tx.greedy_chunks(tx.segments(F.col("messages"), 400), 2500)
    return fx.corpus(spark, sf).select("conv_id", F.posexplode(chunks).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


@query(f"""WITH RECURSIVE {MESSAGES}, num AS (SELECT conv_id, pos, length(text) AS n FROM m),
walk AS (SELECT conv_id, pos, 0 AS batch, 1 AS items, n AS held FROM num WHERE pos = 0 UNION ALL
  SELECT n.conv_id, n.pos, CASE WHEN w.items >= 3 OR w.held + n.n > 1500 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.items >= 3 OR w.held + n.n > 1500 THEN 1 ELSE w.items + 1 END,
    CASE WHEN w.items >= 3 OR w.held + n.n > 1500 THEN n.n ELSE w.held + n.n END FROM walk w JOIN num n ON n.conv_id = w.conv_id AND n.pos = w.pos + 1)
SELECT conv_id, pos, batch FROM walk""")
def c04_batches(spark, sf):
    numbers = tx.batch_numbers(F.transform("messages", lambda m: F.length(m["content"])), max_items=3, max_characters=1500)
    return fx.corpus(spark, sf).select("conv_id", F.posexplode(numbers).alias("pos", "batch")).withColumn("pos", F.col("pos").cast("long"))


SCREENED = """screen AS (SELECT conv_id, string_agg('[' || label || '] ' || CASE WHEN role = 'user' AND length(text) > 200 THEN substr(text, 1, 82) || ' […omitted…] ' || right(text, 82)
  WHEN role = 'assistant' AND length(text) > 150 THEN substr(text, 1, 57) || ' […omitted…] ' || right(text, 57) ELSE text END, chr(10) ORDER BY turn) AS transcript,
  CAST(count(*) FILTER (length(text) > CASE role WHEN 'user' THEN 200 ELSE 150 END) AS INTEGER) AS truncated FROM lab GROUP BY conv_id)"""


@query(f"""WITH RECURSIVE {MESSAGES}, {SCREENED}, num AS (SELECT conv_id, length(transcript) AS n, row_number() OVER (ORDER BY conv_id) AS k FROM screen),
walk AS (SELECT conv_id, k, 0 AS batch, 1 AS items, n AS held FROM num WHERE k = 1 UNION ALL
  SELECT n.conv_id, n.k, CASE WHEN items >= 8 OR held + n.n > 6000 THEN batch + 1 ELSE batch END, CASE WHEN items >= 8 OR held + n.n > 6000 THEN 1 ELSE items + 1 END,
    CASE WHEN items >= 8 OR held + n.n > 6000 THEN n.n ELSE held + n.n END FROM walk w JOIN num n ON n.k = w.k + 1)
SELECT conv_id, batch FROM walk""")
def c03_pack_batches(spark, sf):
    """Batches of transcripts as they are rendered, elided."""
    rows = fx.corpus(spark, sf).withColumn("n", F.length(legacy.screened(F.col("messages"), user=200, assistant=150)))
    return legacy.pack_batches(rows, key="conv_id", position="conv_id", length="n", max_characters=6_000).select("conv_id", "batch")


@query("""WITH RECURSIVE r AS (SELECT doc_id, 0 AS part, CAST(NULL AS VARCHAR) AS piece, text AS rest FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT doc_id, part + 1, CASE WHEN length(rest) > 1000 THEN substr(rest, 1, cut) ELSE rest END, CASE WHEN length(rest) > 1000 THEN substr(rest, cut + 1) END FROM (
    SELECT *, CASE WHEN line >= 500 THEN line WHEN space >= 500 THEN space ELSE 1000 END AS cut FROM (
      SELECT *, CASE WHEN contains(substr(rest, 1, 1000), chr(10)) THEN least(1000, length(rest)) - instr(reverse(substr(rest, 1, 1000)), chr(10)) ELSE -1 END AS line,
        CASE WHEN contains(substr(rest, 1, 1000), ' ') THEN least(1000, length(rest)) - instr(reverse(substr(rest, 1, 1000)), ' ') ELSE -1 END AS space FROM r WHERE rest IS NOT NULL)))
SELECT doc_id, part - 1 AS part, piece FROM r WHERE part > 0""")
def p18_soft_pieces(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.posexplode(tx.soft_pieces(F.col("text"), 1000)).alias("part", "piece"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 82) || ' […omitted…] ' || right(text, 82) ELSE text END AS short,
  CASE WHEN length(text) > 3000 THEN substr(text, 1, 1460) || chr(10) || '[…message middle omitted…]' || chr(10) || right(text, 1460) ELSE text END AS cut FROM documents""")
def p16_elide(spark, sf):
    cut = tx.elide(F.col("text"), 3_000, 80, "\n[…message middle omitted…]\n")
    return fx.table(spark, sf, "documents").select("doc_id", tx.elide(F.col("text"), 200).alias("short"), cut.alias("cut"))


@query(f"WITH {MESSAGES}, {SCREENED} SELECT conv_id, transcript, truncated FROM screen")
def p38_screened(spark, sf):
    limits = {"user": 200, "assistant": 150}
    return fx.corpus(spark, sf).select("conv_id", legacy.screened(F.col("messages"), **limits).alias("transcript"), legacy.truncated_count(F.col("messages"), **limits).alias("truncated"))


@query(f"""WITH {MESSAGES} SELECT conv_id, string_agg('[' || label || '] ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 60) || chr(10) || '[…message middle omitted…]' || chr(10) || right(text, 60) ELSE text END, chr(10) || chr(10) ORDER BY turn) AS said,
  CAST(count(*) FILTER (length(text) > 200) AS INTEGER) AS truncated FROM lab GROUP BY conv_id""")
def p38_exchanges(spark, sf):
    said = F.array_join(legacy.exchanges(F.col("messages"), limit=200), "\n\n")
    return fx.corpus(spark, sf).select("conv_id", said.alias("said"), legacy.truncated_count(F.col("messages"), user=200, assistant=200).alias("truncated"))


@query(f"""WITH {MESSAGES}, roles AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS said FROM m GROUP BY conv_id)
SELECT conv_id, said = coalesce(substr(repeat(',user,assistant', nu), 2), '') AS alternates FROM conv JOIN roles USING (conv_id)""")
def p23_alternation(spark, sf):
    return fx.corpus(spark, sf).select("conv_id", alternates(F.col("messages")).alias("alternates"))


@query("""SELECT doc_id, lower(trim(coalesce(lang, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(28) || chr(160) || chr(8195))) IN ('english', 'unknown', '') AS english FROM
(SELECT doc_id, CASE lang WHEN 'en' THEN ' ' || chr(9) || 'English' || chr(10) WHEN 'de' THEN chr(160) || 'Unknown' || chr(8195) || chr(28) WHEN 'fr' THEN chr(13) || 'fr' ELSE lang END AS lang FROM documents)""")
def p29_english_labels(spark, sf):
    lang = F.col("lang")
    label = F.when(lang == "en", " \tEnglish\n").when(lang == "de", "\xa0Unknown\u2003\x1c").when(lang == "fr", "\rfr").otherwise(lang)
    return fx.table(spark, sf, "documents").select("doc_id", tx.is_english_label(label).alias("english"))


TURN = r"\b[UA]\d+(?:[–-][UA]?\d+)?(?:\s*(?:,|and)\s*[UA]\d+(?:[–-][UA]?\d+)?)?"


@query(f"""WITH t AS (SELECT conv_id, turn, 'At U' || (turn + 1) || CASE WHEN turn % 2 = 0 THEN ' and A' || turn ELSE ' then A2-A' || (turn + 3) END || ', again U' || (turn + 1) || '.' AS body FROM conversations WHERE turn % 3 <> 2
  UNION ALL SELECT conv_id, turn, 'nothing' FROM conversations WHERE turn % 3 = 2), f AS (SELECT *, regexp_extract_all(body, '{TURN}') AS found FROM t)
SELECT conv_id, turn, CASE WHEN len(found) = 0 THEN 'not directly evidenced' ELSE array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ', ') END AS turns FROM f""")
def p24_turn_references(spark, sf):
    t = F.col("turn")
    body = F.when(t % 3 == 2, "nothing").otherwise(F.concat(F.lit("At U"), (t + 1).cast("string"), F.when(t % 2 == 0, F.concat(F.lit(" and A"), t.cast("string"))).otherwise(F.concat(F.lit(" then A2-A"), (t + 3).cast("string"))), F.lit(", again U"), (t + 1).cast("string"), F.lit(".")))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", tx.turn_references(body).alias("turns"))


RESULT = r"^(\d+)\|(yes|no|uncertain)\|(none|potential|clear)\|(yes|maybe|no)$"


@query(f"""WITH x AS (SELECT doc_id, unnest([chr(9) || doc_id || '|yes|none|maybe' || chr(160), doc_id || '|no|clearly|no', substr(coalesce(text, ''), 1, 40), (doc_id + 1) || '|uncertain|clear|no ', doc_id || '|no|none|yes']) AS line, unnest([0, 1, 2, 3, 4]) AS k FROM documents),
y AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS t FROM x WHERE doc_id % 4 <> k), z AS (SELECT * FROM y WHERE regexp_full_match(t, '{RESULT[1:-1]}'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, CAST(regexp_extract(t, '{RESULT}', 1) AS INTEGER) AS "index", regexp_extract(t, '{RESULT}', 2) AS c, regexp_extract(t, '{RESULT}', 3) AS r, regexp_extract(t, '{RESULT}', 4) AS q FROM z""")
def p26_result_lines(spark, sf):
    """Answers with a tab before a line and a no-break space after it, lines that end in other ways, and prose between."""
    d = F.col("doc_id").cast("string")
    lines = F.array(F.concat(F.lit("\t"), d, F.lit("|yes|none|maybe\xa0")), F.concat(d, F.lit("|no|clearly|no\r")), F.substring(F.coalesce("text", F.lit("")), 1, 40), F.concat((F.col("doc_id") + 1).cast("string"), F.lit("|uncertain|clear|no \u2028")), F.concat(d, F.lit("|no|none|yes")))
    answer = F.array_join(F.filter(lines, lambda x, i: F.col("doc_id") % 4 != i), "\n")
    found = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(tx.result_lines(answer)).alias("place", "x"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), "x.*")


# ---- audit and review ----


def quoted(text: str) -> str:
    return text.replace("'", "''")


@query(f"WITH {AUDITED} SELECT conv_id, label, level, CASE WHEN level > 0 THEN g ELSE 'none' END AS locus, CASE WHEN label <> 'none' AND q = 'no' THEN 'maybe' ELSE q END AS review, (label <> r OR (label <> 'none' AND q = 'no')) AS adjusted FROM audited")
def n07_audit_labels(spark, sf):
    return fx.audited(spark, sf).select("conv_id", "label", F.col("level").cast("long").alias("level"), "locus", "review", "adjusted")


@query(f"""WITH {AUDITED} SELECT conv_id, CASE WHEN ext THEN he END AS ev_externalization, CASE WHEN refl THEN ae END AS ev_ai_reflection, CASE WHEN upt THEN ue END AS ev_user_uptake, CASE WHEN re THEN xe END AS ev_recursive_reentry,
  CASE WHEN label = 'clear' THEN he || ',' || ae || ',' || ue || ',' || xe ELSE '' END AS chain, del AS delegation, z AS artifact_recursion,
  (c <> 'no' OR e OR a OR u OR x OR d OR z OR r <> 'none' OR q <> 'no') AS positive FROM audited""")
def n10_evidence(spark, sf):
    return fx.audited(spark, sf).select("conv_id", *(f"ev_{s}" for s in audit.STAGES), F.array_join("clear_chain", ",").alias("chain"), "delegation", "artifact_recursion", "positive")


@query(f"WITH {AUDITED} SELECT label, level, count(*) AS n FROM audited GROUP BY ROLLUP (label, level)")
def a13_label_levels(spark, sf):
    return report.label_levels(fx.audited(spark, sf)).withColumn("level", F.col("level").cast("long"))


@query(f"""WITH {AUDITED}, names(level, level_name) AS (VALUES (0, 'instrumental_task'), (1, 'capability_extension'), (2, 'project_possession_extension'), (3, 'representational_extension'), (4, 'reflexive_extension'), (5, 'enacted_extension'))
SELECT names.level, level_name, count(audited.level) AS n FROM names LEFT JOIN audited ON names.level = audited.level AND label = 'clear' GROUP BY ALL""")
def a17_level_counts(spark, sf):
    return report.level_counts(fx.audited(spark, sf).where("label = 'clear'"))


def _by_third(rows):
    return rows.withColumn("dataset", F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")))


@query(f"""WITH {AUDITED}, part AS (SELECT *, 'd' || (conv_id % 3) AS dataset, conv_id % 5 <> 4 AS seen FROM audited), cand AS (SELECT * FROM part WHERE seen AND label <> 'none')
SELECT dataset, count(*) + 7 AS raw, count(*) AS included, 7 AS excluded, count(*) FILTER (seen) AS audited, count(*) FILTER (NOT seen) AS not_audited,
  count(*) FILTER (seen AND label = 'none') AS none, count(*) FILTER (seen AND label = 'potential') AS potential, count(*) FILTER (seen AND label = 'clear') AS clear,
  count(*) FILTER (seen AND label <> 'none') AS candidates, count(*) FILTER (seen AND label <> 'none' AND conv_id % 4 <> 3) AS reviewed, count(*) FILTER (seen AND label <> 'none' AND conv_id % 4 = 3) AS pending FROM part GROUP BY dataset""")
def a14_funnel(spark, sf):
    rows = _by_third(fx.audited(spark, sf))
    raw = rows.groupBy("dataset").agg((F.count(F.lit(1)) + 7).alias("rows"))
    return report.funnel(raw, rows, rows.where("conv_id % 5 <> 4"), fx.reviewed(rows))


@query(f"WITH {AUDITED} SELECT id FROM audited WHERE label <> 'none' AND conv_id % 4 = 3")
def t04_unreviewed(spark, sf):
    rows = fx.audited(spark, sf)
    return rows.where(F.col("label").isin(*audit.CANDIDATES)).select("id").join(fx.reviewed(rows).select("id"), "id", "left_anti")


@query(f"WITH {AUDITED} SELECT r.id, r.label, r.level FROM reviewed r JOIN audited a ON r.id = a.id WHERE a.label <> 'none'")
def j05_manual_candidates(spark, sf):
    rows = fx.audited(spark, sf)
    return review.manual_candidates(fx.reviewed(rows), rows).select("id", "label", F.col("level").cast("long").alias("level"))


@query(f"""WITH {AUDITED}, dec AS (SELECT id AS conversation_id, conv_id, label, CASE WHEN conv_id % 6 = 2 THEN 2 ELSE level END AS level FROM reviewed WHERE conv_id % 5 <> 1), waiting AS (SELECT id AS conversation_id FROM audited WHERE conv_id % 3 = 0), done AS (SELECT id AS conversation_id FROM audited WHERE conv_id % 20 = 2)
SELECT conversation_id, 'unexpected' AS problem FROM dec WHERE conversation_id NOT IN (SELECT conversation_id FROM waiting)
UNION ALL SELECT conversation_id, 'missing' FROM waiting WHERE conversation_id NOT IN (SELECT conversation_id FROM dec)
UNION ALL SELECT conversation_id, 'decided already' FROM dec WHERE conversation_id IN (SELECT conversation_id FROM done)
UNION ALL SELECT conversation_id, 'invalid' FROM dec WHERE (label = 'clear' AND level < 3) OR (label = 'none' AND level <> 0)""")
def j06_decision_problems(spark, sf):
    rows = fx.audited(spark, sf)
    made = fx.reviewed(rows).where("conv_id % 5 <> 1").withColumn("level", F.when(F.col("conv_id") % 6 == 2, 2).otherwise(F.col("level"))).withColumnRenamed("id", "conversation_id")
    named = lambda test: rows.where(test).select(F.col("id").alias("conversation_id"))
    return review.decision_problems(made, named("conv_id % 3 = 0"), named("conv_id % 20 = 2"))


@query(f"""WITH {AUDITED} SELECT r.id AS conversation_id, a.label AS automated_label, r.label AS manual_label, r.level, (['instrumental_task', 'capability_extension', 'project_possession_extension', 'representational_extension', 'reflexive_extension', 'enacted_extension'])[r.level + 1] AS level_name,
  (['none', 'capability', 'owned_project', 'self_representation', 'self_understanding', 'possible_self_enactment'])[r.level + 1] AS locus, CASE WHEN r.label = 'clear' OR r.level >= 3 THEN 'high' ELSE 'medium' END AS priority,
  CASE WHEN r.conv_id % 2 = 0 THEN 'moderate' ELSE 'high' END AS confidence, CASE WHEN r.conv_id % 3 = 0 THEN 'U1' ELSE 'not directly evidenced' END AS turn,
  '{quoted("|".join(review.REASONS))}|' || CASE r.label WHEN 'clear' THEN '{quoted(review.CONCLUSIONS["clear"])}' WHEN 'potential' THEN '{quoted(review.CONCLUSIONS["potential"])}' ELSE '{quoted(review.CONCLUSIONS["none"])}' END AS reasons,
  '{quoted("|".join((review.BOUNDARY % 100, *review.COMMENTS)))}|the end of ' || r.conv_id AS comments, r.conv_id AS audit_line, 'corpus.jsonl.gz' AS corpus_file, 'audit.jsonl' AS audit_file, true AS consumption FROM reviewed r JOIN audited a ON r.id = a.id""")
def p27_canonical(spark, sf):
    rows = fx.audited(spark, sf)
    made = fx.reviewed(rows).withColumnRenamed("id", "conversation_id")
    said = F.when(F.col("conv_id") % 3 == 0, "The user says so in U1.").otherwise("Nothing said.")
    made = made.withColumns({"confidence": F.when(F.col("conv_id") % 2 == 0, "medium").otherwise("high"), "context": F.lit("other"), "summary": F.lit(""), "boundary": F.concat(F.lit("the end of "), F.col("conv_id").cast("string")), **{s: said for s in audit.STAGES}})
    found = review.canonicalize(made, rows.withColumn("audit_line", F.col("conv_id")), 100, corpus_file="corpus.jsonl.gz", audit_file="audit.jsonl")
    return found.select(
        "conversation_id", "automated_label", "manual_label", F.col("level").cast("long").alias("level"), "level_name", "locus", "priority", "confidence", F.col("externalization.turn").alias("turn"),
        F.array_join("reasons", "|").alias("reasons"), F.array_join("comments", "|").alias("comments"), "audit_line", "corpus_file", "audit_file", F.col("consumption_related").alias("consumption"),
    )


@query("""WITH p AS (SELECT doc_id % 97 AS id, doc_id AS chunk, CASE (quality + 2 * toxic + doc_id) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'potential' ELSE 'clear' END AS label, (doc_id % 7) / 10 AS confidence FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_position(['none', 'potential', 'clear'], label) DESC, confidence DESC, chunk) AS k FROM p) SELECT id, chunk, label, confidence FROM r WHERE k = 1""")
def a11_ordinal_argmax(spark, sf):
    rows = fx.table(spark, sf, "labels")
    n = (F.col("quality") + 2 * F.col("toxic") + F.col("doc_id")) % 3
    parts = rows.select((F.col("doc_id") % 97).alias("id"), F.col("doc_id").alias("chunk"), F.when(n == 0, "none").when(n == 1, "potential").otherwise("clear").alias("label"), ((F.col("doc_id") % 7) / 10).alias("confidence"))
    return legacy.ordinal_argmax(parts, "id", "extension", label="label")


# ---- translation, caches, files ----


@query(f"""WITH {AUDITED} SELECT conv_id, level, row_number() OVER (ORDER BY level DESC, ch DESC, id) AS place FROM audited WHERE label <> 'none' AND level IN (3, 4, 5) AND conv_id % 3 <> 0""")
def o04_targets(spark, sf):
    return fx.targets(spark, sf).select("conv_id", F.col("level").cast("long").alias("level"), F.col("place").cast("long").alias("place"))


@query(f"WITH {MESSAGES} SELECT conv_id, string_agg(CASE WHEN length(text) % 3 = 0 THEN text ELSE translate(text, 'e', '#') END, '|' ORDER BY turn) AS text FROM m GROUP BY conv_id")
def j13_reassemble(spark, sf):
    """A third of the messages passes through as it is."""
    parts = translate.pieces(fx.corpus(spark, sf), key="conv_id", limit=200, passthrough=F.length("content") % 3 == 0)
    done = parts.where("NOT passthrough").select("conv_id", "message_index", "part_index", F.translate("text", "e", "#").alias("translation"))
    return translate.reassemble(parts, done, key="conv_id").select("conv_id", F.array_join("translations", "|").alias("text"))


@query(f"""WITH {MESSAGES} SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'hash' WHEN conv_id % 5 = 1 THEN 'count' WHEN conv_id % 5 = 2 THEN 'unfaithful' WHEN conv_id % 5 = 3 THEN 'unfaithful' END AS fault FROM conv""")
def f13_translation_faults(spark, sf):
    rows = co.with_hash(fx.corpus(spark, sf))
    c, own = F.col("conv_id"), F.transform("messages", lambda m: m["content"])
    echo, long_ = F.transform("messages", lambda m: F.lit('{"turn": 1')), F.transform("messages", lambda m: F.repeat(F.concat(m["content"], F.lit(" " * 40)), 8))
    records = rows.select("conv_id", F.when(c % 5 == 0, "other").otherwise(F.col("hash")).alias("source_sha256"), F.when(c % 5 == 1, F.slice(own, 2, 1000)).when(c % 5 == 2, echo).when(c % 5 == 3, long_).otherwise(own).alias("translations"))
    return translate.faults(rows, records, key="conv_id")


@query(f"""WITH {AUDITED} SELECT conv_id, sha256('{{"conversation":"' || id || '","format_version":3,"review":' || CASE WHEN conv_id % 4 <> 3 THEN '"' || label || '"' ELSE 'null' END || '}}') AS fp FROM audited""")
def p35_fingerprint(spark, sf):
    rows = fx.audited(spark, sf)
    fp = fingerprint.fingerprint(format_version=F.lit(3), conversation=F.col("id"), review=F.when(F.col("conv_id") % 4 != 3, F.col("label")))
    return rows.select("conv_id", fp.alias("fp"))


@query(f"""WITH {MESSAGES} SELECT id, CASE WHEN conv_id % 4 = 0 THEN 'hit' ELSE 'miss' END AS status FROM conv""")
def n14_fragment_status(spark, sf):
    rows = co.with_hash(fx.corpus(spark, sf)).withColumnRenamed("hash", "fingerprint")
    c = F.col("conv_id")
    cached = rows.where(c % 4 != 3).select("id", F.when(c % 4 == 1, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(2).alias("version"), F.when(c % 4 == 2, "").otherwise("body").alias("body"))
    return fingerprint.fragment_status(rows, cached, 2)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 <> 0 THEN 'appended' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'kept' WHEN doc_id % 5 = 0 THEN 'rewritten' ELSE 'unchanged' END AS status FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0""")
def k08_upsert_status(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("value"))
    incoming = docs.where("id % 3 <> 0").withColumn("value", F.when(F.col("id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return fingerprint.upsert_status(docs.where("id % 2 = 0"), incoming)


@query(f"WITH {DOCUMENTS} SELECT dataset, count(*) AS files, CAST(sum(characters) AS BIGINT) AS bytes FROM docs GROUP BY dataset")
def a18_inventory(spark, sf):
    from skeinworks.sources.inventory import totals

    return totals(fx.documents(spark, sf).select("dataset", F.col("hash").alias("file"), F.col("characters").alias("bytes")))
