"""Ledgers, caches, runs of a model, reviews and reports: inputs are written to the shared folder where files are the point; models are deterministic doubles."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import text as tx
from skeinworks.functions.messages import compact_json
from skeinworks.operators import audit, fingerprint, inference, legacy, report, review, translate
from skeinworks.operators import corpus as co
from skeinworks.plans import fixtures as fx
from skeinworks.plans.fixtures import AUDITED, MESSAGES
from skeinworks.plans.registry import query
from skeinworks.sources import buckets, files, inventory, ledger, versions
from skeinworks.streaming import assess, resume

# ---- ledgers ----


def _lines(spark: SparkSession, sf: str, line: Column, *, end: str = " ", shards: int = 1) -> str:
    """A folder of ``shards`` ledgers with a line for each conversation in order, by conv_id and ``ch``; ``end`` follows the last newline."""
    path = fx.scratch(spark, "ledger")
    rows = fx.corpus(spark, sf).select("conv_id", line.alias("line"), (F.col("conv_id") % shards).alias("shard"))
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    # The text writer ends each row: ``end`` stands for what a broken write left
    rows.groupBy("shard").agg(body.alias("value")).repartition(shards, "shard").write.partitionBy("shard").option("lineSep", end).text(path)
    return path


def _entry(c: str = "conv_id") -> Column:
    return F.format_string('{"id":"c%s","n":%s}', F.col(c).cast("string"), F.col(c).cast("string"))


def _broken(test: Column) -> Column:
    return F.when(test, F.concat(F.lit('{"id":"c'), F.col("conv_id").cast("string"))).otherwise(_entry())


def _refused(read) -> bool:
    try:
        read().collect()
    except Exception:  # whichever way Spark wraps it
        return True
    return False


@query("SELECT DISTINCT 'c' || conv_id AS id FROM conversations WHERE conv_id % 7 <> 0")
def s16_completed_ids(spark, sf):
    return ledger.completed_ids(spark, _lines(spark, sf, _broken(F.col("conv_id") % 7 == 0)))


@query(f"""WITH {MESSAGES} SELECT 'c' || conv_id AS id, conv_id AS n, row_number() OVER (ORDER BY conv_id) - 1 AS line_no, true AS broken_refused, true AS missing_refused FROM conv QUALIFY conv_id % 5 <> 0""")
def s17_strict_ledger(spark, sf):
    found = ledger.strict(spark, _lines(spark, sf, F.when(F.col("conv_id") % 5 == 0, "").otherwise(_entry())), "id string, n long")
    broken = _refused(lambda: ledger.strict(spark, _lines(spark, sf, _broken(F.col("conv_id") % 7 == 0)), "id string"))
    missing = _refused(lambda: ledger.strict(spark, fx.scratch(spark, "none"), "id string"))
    return found.select("id", "n", F.col("line_no").cast("long").alias("line_no"), F.lit(broken).alias("broken_refused"), F.lit(missing).alias("missing_refused"))


@query(f"""WITH {MESSAGES}, l AS (SELECT conv_id % 2 AS shard, conv_id, row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id) - 1 AS line_no FROM conv)
SELECT shard, 'c' || conv_id AS id, conv_id AS n, line_no, true AS broken_refused, 0 AS missing_rows FROM l""")
def s18_tolerant_ledger(spark, sf):
    """Two ledgers whose last line was being written; a line broken in the middle, and none at all."""
    found = ledger.tolerant(spark, _lines(spark, sf, _entry(), end='{"id":', shards=2), "id string, n long")
    broken = _refused(lambda: ledger.tolerant(spark, _lines(spark, sf, _broken(F.col("conv_id") == 10)), "id string"))
    missing = ledger.tolerant(spark, fx.scratch(spark, "none"), "id string").count()
    return found.select(F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long").alias("shard"), "id", "n", F.col("line_no").cast("long").alias("line_no"), F.lit(broken).alias("broken_refused"), F.lit(missing).alias("missing_rows"))


@query(f"""WITH {MESSAGES} SELECT 'c' || conv_id AS id, conv_id AS n, row_number() OVER (ORDER BY conv_id) - 1 AS line_no, true AS missing_refused FROM conv""")
def s19_required_ledger(spark, sf):
    """A ledger that must be there, its last line cut off; and one that isn't."""
    read = lambda path: ledger.tolerant(spark, path, "id string, n long", missing_ok=False)
    missing = _refused(lambda: read(fx.scratch(spark, "none")))
    return read(_lines(spark, sf, _entry(), end='{"id":')).select("id", "n", "line_no", F.lit(missing).alias("missing_refused"))


@query(f"""WITH {MESSAGES}, l AS (SELECT conv_id % 17 AS k, conv_id, row_number() OVER (ORDER BY conv_id) AS line FROM conv) SELECT 'k' || k AS id, max(conv_id) AS n, true AS nameless_refused FROM l GROUP BY k""")
def s20_latest_record(spark, sf):
    line = F.format_string('{"id":"k%d","n":%d}', F.col("conv_id") % 17, F.col("conv_id"))
    nameless = lambda: ledger.latest(ledger.tolerant(spark, _lines(spark, sf, F.when(F.col("conv_id") % 9 == 0, '{"id":""}').otherwise(line)), "id string"))
    return ledger.latest(ledger.tolerant(spark, _lines(spark, sf, line), "id string, n long")).select("id", "n", F.lit(_refused(nameless)).alias("nameless_refused"))


@query(f"""WITH {MESSAGES}, l AS (SELECT conv_id % 3 AS shard, string_agg('{{"id":"c' || conv_id || '","n":' || conv_id || '}}' || chr(10), '' ORDER BY conv_id) AS body, count(*) AS n FROM conv GROUP BY 1)
SELECT shard, strlen(body) AS bytes, n AS json_lines, sha256(body) AS sha256 FROM l""")
def s22_snapshot(spark, sf):
    """Ledgers as far as their lines are complete."""
    path = _lines(spark, sf, _entry(), end='{"id":"x"', shards=3)
    return ledger.snapshot(spark, path).select(F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long").alias("shard"), "bytes", "json_lines", "sha256")


@query(f"WITH {MESSAGES} SELECT 'c' || conv_id AS id, conv_id * 2 AS n FROM conv")
def k02_replaced(spark, sf):
    path, rows = fx.scratch(spark, "cache"), fx.corpus(spark, sf)
    for times in (1, 2):
        versions.replace(rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), (times * F.col("conv_id")).alias("n")), path)
    return versions.read(spark, path)


@query(f"WITH {MESSAGES} SELECT id, ch * 2 AS n, ch AS n_before, true AS race_lost FROM conv")
def k14_swapped(spark, sf):
    """Fragments of JSON replaced from themselves in one step, while a reader of the version before goes on; a writer that began before is refused."""
    path, rows = fx.scratch(spark, "fragments"), fx.corpus(spark, sf).select("id", F.col("characters").alias("n"))
    read = lambda number: spark.read.schema("id string, n long").json(versions.folder(path, number))
    first = versions.publish(spark, path, lambda draft: rows.write.json(draft))
    before = read(first)
    second = versions.publish(spark, path, lambda draft: read(first).withColumn("n", F.col("n") * 2).write.json(draft))
    try:
        versions.publish(spark, path, lambda draft: before.write.json(draft), after=first)
        lost = False
    except versions.Conflict:
        lost = True
    return read(second).join(before.withColumnRenamed("n", "n_before"), "id").select("id", "n", "n_before", F.lit(lost).alias("race_lost"))


@query(f"WITH {AUDITED} SELECT label, id, 2 AS times FROM audited")
def k04_ledgers_by_label(spark, sf):
    path, rows = fx.scratch(spark, "ledgers"), fx.audited(spark, sf).select("id", "label")
    for _ in range(2):
        ledger.append(rows, path, by="label")
    return spark.read.json(path).groupBy("label", "id").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query(f"WITH {MESSAGES} SELECT id, CASE WHEN conv_id % 6 = 1 THEN 'OSError: ' || conv_id END AS error FROM conv")
def k05_error_ledger(spark, sf):
    good, bad = fx.scratch(spark, "good"), fx.scratch(spark, "bad")
    rows = fx.corpus(spark, sf).select("id", "dataset", F.when(F.col("conv_id") % 6 == 1, F.concat(F.lit("OSError: "), F.col("conv_id").cast("string"))).alias("error"))
    ledger.split_errors(rows, good, bad)
    return spark.read.json(good).select("id", F.lit(None).cast("string").alias("error")).unionByName(spark.read.json(bad).select("id", "error"))


@query(f"""WITH {MESSAGES} SELECT * FROM (SELECT 'k' || k AS id, n, row_number() OVER (ORDER BY 'k' || k) - 1 AS place FROM (SELECT conv_id % 17 AS k, max(conv_id) AS n FROM conv GROUP BY 1))""")
def k09_compacted(spark, sf):
    path = fx.scratch(spark, "cache")
    rows = ledger.tolerant(spark, _lines(spark, sf, F.format_string('{"id":"k%d","n":%d}', F.col("conv_id") % 17, F.col("conv_id"))), "id string, n long")
    ledger.compact(rows, path)
    # The files of a sorted write hold ranges, in order of their names
    back = versions.read(spark, path).select("id", "n", F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    return back.select("id", "n", (F.row_number().over(fx.Window.orderBy("at")) - 1).alias("place"))


@query(f"WITH {MESSAGES} SELECT id, ch AS n, (SELECT count(*) FROM conv) AS moved, 0 AS moved_again FROM conv")
def k10_migrated_cache(spark, sf):
    """The older cache, one JSON object, moved to a new one, once."""
    old, new = fx.scratch(spark, "old"), fx.scratch(spark, "new")
    entry = F.concat(F.to_json(F.struct("id")).substr(F.lit(7), F.length("id") + 2), F.lit(":"), F.to_json(F.struct(F.col("characters").alias("n"))))
    rows = fx.corpus(spark, sf).select("id", entry.alias("entry"))
    # The first and last entry carry the braces of the whole, so no row holds the file
    ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"))
    value = F.concat(F.when(F.col("id") == F.col("low"), "{").otherwise(","), "entry", F.when(F.col("id") == F.col("high"), "}").otherwise(""))
    rows.join(ends).select(value.alias("value"), "id").coalesce(1).sortWithinPartitions("id").select("value").write.text(old)
    moved = [ledger.migrate(spark, old, new, "struct<n:bigint>") for _ in range(2)]
    return versions.read(spark, new).select("id", "n", F.lit(moved[0]).cast("long").alias("moved"), F.lit(moved[1]).alias("moved_again"))


@query("""WITH d AS (SELECT doc_id AS id, coalesce(n_chars, 0) AS n FROM documents), kept AS (SELECT * FROM d WHERE id % 2 = 0), fresh AS (SELECT id, CASE WHEN id % 5 = 0 THEN n + 1 ELSE n END AS n FROM d WHERE id % 3 <> 0)
SELECT coalesce(fresh.id, kept.id) AS id, coalesce(fresh.n, kept.n) AS n,
  (SELECT count(*) FROM fresh WHERE id % 2 = 1) AS appended, (SELECT count(*) FROM fresh WHERE id % 2 = 0 AND id % 5 = 0) AS rewritten, (SELECT count(*) FROM fresh WHERE id % 2 = 0 AND id % 5 <> 0) AS unchanged FROM kept FULL JOIN fresh ON kept.id = fresh.id""")
def k08_store(spark, sf):
    path, docs = fx.scratch(spark, "cache"), fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"))
    buckets.store(docs.where("id % 2 = 0"), path, buckets=8)
    counts = buckets.store(docs.where("id % 3 <> 0").withColumn("n", F.when(F.col("id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))), path)
    return buckets.read(spark, path).select("id", "n", *(F.lit(counts.get(k, 0)).cast("long").alias(k) for k in ("appended", "rewritten", "unchanged")))


@query("""WITH d AS (SELECT doc_id AS id, coalesce(n_chars, 0) AS n FROM documents), one AS (SELECT min(id) AS id FROM d)
SELECT d.id, CASE WHEN d.id = one.id THEN -1 ELSE n END AS n, 1 AS buckets_written, 1 AS rewritten, (SELECT count(*) FROM d) - 1 AS kept, true AS same_rows_write_nothing FROM d, one""")
def k08_one_bucket(spark, sf):
    """A store of one changed record writes one bucket, a store of the same records nothing."""
    path, docs = fx.scratch(spark, "cache"), fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"))
    buckets.store(docs, path, buckets=8)
    folders = lambda: {r["folder"] for r in buckets.manifest(spark, path).collect()}
    before = folders()
    buckets.store(docs, path)
    same = folders() == before
    counts = buckets.store(docs.agg(F.min("id").alias("id")).select("id", F.lit(-1).cast("long").alias("n")), path)
    return buckets.read(spark, path).select("id", "n", F.lit(len(folders() - before)).alias("buckets_written"), F.lit(counts["rewritten"]).alias("rewritten"), F.lit(counts["kept"]).cast("long").alias("kept"), F.lit(same).alias("same_rows_write_nothing"))


@query(f"WITH {MESSAGES} SELECT id, 1 AS times FROM conv")
def k03_streamed_ledger(spark, sf):
    """Records that arrive in two drops, repeats among them, assessed once each."""
    source, out, marks = (fx.scratch(spark, x) for x in ("in", "out", "marks"))
    rows = fx.corpus(spark, sf).select("id", "conv_id")
    for keep in (F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 > 0, F.lit(True)):
        rows.where(keep).write.mode("append").json(source)
        resume.run_available(resume.new_records(spark, source, "id string"), lambda batch: batch.withColumn("label", F.lit("none")), out, marks).awaitTermination()
    return spark.read.json(out).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query(f"""WITH {MESSAGES}, b AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 0 WHEN conv_id % 3 > 0 THEN 1 ELSE 2 END AS batch FROM conv), n AS (SELECT batch, count(*) AS processed, count(*) FILTER (conv_id % 6 = 1) AS failed FROM b GROUP BY batch)
SELECT CAST(batch AS BIGINT) AS batch, processed, failed, CAST(sum(processed) OVER w AS BIGINT) AS processed_so_far, CAST(sum(failed) OVER w AS BIGINT) AS failed_so_far, (SELECT count(*) FROM conv) AS total, 2.0::DOUBLE AS seconds, processed * 1800.0::DOUBLE AS per_hour FROM n WINDOW w AS (ORDER BY batch)""")
def k16_progress(spark, sf):
    """The rows that a run of three batches leaves of its progress, by a clock of two seconds a batch."""
    source, out, marks, rows_of = (fx.scratch(spark, x) for x in ("in", "out", "marks", "progress"))
    rows = fx.corpus(spark, sf).select("id", "conv_id")
    label = lambda batch: batch.select("id", F.when(F.col("conv_id") % 6 == 1, "OSError").alias("error"))
    ticks = itertools.count(0, 2)
    for keep in (F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 > 0, F.lit(True)):
        rows.where(keep).write.mode("append").json(source)
        resume.run_available(resume.new_records(spark, source, "id string, conv_id long"), label, out, marks, progress=rows_of, total=rows.count(), clock=lambda: next(ticks)).awaitTermination()
    return resume.read_progress(spark, rows_of)


# ---- text ----


@query("""SELECT doc_id, replace(replace(coalesce(text, ''), 'en', '⟦U+0007 CONTROL CHARACTER⟧'), 'st', '⟦U+001F CONTROL CHARACTER⟧' || chr(9)) AS text FROM documents""")
def p20_visible_controls(spark, sf):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("en"), F.lit("\x07")), F.lit("st"), F.lit("\x1f\t"))
    return fx.table(spark, sf, "documents").select("doc_id", tx.visible_controls(text).alias("text"))


ENGLISH = r"""SELECT *, len(regexp_extract_all(said, '[A-Za-z]')) AS letters, regexp_extract_all(lower(said), '[a-z'']+') AS words FROM ({})"""
SAYS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Hello, the OK' WHEN 1 THEN '12 + 3 = 15!' WHEN 2 THEN 'ja, gut' WHEN 3 THEN 'is it' ELSE text END AS said, (doc_id % 100) / 100 AS p FROM documents"
LISTED = "len(words) > 0 AND len(list_filter(words, lambda w: w NOT IN ('a', 'an', 'and', 'are', 'hello', 'hi', 'i', 'is', 'it', 'no', 'ok', 'okay', 'the', 'to', 'yes', 'you'))) = 0"


@query(f"SELECT doc_id, CASE WHEN letters = 0 THEN false WHEN letters < 20 THEN {LISTED} OR (len(words) >= 2 AND p >= 0.99) ELSE p >= 0.9 END AS english FROM ({ENGLISH.format(SAYS)})")
def p21_surely_english(spark, sf):
    """With a detector double that answers from the text's last number."""
    n = F.col("doc_id") % 6
    said = F.when(n == 0, "Hello, the OK").when(n == 1, "12 + 3 = 15!").when(n == 2, "ja, gut").when(n == 3, "is it").otherwise(F.col("text"))
    rows = fx.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", said.alias("said"), F.concat(said, F.lit("|"), (F.col("doc_id") % 100).cast("string")).alias("hint"))
    p = translate.english_probability(F.col("hint"), lambda texts: [int(t.rpartition("|")[2]) / 100 for t in texts])
    return rows.select("doc_id", translate.surely_english(F.col("said"), p).alias("english"))


FIRST_WORDS = "regexp_extract(coalesce({}, ''), '^[A-Za-z]+', 0)"


@query(f"""WITH d AS (SELECT doc_id, {FIRST_WORDS.format('text')} AS one, {FIRST_WORDS.format('lang')} AS two, {FIRST_WORDS.format('source')} AS three FROM documents)
SELECT doc_id, concat_ws('; ', CASE WHEN one <> '' THEN 'externalization ' || one END, CASE WHEN two <> '' THEN 'AI reflection ' || two END, CASE WHEN three <> '' THEN 'user uptake ' || three END) AS said FROM d""")
def p28_evidence_sequence(spark, sf):
    """The first words of a document's text, language and source as turns, some of them empty."""
    first = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), "^[A-Za-z]+", 0)
    turns = {"externalization": first("text"), "AI reflection": first("lang"), "user uptake": F.nullif(first("source"), F.lit(""))}
    return fx.table(spark, sf, "documents").select("doc_id", review.evidence_sequence(turns).alias("said"))


@query(r"""SELECT doc_id, trim(regexp_replace('x' || replace(coalesce(text, ''), 'the', ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents""")
def p30_without_residue(spark, sf):
    """A head, a sentence (here one word) and pictographs at the end, put into each text and taken out."""
    dirty = F.concat(F.lit("  [Bot #]: x"), F.coalesce("text", F.lit("")), F.lit(" \U0001f600✨\n"))
    return fx.table(spark, sf, "documents").select("doc_id", tx.without_residue(dirty, head=r"\s*\[Bot #\]:\s*", sentences=["the"]).alias("text"))


@query(r"""WITH w AS (SELECT page_id, 'The GenAI ' || trim(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' L3 Of AI S' AS said FROM pages)
SELECT page_id, list_aggregate(list_transform(regexp_extract_all(said, '[A-Za-z]+|[^A-Za-z]+'), lambda x: CASE WHEN x IN ('GenAI', 'AI', 'L') THEN x ELSE upper(x[1]) || lower(x[2:]) END), 'string_agg', '') AS title FROM w""")
def p31_titles(spark, sf):
    heading = F.concat(F.lit("the  genai: "), F.coalesce("url", F.lit("")), F.lit(", l 3 (of ai's)"))
    return fx.table(spark, sf, "pages").select("page_id", tx.title(heading).alias("title"))


@query("""WITH n AS (SELECT source, count(*) * 1000 AS n FROM documents GROUP BY source), c AS (SELECT source, n, CASE WHEN source < 'src1' THEN 0 ELSE n END AS m FROM n)
SELECT source, 'all: ' || format('{:,}', n) || '<br/>some: ' || format('{:,}', m) AS every, CASE WHEN m = 0 THEN 'all: ' || format('{:,}', n) ELSE 'all: ' || format('{:,}', n) || '<br/>some: ' || format('{:,}', m) END AS nonzero FROM c""")
def p32_thousands(spark, sf):
    n = fx.table(spark, sf, "documents").groupBy("source").agg((F.count(F.lit(1)) * 1000).alias("n")).withColumn("m", F.when(F.col("source") < "src1", 0).otherwise(F.col("n")))
    pairs = [("all", F.col("n")), ("some", F.col("m"))]
    return n.select("source", tx.thousands_list(pairs).alias("every"), tx.thousands_list(pairs, omit_zero=True).alias("nonzero"))


@query("""SELECT o_orderkey, day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) AS said FROM orders""")
def p33_long_date(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", tx.long_date(F.col("o_orderdate")).alias("said"))


PAGE_FILES = "(SELECT page_id % 3 AS part, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS body FROM pages GROUP BY 1)"


def _page_files(spark, sf) -> str:
    """Three files of pages, each in order of the ids."""
    path = fx.scratch(spark, "files")
    rows = fx.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 3).alias("part"), F.coalesce("html", F.lit("")).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "page_id").select("part", "value").write.partitionBy("part").text(path)
    return path


@query(f"SELECT part, strlen(body) AS bytes, sha256(body) AS sha256 FROM {PAGE_FILES}")
def p36_file_hashes(spark, sf):
    """The hash of each of a few large files, read in blocks."""
    found = files.hashed(files.listed(spark, _page_files(spark, sf), pathGlobFilter="part-*"))
    return found.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), F.col("length").alias("bytes"), "sha256")


@query(f"SELECT 'p' || part AS file, CASE part WHEN 0 THEN 'complete' WHEN 1 THEN 'changed' ELSE 'oversize' END AS state, CAST(strlen(body) - CAST(part = 2 AS INT) AS BIGINT) AS bytes FROM {PAGE_FILES} UNION ALL SELECT 'p3', 'missing', 7")
def s26_pinned_hashes(spark, sf):
    """Files against pinned sizes and hashes: one as pinned, one of the same size and other content, one too long, one missing."""
    present = inventory.present_files(spark, _page_files(spark, sf)).where("file LIKE 'part-%'").withColumn("file", F.concat(F.lit("p"), F.regexp_extract("path", "part=([0-9]+)", 1)))
    pinned = files.hashed(present).select("file", F.when(F.col("file") == "p2", F.col("length") - 1).otherwise(F.col("length")).alias("bytes"), F.when(F.col("file") == "p1", "0").otherwise(F.col("sha256")).alias("sha256"))
    pinned = pinned.unionByName(spark.createDataFrame([("p3", 7, "0")], "file string, bytes long, sha256 string"))
    return inventory.verify_hashes(pinned, present).select("file", "state", "bytes")


# ---- scheduling, guards ----


@query(f"WITH {MESSAGES} SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS place, true AS unknown_refused FROM conv")
def o02_source_order(spark, sf):
    rows = fx.corpus(spark, sf)
    unknown = _refused(lambda: audit.schedule(rows, "shortest", source_order="conv_id"))
    placed = audit.schedule(rows, "source", source_order="conv_id").select("conv_id", F.monotonically_increasing_id().alias("at"))
    return placed.select("conv_id", F.row_number().over(fx.Window.orderBy("at")).cast("long").alias("place"), F.lit(unknown).alias("unknown_refused"))


@query(f"""WITH {AUDITED}, t AS (SELECT id, row_number() OVER (ORDER BY level DESC, ch DESC, id) AS place FROM audited WHERE label <> 'none' AND level IN (3, 4, 5) AND conv_id % 3 <> 0)
SELECT id, 0 AS none, true AS negative_refused FROM t WHERE place <= 3""")
def o05_limited_targets(spark, sf):
    rows = fx.targets(spark, sf)
    return translate.limited(rows, 3).select("id", F.lit(translate.limited(rows, 0).count()).alias("none"), F.lit(_refused(lambda: translate.limited(rows, -1))).alias("negative_refused"))


@query("""SELECT source AS dataset, count(*) AS n, CASE source WHEN 'src7' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END AS place FROM documents GROUP BY source""")
def o08_dataset_order(spark, sf):
    counts = fx.table(spark, sf, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    return report.in_dataset_order(counts, ["src7", "src2"])


@query(f"WITH {MESSAGES} SELECT conv_id FROM conv WHERE conv_id IN (3, 5, 8) AND conv_id % 5 <> 0")
def f05_given_ids(spark, sf):
    rows = fx.corpus(spark, sf)
    return audit.pending(rows, rows.where("conv_id % 5 = 0"), key="conv_id", only=[3, 5, 8, 10**9]).select("conv_id")


@query(f"WITH {MESSAGES}, l AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS audit_line FROM conv) SELECT conv_id, true AS beyond_refused, true AS negative_refused FROM l WHERE audit_line < 7")
def f08_cutoff(spark, sf):
    rows = ledger.tolerant(spark, _lines(spark, sf, _entry()), "n long").select(F.col("n").alias("conv_id"), F.col("line_no").alias("audit_line"))
    refused = lambda n: F.lit(_refused(lambda: report.cut_off(rows, n)))
    return report.cut_off(rows, 7).select("conv_id", refused(10**9).alias("beyond_refused"), refused(-1).alias("negative_refused"))


@query(f"WITH {MESSAGES} SELECT conv_id, true AS missing_refused FROM conv WHERE conv_id % 4 = 1")
def j02_wanted(spark, sf):
    rows = fx.corpus(spark, sf)
    names = rows.where("conv_id % 4 = 1").select("conv_id")
    missing = _refused(lambda: audit.wanted(rows, names.union(spark.createDataFrame([(-1,)], "conv_id long")), key="conv_id"))
    return audit.wanted(rows, names.union(names), key="conv_id").select("conv_id", F.lit(missing).alias("missing_refused"))


@query(f"WITH {AUDITED} SELECT r.id, r.label AS ledger, true AS repeat_refused, true AS other_ledger_refused FROM reviewed r JOIN audited a ON r.id = a.id WHERE a.label <> 'none'")
def j05_guarded_reviews(spark, sf):
    rows = fx.stored(fx.audited(spark, sf), "audited")
    made = fx.reviewed(rows).withColumn("ledger", F.col("label"))
    repeat = _refused(lambda: review.manual_candidates(made.union(made), rows))
    other = _refused(lambda: review.manual_candidates(made.withColumn("ledger", F.lit("none")), rows, ledger="ledger"))
    return review.manual_candidates(made, rows, ledger="ledger").select("id", "ledger", F.lit(repeat).alias("repeat_refused"), F.lit(other).alias("other_ledger_refused"))


@query("""WITH two AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT id, 2 AS n, 'halves,thirds' AS ledgers, true AS repeats_refused FROM two GROUP BY id HAVING count(*) > 1""")
def a16_shared_ids(spark, sf):
    ids = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    found = review.shared_ids({"halves": ids.where("id % 2 = 0"), "thirds": ids.where("id % 3 = 0")}, key="id")
    refused = _refused(lambda: review.require_unique(ids.union(ids), "documents"))
    return found.select("id", F.col("n").cast("int").alias("n"), F.array_join("ledgers", ",").alias("ledgers"), F.lit(refused).alias("repeats_refused"))


# ---- running a model ----


def _part_answer(text: str) -> dict:
    """A double: positive if the part is long, an error if it begins with the label of a short first turn."""
    if len(text) % 11 == 0:
        raise OSError(str(len(text)))
    return {"c": "yes" if len(text) > 600 else "no", "e": False, "a": False, "u": False, "x": False, "d": False, "z": False, "r": "none", "q": "no"}


def _next_answer(so_far: dict, text: str) -> dict:
    return so_far | {"q": "yes", "f": str(len(text))}


CHUNKED = f"""RECURSIVE {MESSAGES}, cut AS (SELECT conv_id, turn, label, text, greatest(1, (length(text) + 335) // 336) AS parts FROM lab),
seg AS (SELECT conv_id, turn, i, '[' || label || CASE WHEN parts > 1 THEN ' part ' || (i + 1) || '/' || parts ELSE '' END || '] ' || substr(text, i * 336 + 1, 336) AS segment FROM cut, range(0, 200) t(i) WHERE i < parts),
num AS (SELECT conv_id, segment, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS k FROM seg),
walk AS (SELECT conv_id, k, 0 AS chunk, length(segment) AS n FROM num WHERE k = 1 UNION ALL
  SELECT x.conv_id, x.k, CASE WHEN w.n + 2 + length(x.segment) > 900 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.n + 2 + length(x.segment) > 900 THEN length(x.segment) ELSE w.n + 2 + length(x.segment) END
  FROM walk w JOIN num x ON x.conv_id = w.conv_id AND x.k = w.k + 1),
chunks AS (SELECT conv_id, chunk, max(n) AS n FROM walk GROUP BY conv_id, chunk)"""


@query(f"""WITH {CHUNKED}, per AS (SELECT conv_id, count(*) AS total, max(n) FILTER (chunk = 0) AS first, string_agg(n::VARCHAR, ',' ORDER BY chunk) FILTER (chunk > 0) AS rest FROM chunks GROUP BY conv_id)
SELECT conv_id, CAST(total AS INTEGER) AS total_chunks, CASE WHEN first % 11 = 0 THEN 0 WHEN first > 600 THEN CAST(total AS INTEGER) ELSE 1 END AS audited_chunks, CASE WHEN first % 11 <> 0 AND first > 600 THEN coalesce(rest, '') ELSE '' END AS findings,
  CASE WHEN first % 11 = 0 THEN 'OSError: ' || first END AS error, CASE WHEN first % 11 <> 0 THEN first > 600 AND total > 1 END AS carried FROM per""")
def n11_assessed_in_parts(spark, sf):
    """Later parts only after a positive first one, each on top of the assessment so far; failures after retries as errors."""
    rows = fx.corpus(spark, sf).select("conv_id", tx.greedy_chunks(tx.segments(F.col("messages"), 400), 900).alias("chunks"))
    found = inference.assess_in_parts(rows, _part_answer, _next_answer, key="conv_id", pause=0)
    return found.select("conv_id", "total_chunks", "audited_chunks", F.array_join("findings", ",").alias("findings"), "error", F.col("assessment").contains('"q":"yes"').alias("carried"))


#: Folders that the files of calls are dealt to.
CALL_FOLDERS = 256


def _noted(calls: str, part: str, fails: bool) -> None:
    """Leave a file for each call in a folder that all tasks share, and fail a part's first call.

    A part's files are looked up by their names, so a call costs the same however many there have been.
    """
    fs, at = files.opened(calls)
    name = hashlib.sha256(part.encode()).hexdigest()
    at = f"{at}/{int(name[:8], 16) % CALL_FOLDERS}"
    fs.create_dir(at)
    before = next(k for k in itertools.count() if fs.get_file_info(f"{at}/{name}-{k}").type == pafs.FileType.NotFound)
    fs.open_output_stream(f"{at}/{name}-{before}").close()
    if fails and not before:
        raise OSError("busy")


def _calls_in(spark: SparkSession, calls: str) -> int:
    """How many calls have left files; the folders are listed by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fs, at = files.opened(calls)
            listed = (fs.get_file_info(pafs.FileSelector(f"{at}/{k}", allow_not_found=True)) for k in batch["id"])
            yield pd.DataFrame({"n": [sum(map(len, listed))]})

    return spark.range(0, CALL_FOLDERS, 1, CALL_FOLDERS // 8).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@query(f"""WITH {CHUNKED}, f AS (SELECT conv_id, n AS first FROM chunks WHERE chunk = 0), per AS (SELECT c.conv_id, count(*) AS total, count(*) FILTER (first > 600 OR chunk = 0) AS audited, count(*) FILTER (n % 7 = 0 AND (first > 600 OR chunk = 0)) AS failures,
  string_agg(n::VARCHAR, ',' ORDER BY chunk) FILTER (chunk > 0 AND first > 600) AS findings FROM chunks c JOIN f ON c.conv_id = f.conv_id GROUP BY c.conv_id)
SELECT conv_id, CAST(total AS INTEGER) AS total_chunks, CAST(audited AS INTEGER) AS audited_chunks, coalesce(findings, '') AS findings, CAST(NULL AS VARCHAR) AS error, (SELECT CAST(sum(audited + failures) AS BIGINT) FROM per) AS calls FROM per""")
def n11_continued(spark, sf):
    """A stream of conversations whose parts fail at their first call: it goes on at the part that failed, in a later batch, and asks no part again that has answered.

    A part begins with a line that names its conversation and place, so parts with equal texts are told apart.
    """
    source, out, marks, calls = (fx.scratch(spark, x) for x in ("in", "out", "marks", "calls"))
    shape = "conv_id long, chunks array<string>"
    chunks = tx.greedy_chunks(tx.segments(F.col("messages"), 400), 900)
    named = F.transform(chunks, lambda text, i: F.concat_ws("\n", F.concat_ws("-", "conv_id", i), text))
    fx.corpus(spark, sf).select("conv_id", named.alias("chunks")).write.json(source)

    def first(part: str) -> dict:
        text = part.partition("\n")[2]
        _noted(calls, part, len(text) % 7 == 0)
        return {"c": "yes" if len(text) > 600 else "no", "e": False, "a": False, "u": False, "x": False, "d": False, "z": False, "r": "none", "q": "no"}

    def more(so_far: dict, part: str) -> dict:
        text = part.partition("\n")[2]
        _noted(calls, part, len(text) % 7 == 0)
        return so_far | {"f": str(len(text))}

    # The longest conversation fixes how many batches there are, most of them nearly empty: a store for each core, as each costs every batch some time
    stores = {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in assess.STORE | stores}
    try:
        for k, v in (assess.STORE | stores).items():
            spark.conf.set(k, v)
        stream = assess.assess_in_parts(spark.readStream.schema(shape).json(source), first, more, key="conv_id", pause=0.1)
        assess.run_until_idle(stream, out, marks, every=0.2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    n = _calls_in(spark, calls)
    found = spark.read.schema(f"conv_id long, {assess.ASSESSED}").json(out)
    return found.select("conv_id", "total_chunks", "audited_chunks", F.array_join("findings", ",").alias("findings"), "error", F.lit(n).cast("long").alias("calls"))


def _screen(texts: list[str]) -> dict[int, dict]:
    """A double: no answer at all if a text's length is a multiple of 13, none to the last item of a batch of many if it is even."""
    if any(len(t) % 13 == 0 for t in texts):
        raise ValueError("busy")
    kept = len(texts) - (len(texts) > 1 and len(texts[-1]) % 2 == 0)
    return {i: {"c": "yes" if len(t) > 500 else "no", "r": "none", "q": "no"} for i, t in enumerate(texts[:kept])}


@query(f"""WITH {MESSAGES}, s AS (SELECT conv_id, length(string_agg('[' || label || '] ' || CASE WHEN role = 'user' AND length(text) > 500 THEN substr(text, 1, 232) || ' […omitted…] ' || right(text, 232)
  WHEN role = 'assistant' AND length(text) > 300 THEN substr(text, 1, 132) || ' […omitted…] ' || right(text, 132) ELSE text END, chr(10) ORDER BY turn)) AS n FROM lab GROUP BY conv_id)
SELECT conv_id, CASE WHEN n % 13 <> 0 THEN CASE WHEN n > 500 THEN 'yes' ELSE 'no' END END AS c, CASE WHEN n % 13 = 0 THEN 'ValueError: busy' END AS error FROM s""")
def n13_screened_batches(spark, sf):
    """Batches that fail, or answer in part, fall back to single items."""
    rows = fx.corpus(spark, sf).select("conv_id", legacy.screened(F.col("messages")).alias("text"))
    rows = rows.withColumn("n", F.length("text"))
    packed = legacy.pack_batches(rows, key="conv_id", position="conv_id", length="n")
    batches = rows.join(packed, "conv_id").groupBy("batch").agg(F.collect_list(F.struct("conv_id", "text")).alias("items"))
    return inference.screen_batches(batches, _screen, key="conv_id", pause=0).select("conv_id", "c", "error")


def _judge(text: str, number: int, total: int) -> dict:
    n, orders = len(text), legacy.ORDERS
    return {name: {"label": labels[(n + k) % 3], "confidence": (n % 10) / 10} for k, (name, labels) in enumerate(orders.items())}


OVERLAPPING = f"""RECURSIVE {MESSAGES}, said AS (SELECT conv_id, pos, '[' || label || '] ' || CASE WHEN length(text) > 400 THEN substr(text, 1, 160) || chr(10) || '[…message middle omitted…]' || chr(10) || right(text, 160) ELSE text END AS line FROM lab),
sums AS (SELECT conv_id, pos, line, sum(length(line) + 2) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM said),
reach AS (SELECT a.conv_id, a.pos, a.n, greatest(a.pos + 1, max(CASE WHEN b.upto - 2 - (a.upto - length(a.line) - 2) <= 1500 THEN b.pos + 1 ELSE 0 END)) AS last FROM sums a JOIN sums b ON a.conv_id = b.conv_id AND b.pos >= a.pos GROUP BY a.conv_id, a.pos, a.n, a.upto, a.line),
chunks AS (SELECT conv_id, 0 AS chunk, pos AS first, last, n FROM reach WHERE pos = 0 UNION ALL SELECT c.conv_id, c.chunk + 1, r.pos, r.last, r.n FROM chunks c JOIN reach r ON r.conv_id = c.conv_id AND r.pos = greatest(c.first + 1, c.last - 2) WHERE c.last < c.n),
cut AS (SELECT c.conv_id, c.chunk, c.first, c.last, string_agg(s.line, chr(10) || chr(10) ORDER BY s.pos) AS text FROM chunks c JOIN sums s ON s.conv_id = c.conv_id AND s.pos >= c.first AND s.pos < c.last GROUP BY ALL)"""


def _overlapping(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.corpus(spark, sf).withColumn("pieces", legacy.exchanges(F.col("messages"), limit=400))
    return legacy.overlapping_chunks(rows, "pieces", key="conv_id", limit=1500, overlap=2)


@query(f"WITH {OVERLAPPING} SELECT conv_id, CAST(chunk AS INTEGER) AS chunk, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, text FROM cut")
def c02_overlapping_chunks(spark, sf):
    return _overlapping(spark, sf)


@query(f"""WITH {OVERLAPPING}, j AS (SELECT conv_id, chunk, unnest(['no', 'none', 'no']) AS zero, unnest([['no', 'uncertain', 'yes'], ['none', 'potential', 'clear'], ['no', 'maybe', 'yes']]) AS labels, unnest(['consumption', 'extension', 'review']) AS name, unnest([0, 1, 2]) AS k, length(text) AS n FROM cut),
l AS (SELECT conv_id, name, chunk, (n + k) % 3 AS rank, labels[(n + k) % 3 + 1] AS label, (n % 10) / 10 AS confidence FROM j), best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY rank DESC, confidence DESC, chunk) AS place, count(*) OVER (PARTITION BY conv_id, name) AS chunks FROM l)
SELECT conv_id, name, label, confidence, chunks FROM best WHERE place = 1""")
def m03_classified(spark, sf):
    """Every chunk judged by itself, and the strongest judgement of each kind for the conversation."""
    judged = legacy.classify_chunks(_overlapping(spark, sf), _judge, key="conv_id", pause=0)
    merged = legacy.merged(judged.where("error IS NULL"), "conv_id")
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("v")) for name in legacy.ORDERS))).alias("x")
    return merged.select("conv_id", "chunks", kinds).select("conv_id", "x.name", "x.v.label", "x.v.confidence", "chunks")


@query("""SELECT doc_id % 50 AS id, round(coalesce(sum(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END), 0), 3) AS seconds, CAST(coalesce(sum(doc_id), 0) AS BIGINT) AS tokens FROM documents GROUP BY 1""")
def a12_summed_metrics(spark, sf):
    parts = fx.table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("seconds"), F.col("doc_id").alias("tokens"))
    return inference.summed_metrics(parts, "id", "seconds", "tokens")


@query("SELECT count(*) AS processed, count(*) FILTER (doc_id % 9 = 0) AS failed, 5000 AS total, round_even(count(*) * 3600 / 127.5, 1) AS per_hour FROM documents")
def a22_run_status(spark, sf):
    rows = inference.progress(fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "boom").alias("error")))
    return inference.run_status(rows, 5000, 127.5)


# ---- translation ----


def _marked(texts: list[str]) -> list[str]:
    """A double that writes # for e; it fails on a batch with a text that is a multiple of 29 long."""
    if any(len(t) % 29 == 0 for t in texts):
        raise TimeoutError("slow")
    return [t.replace("e", "#") for t in texts]


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """Targets, with short English turns for users whose turn is a multiple of four."""
    rows = fx.targets(spark, sf)
    said = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when(i % 4 == 2, "ok yes").otherwise(m["content"]).alias("content")))
    return rows.withColumn("messages", said)


SAID = f"""{AUDITED}, aim AS (SELECT id, conv_id, row_number() OVER (ORDER BY level DESC, ch DESC, id) AS place FROM audited WHERE label <> 'none' AND level IN (3, 4, 5) AND conv_id % 3 <> 0),
told AS (SELECT aim.id, aim.conv_id, aim.place, m.pos, m.role, CASE WHEN m.pos % 4 = 2 THEN 'ok yes' ELSE m.text END AS text FROM aim JOIN m ON m.conv_id = aim.conv_id),
src AS (SELECT id, conv_id, place, count(*) AS turns, sha256('[' || string_agg('{{"role":"' || role || '","content":' || to_json(text) || '}}', ',' ORDER BY pos) || ']') AS sha FROM told GROUP BY ALL)"""


@query(f"""WITH {SAID}, out AS (SELECT id, conv_id, place, string_agg(CASE WHEN pos % 4 = 2 THEN text WHEN conv_id % 4 = 1 THEN 'old' ELSE replace(text, 'e', '#') END, '|' ORDER BY pos) AS said, bool_or(length(text) % 29 = 0 AND pos % 4 <> 2) AS bad FROM told GROUP BY ALL)
SELECT id, CASE WHEN conv_id % 4 = 1 THEN 'complete' WHEN bad THEN 'failed' ELSE 'translated' END AS status, CASE WHEN conv_id % 4 = 1 OR NOT bad THEN said END AS said FROM out""")
def n15_translation_run(spark, sf):
    """Repair, drop what is faulty, translate what is missing, store: a quarter of the cache is sound but for a turn that should have passed through, a quarter is stale."""
    rows, c = fx.stored(_said(spark, sf), "targets"), F.col("conv_id")
    old = F.transform("messages", lambda m: F.lit("old"))
    cache = co.with_hash(rows).where((c % 4 == 1) | (c % 4 == 2))
    cache = cache.select("id", F.when(c % 4 == 1, F.col("hash")).otherwise("stale").alias("source_sha256"), F.lit("m").alias("translation_method"), old.alias("translations"))
    status, stored, _ = translate.run(rows, cache, _marked, fx.scratch(spark, "answers"), method="m", max_items=1, max_characters=10**6, attempts=1, pause=0)
    return status.join(stored.select("id", F.array_join("translations", "|").alias("said")), "id", "left")


@query(f"""WITH {SAID} SELECT id, CASE conv_id % 5 WHEN 0 THEN 'hash' WHEN 1 THEN 'count' WHEN 2 THEN 'empty' WHEN 3 THEN 'method' END AS fault FROM src""")
def f12_unfit_records(spark, sf):
    rows, c = co.with_hash(_said(spark, sf)), F.col("conv_id")
    own = F.transform("messages", lambda m: m["content"])
    said = F.when(c % 5 == 1, F.slice(own, 2, 1000)).when(c % 5 == 2, F.transform(own, lambda x, i: F.when(i > 0, x))).otherwise(own)
    records = rows.select("id", F.when(c % 5 == 0, "other").otherwise(F.col("hash")).alias("source_sha256"), said.alias("translations"), F.when(c % 5 == 3, "by hand").otherwise("Local M-26B").alias("translation_method"))
    return translate.unfit(rows, records, method="26b")


@query(f"""WITH {MESSAGES}, t AS (SELECT conv_id, turn, length(text) AS n, conv_id % 4 AS how, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m)
SELECT conv_id, how = 0 AS ok FROM t GROUP BY conv_id, how""")
def f14_faithful_answers(spark, sf):
    """Whether an answer has as many items as asked, none empty and none far too long."""
    own, how = F.transform("messages", lambda m: m["content"]), F.col("conv_id") % 4
    answer = F.when(how == 1, F.slice(own, 2, 1000)).when(how == 2, F.transform(own, lambda x, i: F.when(i > 0, x).otherwise(""))).when(how == 3, F.transform(own, lambda x: F.concat(F.repeat(x, 8), F.lit("x" * 240)))).otherwise(own)

    return fx.corpus(spark, sf).select("conv_id", inference.faithful_answers(own, answer).alias("ok"))


@query(f"""WITH {SAID} SELECT id, string_agg(CASE WHEN pos % 4 = 2 THEN text ELSE 'x' END, '|' ORDER BY pos) AS said FROM told GROUP BY id""")
def j14_repaired_cache(spark, sf):
    rows = _said(spark, sf)
    cached = rows.select("id", F.transform("messages", lambda m: F.lit("x")).alias("translations"))
    return translate.repair_passthrough(rows, cached).select("id", F.array_join("translations", "|").alias("said"))


@query(f"WITH {MESSAGES} SELECT id FROM conv WHERE conv_id % 7 = 0 AND conv_id % 2 = 0")
def j15_unavailable(spark, sf):
    rows = fx.corpus(spark, sf)
    return translate.unavailable(rows.where("conv_id % 2 = 0"), rows.where("conv_id % 7 <> 0"))


@query(f"""WITH {AUDITED} SELECT r.id, r.level, CASE WHEN a.conv_id % 3 <> 0 THEN 't' || a.conv_id END AS said, true AS lacking_refused FROM reviewed r JOIN audited a ON r.id = a.id WHERE r.label = 'clear'""")
def j16_appendix(spark, sf):
    rows = fx.stored(fx.audited(spark, sf), "audited")
    reviews = fx.reviewed(rows).where("label = 'clear'").select("id", "level")
    talks = rows.select("id", "conv_id", F.when(F.col("conv_id") % 3 == 0, " English").otherwise("German").alias("language"))
    cache = talks.where("conv_id % 3 <> 0").select("id", F.array(F.concat(F.lit("t"), F.col("conv_id").cast("string"))).alias("translations"))
    lacking = _refused(lambda: translate.appendix(reviews, talks, cache.limit(0)))
    return translate.appendix(reviews, talks, cache).select("id", F.col("level").cast("long").alias("level"), F.col("translations")[0].alias("said"), F.lit(lacking).alias("lacking_refused"))


# ---- caches and reports ----


@query(f"""WITH {MESSAGES}, s AS (SELECT CASE WHEN conv_id % 4 = 0 THEN 'hit' ELSE 'rebuilt' END AS status FROM conv) SELECT status, count(*) AS n FROM s GROUP BY status""")
def a20_fragment_counts(spark, sf):
    """Fragments read from a cache on disk: hits, and what has to be built again."""
    rows, c = co.with_hash(fx.corpus(spark, sf)).withColumnRenamed("hash", "fingerprint"), F.col("conv_id")
    path = fx.scratch(spark, "fragments")
    cached = rows.where(c % 4 != 3).select("id", F.when(c % 4 == 1, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(2).alias("version"), F.when(c % 4 == 2, "").otherwise("body").alias("body"))
    cached.write.option("compression", "gzip").json(path)
    found = fingerprint.fragment_status(rows, fingerprint.read_fragments(spark, path), 2)
    return found.groupBy(F.when(F.col("status") == "hit", "hit").otherwise("rebuilt").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, coalesce(doc_id % 4 <> 1 AND sha256(text) = sha256(CASE WHEN doc_id % 4 = 2 THEN replace(text, 'e', '') ELSE text END) AND sha256(lang) = sha256(CASE WHEN doc_id % 4 = 3 THEN source ELSE lang END), false) AS current FROM documents""")
def f15_current_outputs(spark, sf):
    """Outputs of texts: of another format, of texts that have changed since, with other bytes on file; null texts and languages have no hash."""
    d, sha = F.col("doc_id"), lambda c: F.sha2(c, 256)
    rows = fx.table(spark, sf, "documents").select(
        "doc_id", F.when(d % 4 == 1, 1).otherwise(2).alias("format_version"), sha(F.col("text")).alias("document_fingerprint"), sha(F.when(d % 4 == 2, F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.col("text"))).alias("expected_fingerprint"),
        sha(F.col("lang")).alias("output_sha256"), sha(F.when(d % 4 == 3, F.col("source")).otherwise(F.col("lang"))).alias("file_sha256"),
    )
    return fingerprint.is_current(rows, 2).select("doc_id", "current")


@query(f"""WITH {AUDITED}, c AS (SELECT * FROM audited WHERE label <> 'none'), h AS (SELECT r.* FROM reviewed r JOIN c ON r.id = c.id), names(label) AS (VALUES ('clear'), ('none'), ('potential'))
SELECT 500 AS source_total, (SELECT count(*) FROM audited) AS automated_total, (SELECT count(*) FROM audited WHERE conv_id % 9 = 0) AS automated_errors, (SELECT count(*) FROM c) AS automated_candidates, (SELECT count(*) FROM h) AS manual_total,
  (SELECT count(*) FROM c) - (SELECT count(*) FROM h) AS manual_pending, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM audited GROUP BY label)) AS automated_labels,
  (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM h GROUP BY label)) AS manual_labels, (SELECT string_agg(level || '=' || n, ',' ORDER BY level) FROM (SELECT level, count(*) AS n FROM h WHERE label = 'clear' GROUP BY level)) AS clear_levels, true AS repeats_refused""")
def a15_campaign_state(spark, sf):
    rows = fx.stored(fx.audited(spark, sf).select("id", "conv_id", "dataset", "label", F.col("level").cast("long").alias("level")), "audited")
    manual = fx.reviewed(rows).withColumnRenamed("id", "conversation_id")
    repeats = _refused(lambda: report.campaign_state(rows, rows.union(rows), rows, manual))
    found = report.campaign_state(rows, rows, rows.where("conv_id % 9 = 0"), manual, sources=500)
    listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return found.select("source_total", "automated_total", "automated_errors", "automated_candidates", "manual_total", "manual_pending", *(listed(c) for c in ("automated_labels", "manual_labels", "clear_levels")), F.lit(repeats).alias("repeats_refused"))


@query(f"""WITH {AUDITED}, l AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS line, 'part ' || conv_id % 3 AS part FROM audited), s AS (SELECT * FROM l WHERE line < (SELECT count(*) // 2 FROM l)),
h AS (SELECT s.part, r.label FROM reviewed r JOIN s ON r.id = s.id WHERE s.label <> 'none')
SELECT part AS dataset, count(*) AS corpus_total, (SELECT count(*) FROM s WHERE s.part = l.part) AS automated_total, (SELECT count(*) FROM s WHERE s.part = l.part AND label <> 'none') AS automated_candidates, (SELECT count(*) FROM h WHERE h.part = l.part) AS manual_total,
  coalesce((SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM h WHERE h.part = l.part GROUP BY label)), '') AS manual_labels FROM l GROUP BY part""")
def a15_state_by_dataset(spark, sf):
    """The state of each dataset at a cutoff of half of the machine's ledger."""
    rows = fx.audited(spark, sf).select("id", "conv_id", "label", "level", F.concat(F.lit("part "), (F.col("conv_id") % 3).cast("string")).alias("dataset"))
    rows = fx.stored(rows.withColumn("audit_line", F.row_number().over(fx.Window.orderBy("conv_id")) - 1), "audited")
    manual = fx.reviewed(rows).join(rows.select("id", "dataset"), "id").withColumnRenamed("id", "conversation_id")
    found = report.campaign_state(rows, rows, rows.where("conv_id < 0"), manual, by="dataset", cutoff=rows.count() // 2)
    labels = F.array_join(F.transform(F.map_entries("manual_labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("dataset", "corpus_total", "automated_total", "automated_candidates", "manual_total", labels.alias("manual_labels"))


@query(f"WITH {AUDITED} SELECT label, count(*) AS n FROM reviewed GROUP BY label")
def a21_decisions_by_label(spark, sf):
    return report.label_levels(fx.reviewed(fx.audited(spark, sf))).where("level IS NULL AND label IS NOT NULL").select("label", "n")


def _chart_sql() -> str:
    """The chart's lines, in order."""
    n = lambda x: f"format('{{:,}}', CAST({x} AS BIGINT))"
    total = lambda c: f"'n = ' || {n(f'(SELECT sum({c}) FROM f)')}"
    each = lambda c, all_: f"(SELECT coalesce(string_agg('<br/>' || dataset || ': ' || {n(c)}, '' ORDER BY dataset), '') FROM f{'' if all_ else f' WHERE {c} <> 0'})"
    box = lambda name, head, c, more="": f"""'  {name}["{head}<br/>' || {total(c)}{more} || '"]'"""
    of = lambda label, level: f"(SELECT coalesce(sum(n), 0) FROM o WHERE label = '{label}'{f' AND level = {level}' if level is not None else ''})"
    out = lambda label, levels: f"""'  {label}["outcome {label}<br/>n = ' || {n(of(label, None))}""" + "".join(f" || '<br/>level {k}: ' || {n(of(label, k))}" for k in levels) + """ || '"]'"""
    lines = [
        "'flowchart TB'", box("raw", "records collected", "raw", " || " + each("raw", True)), box("excluded", "too short or repeated", "excluded"), box("included", "corpus", "included", " || " + each("included", True)),
        box("audited", "assessed", "audited", " || " + each("audited", False) + " || '<br/>errors: 2'"), box("waiting", "not assessed", "waiting", " || " + each("waiting", False)), box("quiet", "no sign", "quiet"),
        box("candidates", "candidates", "potential + clear", f" || '<br/>potential: ' || {n('(SELECT sum(potential) FROM f)')} || '<br/>clear: ' || {n('(SELECT sum(clear) FROM f)')}"), box("reviewed", "reviewed by hand", "reviewed"), box("pending", "not reviewed", "potential + clear - reviewed"),
        out("clear", (3, 4, 5)), out("potential", (1, 2, 3, 4, 5)), out("none", (0,)),
        *(f"'  {a} --> {b}'" for a, b in (("raw", "included"), ("included", "audited"), ("audited", "quiet"), ("audited", "candidates"), ("candidates", "reviewed"), ("reviewed", "clear"), ("reviewed", "potential"), ("reviewed", "none"))),
        *(f"'  {a} -.-> {b}'" for a, b in (("raw", "excluded"), ("included", "waiting"), ("candidates", "pending"))),
    ]
    return f"[{', '.join(lines)}]"


@query(f"""WITH {AUDITED}, f AS (SELECT 'part ' || conv_id % 3 AS dataset, count(*) + 7 AS raw, 7 AS excluded, count(*) AS included, count(*) FILTER (conv_id % 5 <> 4) AS audited, count(*) FILTER (conv_id % 5 = 4) AS waiting, count(*) FILTER (conv_id % 5 <> 4 AND label = 'none') AS quiet,
  count(*) FILTER (conv_id % 5 <> 4 AND label = 'potential') AS potential, count(*) FILTER (conv_id % 5 <> 4 AND label = 'clear') AS clear, count(*) FILTER (conv_id % 5 <> 4 AND label <> 'none' AND conv_id % 4 <> 3) AS reviewed FROM audited GROUP BY 1),
o AS (SELECT label, level, count(*) AS n FROM reviewed GROUP BY label, level), x AS (SELECT {_chart_sql()} AS lines) SELECT unnest(range(0, len(lines))) AS place, unnest(lines) AS line FROM x""")
def k13_flow_chart(spark, sf):
    rows = fx.audited(spark, sf).withColumn("dataset", F.concat(F.lit("part "), (F.col("conv_id") % 3).cast("string")))
    raw = rows.groupBy("dataset").agg((F.count(F.lit(1)) + 7).alias("rows"))
    reviewed = fx.reviewed(rows)
    chart = report.flow_lines(report.funnel(raw, rows, rows.where("conv_id % 5 <> 4"), reviewed), report.label_levels(reviewed), errors=2)
    return chart.withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {MESSAGES} SELECT conv_id, '[' || string_agg('{{"role":"' || role || '","content":' || replace(replace(to_json(text), 'th', '\\u000b\\u001f'), 'en', '\\\\u001F') || '}}', ',' ORDER BY turn) || ']' AS json FROM m GROUP BY conv_id""")
def p34_compact_json(spark, sf):
    return fx.controlled(fx.corpus(spark, sf)).select("conv_id", compact_json(F.col("messages")).alias("json"))
