"""Rules with literal rows: schedules, folds, gates, ledgers, readers, the stream."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skeinworks.functions import text as tx
from skeinworks.functions.messages import ROLE_NAMES, clean, compact_json, realized_path, turn_labels
from skeinworks.operators import audit, corpus, fingerprint, legacy, profile, report, review, translate
from skeinworks.sources import versions
from skeinworks.sources import inventory, ledger, readers
from skeinworks.streaming import resume

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
SAID = "messages array<struct<role:string,content:string>>"


def one(spark, column, value, schema):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


# ---- schedules ----


def test_longest_first(spark):
    rows = spark.createDataFrame([("z", "beta", 20, 0), ("b", "alpha", 10, 1), ("a", "alpha", 10, 2), ("a", "beta", 10, 3), ("n", "beta", None, 4)], "id string, dataset string, characters int, position int")
    want = [(20, "beta", "z"), (10, "alpha", "a"), (10, "alpha", "b"), (10, "beta", "a"), (None, "beta", "n")]
    assert [(r.characters, r.dataset, r.id) for r in audit.schedule(rows).collect()] == want
    ranked = audit.longest_first_rank(rows).orderBy("rank").collect()
    assert [(r.characters, r.dataset, r.id) for r in ranked] == want
    assert [r.id for r in audit.schedule(rows, "source").collect()] == ["z", "b", "a", "a", "n"]
    assert [r.id for r in audit.schedule(rows, limit=2).collect()] == ["z", "b"]
    with pytest.raises(ValueError):
        audit.schedule(rows, "newest")


def test_pending_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, characters long")
    assert tuple(audit.pending_stats(empty).first()) == (0, 0, 0, 0)
    rows = spark.createDataFrame([("a", 1), ("b", 4)], "id string, characters long")
    assert audit.pending_stats(rows).first()["median"] == 2  # 2.5, half to even


# ---- folds ----


def chunked(parts, limit):
    out = []
    for p in parts:
        if out and len(out[-1]) + 2 + len(p) <= limit:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


@SLOW
@given(st.lists(st.lists(st.text("ab\n ", max_size=12), max_size=8), min_size=1, max_size=20), st.integers(1, 20))
def test_greedy_chunks(spark, rows, limit):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<string>")
    got = df.select("i", tx.greedy_chunks(F.col("p"), limit).alias("c")).orderBy("i").collect()
    assert [list(r.c) for r in got] == [chunked(r, limit) for r in rows]


def soft(text, limit):
    out = []
    while len(text) > limit:
        for mark in "\n ":
            cut = text.rfind(mark, 0, limit)
            if cut >= limit // 2:
                break
        else:
            cut = limit
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


@SLOW
@given(st.lists(st.text("abé😀\n ", max_size=60), min_size=1, max_size=20), st.integers(2, 17))
def test_soft_pieces(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [list(r.p) for r in df.select("i", tx.soft_pieces(F.col("t"), limit).alias("p")).orderBy("i").collect()]
    assert got == [soft(t, limit) for t in texts]
    assert ["".join(p) for p in got] == texts


def test_soft_pieces_stay_in_the_jvm(spark, capsys):
    """No Python takes part; characters of one and two UTF-16 units by turns, a limit of one, empty and null texts come out as by the model."""
    texts = ["a😀" * 5_000, "a😀" * 1_400 + "\n" + "😀" * 4_000 + " b", "", "x" * 3_000, "x" * 3_001]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i int, t string").select("i", tx.soft_pieces(F.col("t")).alias("p"), tx.soft_pieces(F.col("t"), 1).alias("q"))
    df.explain()
    assert "Python" not in capsys.readouterr().out
    got = [(r.p, r.q) for r in df.orderBy("i").collect()]
    assert got == [*((soft(t, 3_000), list(t) or [""]) for t in texts), (None, None)]


@SLOW
@given(st.lists(st.lists(st.integers(0, 30), max_size=10), min_size=1, max_size=20), st.integers(1, 4), st.integers(1, 40))
def test_batch_numbers(spark, rows, items, most):
    def model(ns):
        out, batch, k, held = [], 0, 0, 0
        for n in ns:
            if k and (k >= items or held + n > most):
                batch, k, held = batch + 1, 0, 0
            k, held = k + 1, held + n
            out.append(batch)
        return out

    df = spark.createDataFrame(list(enumerate(rows)), "i int, n array<int>")
    got = df.select("i", tx.batch_numbers(F.col("n"), max_items=items, max_characters=most).alias("b")).orderBy("i").collect()
    assert [list(r.b) for r in got] == [model(r) for r in rows]


def test_overlapping_chunks_move_on(spark):
    df = spark.createDataFrame([("a", ["xx"] * 6), ("b", []), ("c", ["x" * 50, "y"])], "id string, p array<string>")
    got = [(r.id, r.first, r.last) for r in legacy.overlapping_chunks(df, "p", limit=12, overlap=1).orderBy("id", "chunk").collect()]
    assert got == [("a", 0, 3), ("a", 2, 5), ("a", 4, 6), ("c", 0, 1), ("c", 1, 2)]


@SLOW
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.sampled_from([0.5, 0.95, 0.99]))
def test_nearest_rank(spark, values, p):
    got = profile.turn_summary(spark.createDataFrame([(v,) for v in values], "n int"), "n").first()
    place = max(1, -(-len(values) * round(p * 100) // 100))
    assert got[{0.5: "median", 0.95: "p95", 0.99: "p99"}[p]] == sorted(values)[place - 1]


def test_summary_of_nothing(spark):
    got = profile.turn_summary(spark.createDataFrame([], "n int"), "n").first()
    assert got.total == 0 and got.mean is None and got.one_turn_share is None


# ---- messages and text ----


def test_roles(spark):
    raw = "m array<struct<role:string,type:string,content:string>>"
    said = [("", "user", None), ("system", None, "s"), ("assistant", "user", "a"), (None, "human", "h")]
    fallback = one(spark, clean(F.col("m"), role_fallback="type"), said, raw)
    assert [tuple(x) for x in fallback] == [("user", ""), ("assistant", "a")]
    named = one(spark, clean(F.col("m"), role="type", roles=ROLE_NAMES), said, raw)
    assert [tuple(x) for x in named] == [("user", ""), ("user", "a"), ("user", "h")]
    assert one(spark, clean(F.col("m")), None, raw) == []


def test_only_chosen_replies(spark):
    history = [("user", "q", None), ("model", "x", None), ("model", "y", False), ("model", "z", True)]
    got = one(spark, realized_path(F.col("h")), history, "h array<struct<role:string,content:string,if_chosen:boolean>>")
    assert [m.content for m in got] == ["q", "z"]


def test_turn_labels_and_segments(spark):
    said = [("user", "a"), ("user", ""), ("assistant", "x" * 100), ("tool", "t")]
    assert one(spark, turn_labels(F.col("messages")), said, SAID) == ["U1", "U2", "A1", "A2"]
    assert one(spark, tx.segments(F.col("messages"), 124), said, SAID) == ["[U1] a", "[U2] ", f"[A1 part 1/2] {'x' * 60}", f"[A1 part 2/2] {'x' * 40}", "[A2] t"]


def test_controls_references_and_lists(spark):
    assert one(spark, tx.visible_controls(F.col("t")), "a\x00b\tc\x1f\n", "t string") == "a⟦U+0000 CONTROL CHARACTER⟧b\tc⟦U+001F CONTROL CHARACTER⟧\n"
    assert one(spark, tx.turn_references(F.col("t")), "U2 and A3, then A10-A12,U13 and U2 and A3", "t string") == "U2 and A3, A10-A12,U13"
    assert one(spark, tx.turn_references(F.col("t")), "none", "t string") == "not directly evidenced"
    assert one(spark, tx.thousands_list([("a", F.col("n")), ("b", F.lit(0))], omit_zero=True), 1234567, "n long") == "a: 1,234,567"
    assert one(spark, compact_json(F.struct(F.lit(None).cast("string").alias("k"))), 1, "n int") == '{"k":null}'


def test_short_english(spark):
    rows = spark.createDataFrame([("Hello you",), ("bonjour",), ("123",), ("x" * 30,)], "t string")
    assert [r.x for r in rows.select(translate.surely_english(F.col("t")).alias("x")).collect()] == [True, False, False, False]
    assert one(spark, translate.surely_english(F.col("t"), F.lit(0.95)), "x" * 30, "t string") is True


# ---- corpus and reviews ----


def test_base_repeats_survive_and_first_wins(spark):
    base = spark.createDataFrame([(0, "h"), (1, "h")], "n int, hash string")
    more = spark.createDataFrame([(2, "k"), (3, "h"), (4, "k"), (5, "j")], "n int, hash string")
    got = {r.n: r.status for r in corpus.dedup_status(base, more, order=["n"]).collect()}
    assert got == {0: "base", 1: "base", 2: "included", 3: "base_dup", 4: "expansion_dup", 5: "included"}
    once = corpus.expand(base, more, order=["n"])
    assert sorted(r.n for r in once.collect()) == [0, 1, 2, 5]


def test_unknown_dataset(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "dataset string")
    assert corpus.of_datasets(rows, ["a"], ["a", "b"]).count() == 1
    with pytest.raises(PySparkException):
        corpus.of_datasets(rows, ["a"], ["a"]).collect()


def test_runs_count_all_stretches(spark):
    rows = spark.createDataFrame([(n, k, n // 3) for n, k in enumerate("aabba")], "n int, k string, part int")
    keys = corpus.run_keys(corpus.runs(rows, key="k", order="n", part="part"), key="k", part="part").orderBy("run").collect()
    assert [r.run_key for r in keys] == ["a", "b", "a#occurrence=2"]


def test_decision_rules(spark):
    rows = spark.createDataFrame([("clear", 2), ("clear", 3), ("none", 1), ("none", 0), ("potential", 0), ("other", 0), ("clear", 6), (None, 0)], "label string, level int")
    assert [r.x for r in rows.select(review.valid_decision(F.col("label"), F.col("level")).alias("x")).collect()] == [False, True, False, True, True, False, False, False]


def test_guards(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "id string, audit_line int")
    assert report.cut_off(rows, 1).count() == 1
    for bad in (-1, 3):
        with pytest.raises(ValueError):
            report.cut_off(rows, bad)
    with pytest.raises(ValueError):
        review.require_empty(rows, "problems")
    assert review.require_unique(rows, "rows").count() == 2 and review.manual_candidates(rows, rows.withColumn("label", F.lit("clear"))).count() == 2
    for bad in (lambda: review.require_unique(rows.union(rows), "rows"), lambda: review.manual_candidates(rows.union(rows), rows.withColumn("label", F.lit("clear"))), lambda: audit.wanted(rows, rows.select(F.lit("z").alias("id")))):
        with pytest.raises(PySparkException, match="(repeated|missing)"):
            bad().collect()
    assert review.shared_ids({"x": rows, "y": rows.where("id = 'a'")}, key="id").collect()[0].ledgers == ["x", "y"]
    with pytest.raises(ValueError):
        translate.limited(rows, -1)


def test_negative_funnel(spark):
    raw = spark.createDataFrame([("d", 0)], "dataset string, rows long")
    rows = spark.createDataFrame([("a", "d", "none")], "id string, dataset string, label string")
    with pytest.raises(PySparkException):
        report.funnel(raw, rows, rows, rows).collect()


def test_repair_and_document_fingerprint(spark):
    talk = spark.createDataFrame([("a", [("user", "yes"), ("assistant", "")])], f"id string, {SAID}")
    cached = spark.createDataFrame([("a", ["oui", "x"])], "id string, translations array<string>")
    assert translate.repair_passthrough(talk, cached).first()["translations"] == ["yes", ""]
    cases = spark.createDataFrame([("b", 3, "2"), ("a", 3, "1")], "id string, level int, fingerprint string")
    want = spark.createDataFrame([("a", 3, "1"), ("b", 3, "2")], cases.schema)
    assert fingerprint.document_fingerprint(cases, 1).collect() == fingerprint.document_fingerprint(want, 1).collect()


def test_classifier_runs_in_batches(spark):
    def classify(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n": b["text"].str.len()})

    rows = spark.createDataFrame([("a", "xyz")], "id string, text string")
    assert audit.assess(rows, classify, "id string, n long").first()["n"] == 3


# ---- ledgers ----

GOOD = '{"id":"a","v":1}\n{"id":"b","v":2}\n'
SCHEMA = "id string, v int"


@pytest.mark.parametrize(
    ("body", "skipping", "strict", "tolerant", "kept"),
    [
        (GOOD, 2, 2, 2, 2),
        (GOOD + '{"id":"c"', 2, None, 2, 2),
        (GOOD + '{"id":"c","v":3}', 3, 3, 3, 2),
        ('{"id":"a"}\n{"id":\n{"id":"c"}\n', 2, None, None, None),
    ],
)
def test_ledger_policies(spark, tmp_path, body, skipping, strict, tolerant, kept):
    path = tmp_path / "ledger.jsonl"
    path.write_text(body)
    assert ledger.completed_ids(spark, str(path)).count() == skipping
    for read, n in ((ledger.strict, strict), (ledger.tolerant, tolerant)):
        if n is None:
            with pytest.raises(PySparkException):
                read(spark, str(path), SCHEMA).collect()
        else:
            assert len(read(spark, str(path), SCHEMA).collect()) == n
    if kept is None:
        with pytest.raises(PySparkException):
            ledger.snapshot(spark, str(path)).collect()
    else:
        got = ledger.snapshot(spark, str(path)).first()
        assert (got.json_lines, got.bytes) == (kept, len(GOOD))


def test_missing_ledgers(spark, tmp_path):
    missing = str(tmp_path / "none.jsonl")
    assert ledger.completed_ids(spark, missing).count() == 0
    assert ledger.tolerant(spark, missing, SCHEMA).count() == 0
    with pytest.raises(PySparkException):
        ledger.strict(spark, missing, SCHEMA).collect()


def test_last_record_wins_and_compaction_sorts(spark, tmp_path):
    path, out = tmp_path / "l.jsonl", str(tmp_path / "cache")
    path.write_text('{"id":"b","v":1}\n{"id":"a","v":2}\n{"id":"b","v":3}\n')
    rows = ledger.tolerant(spark, str(path), SCHEMA)
    for _ in range(2):
        ledger.compact(rows, out)
        assert [(r.id, r.v) for r in versions.read(spark, out).collect()] == [("a", 2), ("b", 3)]
    old = tmp_path / "old.json"
    old.write_text('{"x":{"v":5}}')
    assert ledger.keyed_json(spark, str(old), "struct<v:int>").collect() == [("x", 5)]


def test_errors_go_to_their_own_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d", None), ("b", "d", "boom")], "id string, dataset string, error string")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    ledger.split_errors(rows, good, bad)
    assert [spark.read.json(p).select("id").collect()[0].id for p in (good, bad)] == ["a", "b"]


def test_sizes(spark, tmp_path):
    for name, n in (("a", 3), ("b", 1), ("c", 9)):
        (tmp_path / name).write_bytes(b"x" * n)
    pinned = inventory.inventory(spark, [("d", "a", 3), ("d", "b", 3), ("d", "c", 3), ("d", "e", 3)])
    got = {r.file: r.state for r in inventory.verify_sizes(pinned, inventory.present_files(spark, str(tmp_path))).collect()}
    assert got == {"a": "complete", "b": "partial", "c": "oversize", "e": "missing"}
    assert inventory.totals(pinned).first()["bytes"] == 12


# ---- readers ----


def test_json_readers(spark, tmp_path):
    typed = tmp_path / "typed.jsonl"
    typed.write_text("\n".join(json.dumps({"id": str(n), "messages": [{"type": "user", "content": None}, {"type": "system", "content": "s"}, {"type": "assistant", "content": "a"}] * n, "model_name": "m"}) for n in (1, 2)) + "\n")
    got = readers.typed_jsonl(spark, str(typed), "d", min_turns=2).collect()
    assert [(r.source_id, r.exchanges, r.message_turns, r.model) for r in got] == [("2", 2, 4, "m")]
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"id": "1", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "$modelId": "g"}]))
    got = readers.array_json(spark, str(array), "d", min_per_role=1).first()
    assert (got.model, got.user_messages, got.source_file) == ("g", 1, "array.json")
    chosen = tmp_path / "chosen.jsonl"
    chosen.write_text(json.dumps({"conversation_id": "c", "conversation_history": [{"role": "user", "content": "q"}, {"role": "model", "content": "x", "if_chosen": False}, {"role": "model", "content": "y", "if_chosen": True}]}) + "\n")
    got = readers.candidate_jsonl(spark, str(chosen), "d", min_per_role=1).first()
    assert [m.content for m in got.messages] == ["q", "y"]


def test_csv_readers(spark, tmp_path):
    literal = tmp_path / "pairs.csv"
    cell = repr([{"user_question": 'say "hi"\nnow', "AI_response": None}])
    pd.DataFrame([{"conversation_id": "7", "num_turns": 12, "conversation": cell, "LLM_type": "m", "user_id": "u"}, {"conversation_id": "8", "num_turns": 2, "conversation": cell, "LLM_type": "m", "user_id": "u"}]).to_csv(literal, index=False)
    got = readers.literal_csv(spark, str(literal), "d").collect()
    assert [(r.source_id, r.exchanges, r.messages[0].content, r.messages[1].content) for r in got] == [("7", 12, 'say "hi"\nnow', "")]
    folder = tmp_path / "platforms"
    folder.mkdir()
    talk = json.dumps([{"role": "user", "content": "q"}, {"role": "llm", "content": "a"}])
    pd.DataFrame([{"url": "u1", "conversation": talk, "platform": ""}]).to_csv(folder / "one.csv", index=False)
    rows = [("a", "user", "1", "second"), ("a", "assistant", "0", "first"), ("b", "user", "0", "q"), ("b", "assistant", "1", "r"), ("a", "user", "", "x"), ("a", "assistant", "", "y")]
    pd.DataFrame(rows, columns=["conversation_id", "role", "message_index", "plain_text"]).to_csv(folder / "two.csv", index=False)
    got = {r.source_id: r for r in readers.platform_csvs(spark, str(folder), "d", min_per_role=1).collect()}
    assert set(got) == {"u1", "a", "b", "a#occurrence=2"}
    assert got["u1"].platform == "one" and [m.content for m in got["a"].messages] == ["first", "second"]


def test_parquet_reader_and_union(spark, tmp_path):
    path = str(tmp_path / "p")
    said = [("user", "q"), ("assistant", "a")]
    rows = spark.createDataFrame([("x", said, 10, "m", "en"), ("y", said, None, "m", "en")], "conversation_hash string, conversation array<struct<role:string,content:string>>, turn int, model string, language string")
    rows.coalesce(1).write.parquet(path)
    base = readers.nested_parquet(spark, path, "d")
    assert [(r.source_id, r.exchanges) for r in base.collect()] == [("x", 10)]
    gated = readers.nested_parquet(spark, path, "d", min_per_role=2)
    assert gated.count() == 0
    both = readers.union_sources([base, readers.nested_parquet(spark, path, "e", min_turns=0, min_per_role=1)])
    assert readers.positions(both).count() == 3
    with pytest.raises(ValueError):
        readers.require_shards(spark.read.parquet(path), 5)
    assert readers.turn_sample(spark, path, 1).count() == 1


# ---- the stream ----


def test_stream_takes_each_record_once(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    (source / "1.json").write_text('{"id":"a"}\n{"id":"b"}\n')
    for _ in range(2):
        resume.run_available(resume.new_records(spark, str(source), "id string"), lambda df: df.withColumn("label", F.lit("none")), out, marks).awaitTermination()
        (source / "2.json").write_text('{"id":"b"}\n{"id":"c"}\n')
    assert sorted(r.id for r in spark.read.json(out).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize(("block", "most"), [(1, 40), (3, 40), (10, 25), (50, 1000), (1000, 40)])
def test_batches_go_on_across_blocks(spark, block, most):
    lengths = [(i * 7919) % 23 + (60 if i % 31 == 0 else 0) for i in range(150)]
    rows = spark.createDataFrame([(f"k{i:03}", i + (20 if i > 70 else 0), n) for i, n in enumerate(lengths)], "id string, at long, n long").repartition(3)
    got = {r.id: r.batch for r in legacy.pack_batches(rows, key="id", position="at", length="n", max_items=4, max_characters=most, block=block).collect()}
    batch, items, held, want = 0, 0, 0, {}
    for i, n in enumerate(lengths):
        if items and (items >= 4 or held + n > most):
            batch, items, held = batch + 1, 0, 0
        items, held = items + 1, held + n
        want[f"k{i:03}"] = batch
    assert got == want


def test_targets_are_not_ranked_in_one_task(spark):
    said = [("a", "German", "xx"), ("b", "German", "xx"), ("b", "German", "xx"), ("c", "German", "xxx"), ("d", "English", "x"), ("e", "German", None)]
    rows = spark.createDataFrame([(i, lang, None if t is None else [("user", t)]) for i, lang, t in said], f"id string, language string, {SAID}")
    levels = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4), ("d", 5), ("e", 5)], "id string, level int")
    found = translate.targets(rows, levels)
    assert sorted((r.place, r.id) for r in found.collect()) == [(1, "e"), (2, "c"), (3, "a"), (4, "b"), (5, "b")]
    # A window that orders by level has no partition
    assert "row_number() windowspecdefinition(level" in (plan := found._jdf.queryExecution().optimizedPlan().toString())
    assert "DESC" not in plan.split("row_number() windowspecdefinition(")[1].split(",")[0]


@given(st.lists(st.integers(0, 12), max_size=30), st.integers(1, 25), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_chunk_bounds(lengths, limit, overlap):
    bounds = legacy.chunk_bounds(lengths, limit, overlap, 2)
    width = lambda a, b: sum(lengths[a:b]) + 2 * (b - a - 1)
    assert [a for a, _ in bounds] == sorted({a for a, _ in bounds}) and (not lengths or (bounds[0][0], bounds[-1][1]) == (0, len(lengths)))
    for a, b in bounds:
        assert b == a + 1 or width(a, b) <= limit
        assert b == len(lengths) or width(a, b + 1) > limit
    for (a, b), (c, _) in zip(bounds, bounds[1:], strict=False):
        assert c == max(a + 1, b - overlap)


def test_rows_without_a_fingerprint_repeat_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "h"), (4, "h")], "n int, hash string")
    found = {r.n: r.status for r in corpus.dedup_status(rows.limit(0), rows, order=["n"]).collect()}
    assert found == {1: "included", 2: "included", 3: "included", 4: "expansion_dup"}


def test_each_role_has_its_limit(spark):
    rows = spark.createDataFrame([([("user", "u" * 500), ("assistant", "a" * 301), ("user", "v" * 501)],)], SAID)
    got = rows.select(legacy.screened(F.col("messages")).alias("t"), legacy.truncated_count(F.col("messages")).alias("n")).first()
    assert got.n == 2 and got.t == "\n".join(["[U1] " + "u" * 500, "[A1] " + "a" * 132 + " […omitted…] " + "a" * 132, "[U2] " + "v" * 232 + " […omitted…] " + "v" * 232])


def test_chunks_that_fail_are_errors(spark):
    chunks = spark.createDataFrame([("k", 0, "x"), ("k", 1, "boom")], "id string, chunk int, text string")

    def call(text, number, total):
        if text == "boom":
            raise OSError(f"{number} of {total}")
        return {name: {"label": labels[2], "confidence": 0.5} for name, labels in legacy.ORDERS.items()}

    got = sorted(legacy.classify_chunks(chunks, call, pause=0).collect(), key=lambda r: r.chunk)
    assert got[0].review.label == "yes" and got[0].error is None and got[1].review is None and got[1].error == "OSError: 2 of 2"


def test_long_conversations_take_linear_time(spark):
    """20,000 messages in seconds, and as one would do it by hand."""
    import time

    from skeinworks.functions.messages import turn_labels
    from skeinworks.functions import text as tx

    messages = [("user" if i % 3 else "assistant", f"text {i} " * (i % 5)) for i in range(20_000)]
    rows = spark.createDataFrame([(messages,)], SAID)
    began = time.time()
    got = rows.select(turn_labels(F.col("messages")).alias("l"), tx.greedy_chunks(tx.segments(F.col("messages"), 400), 2500).alias("c"), tx.batch_numbers(F.transform("messages", lambda m: F.length(m["content"])), max_items=8, max_characters=400).alias("b")).first()
    assert time.time() - began < 30
    users = others = 0
    labels = []
    for role, _ in messages:
        users, others = users + (role == "user"), others + (role != "user")
        labels.append(f"U{users}" if role == "user" else f"A{others}")
    chunks, batches, held = [], [], (0, 0)
    for label, (_, text) in zip(labels, messages, strict=True):
        piece = f"[{label}] {text}"
        if chunks and len(chunks[-1]) + 2 + len(piece) <= 2500:
            chunks[-1] += "\n\n" + piece
        else:
            chunks.append(piece)
        full = held[0] and (held[0] >= 8 or held[1] + len(text) > 400)
        batches.append((batches[-1] if batches else 0) + bool(full))
        held = (1, len(text)) if full else (held[0] + 1, held[1] + len(text))
    assert got.l == labels and got.c == chunks and got.b == batches


def test_escapes_are_in_lower_case(spark):
    from skeinworks.functions.messages import compact_json

    texts = ["", "\x0b\x0e\x0f\x1a\x1f\x7f", "\\u001F \\", "\\\\u000B\x0b", "\"\x1c\n\t\x08\f\r/é😀 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in rows.select("i", compact_json(F.struct("t")).alias("j")).collect()}
    assert got == {i: json.dumps({"t": t}, ensure_ascii=False, separators=(",", ":")) for i, t in enumerate(texts)}
