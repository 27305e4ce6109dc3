"""Runners around a model, with doubles for the model."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.functions.text import long_date
from skeinworks.operators import inference, translate

QUIET = {"c": "no", "e": False, "a": False, "u": False, "x": False, "d": False, "z": False, "r": "none", "q": "no"}


def test_retries():
    calls = []

    def fails(times):
        def call(x):
            calls.append(x)
            if len(calls) <= times:
                raise OSError("busy")
            return x

        return call

    assert inference.retried(fails(2), pause=0)(7) == 7 and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        inference.retried(fails(5), pause=0)(7)
    assert len(calls) == 3


def test_later_parts_only_after_a_positive_first(spark):
    rows = spark.createDataFrame([("quiet", ["no", "x"]), ("loud", ["yes", "x", "y"]), ("bad", ["boom"])], "id string, chunks array<string>")

    def first(text):
        if text == "boom":
            raise ValueError("boom")
        return QUIET | {"c": text}

    found = {r.id: r for r in inference.assess_in_parts(rows, first, lambda so_far, part: so_far | {"f": part, "q": "yes"}, pause=0).collect()}
    assert (found["quiet"].audited_chunks, found["quiet"].total_chunks, found["quiet"].findings) == (1, 2, [])
    assert (found["loud"].audited_chunks, found["loud"].findings) == (3, ["x", "y"]) and '"q":"yes"' in found["loud"].assessment
    assert found["bad"].error == "ValueError: boom" and found["bad"].assessment is None


@pytest.mark.parametrize("key", [k for k in QUIET if k != "c"])
def test_any_sign_is_positive(key):
    assert not inference.is_positive(QUIET)
    assert inference.is_positive(QUIET | {key: "maybe" if key in "rq" else True})


def test_batches_fall_back_to_single_items(spark):
    rows = spark.createDataFrame([([("a", "x"), ("b", "y")],), ([("c", "z")],), ([("d", "lost")],)], "items array<struct<id:string,text:string>>")

    def call(texts):
        if "lost" in texts:
            return {}
        return {i: {"c": t, "r": "none", "q": "no"} for i, t in enumerate(texts[:1])}

    found = {r.id: (r.c, r.error is None) for r in inference.screen_batches(rows, call, pause=0).collect()}
    assert found == {"a": ("x", True), "b": ("y", True), "c": ("z", True), "d": (None, False)}


def test_translation_there_and_back(spark):
    talk = spark.createDataFrame([("k", [("user", "ein langer Satz, der in Stücke geht"), ("assistant", ""), ("user", "ok")])], "id string, messages array<struct<role:string,content:string>>")
    parts = translate.pieces(talk, limit=12)
    done = inference.translate_batches(translate.batched(parts, max_items=2), lambda texts: [t.replace("e", "E") for t in texts], pause=0)
    assert done.where("error IS NOT NULL").count() == 0
    back = translate.reassemble(parts, done).first()["translations"]
    assert back == ["Ein langEr Satz, dEr in StückE gEht", "", "ok"]
    short = inference.translate_batches(translate.batched(parts), lambda texts: texts[1:], pause=0)
    assert {r.error for r in short.collect()} == {"ValueError: unfaithful translation"}


def test_sums_progress_and_dates(spark):
    parts = spark.createDataFrame([("a", 0.1, 2), ("a", None, 3)], "id string, seconds double, tokens int")
    assert tuple(inference.summed_metrics(parts, "id", "seconds", "tokens").first()) == ("a", 0.1, 5)
    assert inference.progress(parts.withColumn("error", F.lit(None).cast("string"))).count() == 2
    assert spark.createDataFrame([(datetime.date(2026, 3, 7),)], "d date").select(long_date(F.col("d")).alias("x")).first()["x"] == "7 March 2026"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=5), st.text("cd", max_size=9)), max_size=4), st.integers(0, 1))
def test_faithful_answers_as_in_tasks(spark, pairs, short):
    sources, answers = [s for s, _ in pairs], [t for _, t in pairs][short:]
    row = spark.createDataFrame([(sources, answers)], "s array<string>, t array<string>").select(inference.faithful_answers(F.col("s"), F.col("t"), least=3, times=2).alias("ok")).first()
    assert row.ok == inference.faithful(sources, answers, least=3, times=2)
