"""Assessment with state, and progress as rows."""

from __future__ import annotations

import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinworks.plans import catalog, runs
from skeinworks.streaming import assess, resume

NO = {"c": "no", "e": False, "a": False, "u": False, "x": False, "d": False, "z": False, "r": "none", "q": "no"}


@pytest.fixture
def stores(spark):
    before = {k: spark.conf.get(k, None) for k in assess.STORE}
    for k, v in assess.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_assessment_goes_on_where_it_failed(spark, tmp_path, stores):
    """One conversation fails once at its third part, one always at its second, one is done after its first; a call leaves a file."""
    source, out, marks, calls = (str(tmp_path / x) for x in ("in", "out", "marks", "calls"))
    (tmp_path / "calls").mkdir()

    def note(text):
        with open(f"{calls}/{text}-{time.time_ns()}", "w"):
            pass

    def first(text):
        note(text)
        return NO | {"c": "no" if text.startswith("no") else "yes"}

    def more(so_far, text):
        import os

        note(text)
        if text == "c1" or (text == "a2" and sum(f.startswith("a2-") for f in os.listdir(calls)) < 2):
            raise OSError(f"busy with {text}")
        return so_far | {"f": text}

    rows = [("a", ["a0", "a1", "a2", "a3"]), ("b", ["no0", "b1"]), ("c", ["c0", "c1", "c2"]), ("d", ["d0"])]
    spark.createDataFrame(rows, "id string, chunks array<string>").write.json(source)
    stream = spark.readStream.schema("id string, chunks array<string>").json(source)
    assess.run_until_idle(assess.assess_in_parts(stream, first, more, pause=0.1), out, marks, every=0.1)
    found = {r["id"]: r for r in spark.read.schema(f"id string, {assess.ASSESSED}").json(out).collect()}
    assert {k: (r["total_chunks"], r["audited_chunks"], r["findings"], r["error"]) for k, r in found.items()} == {
        "a": (4, 4, ["a1", "a2", "a3"], None), "b": (2, 1, [], None), "c": (3, 0, [], "OSError: busy with c1"), "d": (1, 1, [], None),
    }
    assert json.loads(found["a"]["assessment"])["c"] == "yes" and found["c"]["assessment"] is None
    asked = [p.name.rpartition("-")[0] for p in (tmp_path / "calls").iterdir()]
    assert {t: asked.count(t) for t in set(asked)} == {"a0": 1, "a1": 1, "a2": 2, "a3": 1, "no0": 1, "c0": 1, "c1": 3, "d0": 1}


def test_progress_of_repeated_and_empty_runs(spark, tmp_path):
    source, out, marks, rows_of = (str(tmp_path / x) for x in ("in", "out", "marks", "progress"))
    run = lambda: resume.run_available(resume.new_records(spark, source, "id string, error string"), lambda b: b, out, marks, progress=rows_of, total=4).awaitTermination()
    for rows in ([("a", None), ("b", "x")], [("b", None), ("c", "y"), ("d", "z")]):
        spark.createDataFrame(rows, "id string, error string").write.mode("append").json(source)
        run()
    run()
    found = resume.read_progress(spark, rows_of).orderBy("batch").collect()
    assert [(r["batch"], r["processed"], r["failed"], r["processed_so_far"], r["failed_so_far"], r["total"]) for r in found if r["processed"]] == [(0, 2, 1, 2, 1, 4), (1, 2, 2, 4, 3, 4)]
    assert all(r["seconds"] > 0 and r["per_hour"] >= 0 for r in found)


def test_calls_of_equal_conversations_are_told_apart(spark, tmp_path):
    """Conversations given three times over: each copy's parts fail once of their own, as in the SQL."""
    said = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 40")
    copies = said.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumn("conv_id", F.col("conv_id") + F.col("copy") * 1_000_000).drop("copy")
    copies.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["n11_continued"])
    got = catalog.QUERIES["n11_continued"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_a_noted_call_lists_no_folder(tmp_path, monkeypatch):
    """What a call costs doesn't grow with the calls before it."""
    monkeypatch.setattr(runs.pafs, "FileSelector", None)
    for part in ("a", "b"):
        with pytest.raises(OSError, match="busy"):
            runs._noted(f"file://{tmp_path}", part, True)
        runs._noted(f"file://{tmp_path}", part, True)
    assert sum(p.is_file() for p in tmp_path.rglob("*")) == 4
