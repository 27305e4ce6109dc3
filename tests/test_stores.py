"""Folders replaced in one step, and caches in buckets."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skeinworks.sources import buckets, corpora, gzips, ranges, readers, versions
from test_ranges import SIZES, cut_at


def of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def held(spark, path):
    return sorted(r["id"] for r in versions.read(spark, path).collect())


def test_readers_see_the_old_version_or_the_new_one(spark, tmp_path):
    path = str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.replace(of(spark, "a"), path)
    reader = versions.read(spark, path)

    def write(draft):
        of(spark, "b").write.parquet(draft)
        assert held(spark, path) == ["a"]  # between the write and the rename

    assert versions.publish(spark, path, write) == 2
    assert held(spark, path) == ["b"] and [r["id"] for r in reader.collect()] == ["a"]
    versions.replace(versions.read(spark, path).union(of(spark, "c")), path)
    assert held(spark, path) == ["b", "c"] and versions.numbers(spark, path) == [1, 2, 3]
    assert versions.vacuum(spark, path) == [1, 2] and held(spark, path) == ["b", "c"]


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    versions.replace(of(spark, "a"), path)

    def slow(draft):
        of(spark, "slow").write.parquet(draft)
        versions.replace(of(spark, "fast"), path)

    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, slow)
    assert held(spark, path) == ["fast"] and sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["version=1", "version=2"]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    versions.replace(of(spark, "a"), path)
    with pytest.raises(PySparkException):
        versions.replace(of(spark, "b").select(F.raise_error(F.col("id")).cast("string").alias("id")), path)
    assert held(spark, path) == ["a"] and [p.name for p in (tmp_path / "cache").iterdir()] == ["version=1"]


RECORDS = st.dictionaries(st.integers(0, 12), st.one_of(st.none(), st.integers(0, 2)), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(RECORDS, min_size=1, max_size=4))
def test_stores_as_a_dictionary_does(spark, tmp_path_factory, batches):
    path, want = str(tmp_path_factory.mktemp("cache") / "c"), {}
    schema = "id long, v long"
    for batch in batches:
        counts = buckets.store(spark.createDataFrame(list(batch.items()), schema), path, buckets=4)
        expected = {"appended": len(batch.keys() - want.keys()), "unchanged": sum(k in want and want[k] == v for k, v in batch.items()), "rewritten": sum(k in want and want[k] != v for k, v in batch.items()), "kept": len(want.keys() - batch.keys())}
        want |= batch
        assert counts == {k: n for k, n in expected.items() if n}
        if want:
            assert sorted(buckets.read(spark, path).collect()) == sorted(want.items())


def test_a_store_writes_the_buckets_that_change(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "id string, v int")
    buckets.store(rows, path, buckets=16)
    files = lambda: {p for p in (tmp_path / "cache" / "data").rglob("*.parquet")}
    first = files()
    assert len(first) == 16
    assert buckets.store(spark.createDataFrame([("k7", -7)], "id string, v int"), path) == {"rewritten": 1, "kept": 199}
    second = files() - first
    assert len(second) == 1 and dict(buckets.read(spark, path).collect())["k7"] == -7
    assert buckets.store(spark.createDataFrame([("new", 0)], "id string, v int"), path) == {"appended": 1, "kept": 200}
    assert len(files() - first - second) == 1
    assert buckets.store(rows.where("v = 3"), path) == {"unchanged": 1, "kept": 200} and len(files()) == 18
    # The bucket of "new" has one appended folder
    assert buckets.compact(spark, path, most=1) == []
    done = buckets.compact(spark, path, most=0)
    assert len(done) == 1 and set(r["kind"] for r in buckets.manifest(spark, path).collect()) == {"base"} and buckets.read(spark, path).count() == 201


def test_stores_that_are_errors(spark, tmp_path):
    path = str(tmp_path / "cache")
    for rows in ([(None, 1)], [("a", 1), ("a", 1)]):
        with pytest.raises(ValueError, match="distinct keys"):
            buckets.store(spark.createDataFrame(rows, "id string, v int"), path)
    assert versions.numbers(spark, path) == []


def test_a_store_that_lost_a_race_leaves_the_cache(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    one = lambda v: spark.createDataFrame([("a", v)], "id string, v int")
    buckets.store(one(1), path)
    written = buckets._written

    def late(rows, at):
        monkeypatch.setattr(buckets, "_written", written)
        buckets.store(one(2), path)
        return written(rows, at)

    monkeypatch.setattr(buckets, "_written", late)
    with pytest.raises(versions.Conflict):
        buckets.store(one(3), path)
    assert buckets.read(spark, path).collect() == [("a", 2)]


@pytest.mark.parametrize("size", SIZES)
def test_entries_of_every_cut(spark, tmp_path, size):
    import json

    value = {'k"{}': {"v": [{"x": "}"}, {}]}, "": {}, "\\": {"a": '"'}, "é😀": {"deep": {"er": {}}}}
    (tmp_path / "a.json").write_text(json.dumps(value, indent=1, ensure_ascii=False))
    with cut_at(spark, size):
        found = ranges.json_entries(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r["key"], json.loads(r["value"])) for r in found] == list(value.items())


def test_gzip_members(spark, tmp_path, monkeypatch):
    """Any reader of gzip sees the lines in order; ours begins at members, in several tasks."""
    import gzip
    import json

    monkeypatch.setattr(gzips, "TASK_BYTES", 400)
    path, rows = f"file://{tmp_path}/corpus", [(i, f"n{i}", "text é\n" * (i % 7), None) for i in range(90)]
    corpora.write_ordered(spark.createDataFrame(rows, "position long, id string, text string, nothing string").repartition(5), path, part_rows=40, member_bytes=300)
    said = []
    for part in (0, 1, 2):
        with gzip.open(tmp_path / "corpus" / f"part={part}" / gzips.FILE, "rt", encoding="utf-8") as lines:
            said += [json.loads(line) for line in lines]
    assert said == [{"id": i, "text": t, "nothing": None} for _, i, t, _ in rows]
    found = corpora.read_ordered(spark, path, "id string, text string", part_rows=40)
    assert sorted(tuple(r) for r in found.collect()) == [(p, i, t) for p, i, t, _ in rows]
    index = spark.read.schema(gzips.INDEX).json(f"{path}/_index")
    assert index.count() > 10 and found.rdd.getNumPartitions() > 3
    plain = spark.read.schema("id string").json(path)  # without the index
    assert sorted(r["id"] for r in plain.collect()) == sorted(r["id"] for r in readers.corpus_jsonl(spark, path, "id string").collect()) == sorted(i for _, i, _, _ in rows)
    # A task that is tried again replaces the part's file
    corpora.gzips._PartFile(path, 0, 300).close()
    assert [p.name for p in (tmp_path / "corpus" / "part=0").glob("*.gz")] == [gzips.FILE]
    with pytest.raises(Exception, match="(lines at|gzip|EOF|ended)"):
        found.collect()


def test_an_empty_corpus(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    corpora.write_ordered(spark.createDataFrame([], "position long, id string"), path)
    assert corpora.read_ordered(spark, path, "id string").count() == 0 and readers.corpus_jsonl(spark, path, "id string").count() == 0
