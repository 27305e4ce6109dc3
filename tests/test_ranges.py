"""Files read in ranges: whatever the cuts, the records are those of a reader that goes from front to back."""

from __future__ import annotations

import ast
import csv
import hashlib
import io
import itertools
import json
import random
from contextlib import contextmanager

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.operators.corpus import run_keys, runs
from skeinworks.sources import files, inventory, ledger, ranges, readers


@contextmanager
def cut_at(spark, size):
    """Ranges of ``size`` bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


SIZES = [7, 64, 1 << 20]


@pytest.mark.parametrize("size", SIZES)
def test_lines_of_every_cut(spark, tmp_path, size):
    texts = {"a": '{"id":"é😀"}\n\n{"id":2}\n', "b": "", "c": '{"id":1}\r\nbroken\n{"id":', "d": "\n\n", "e": '{"n":"' + "x" * 200 + '"}', "f": "".join(f'{{"id":"{i}"}}\n' for i in range(60))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with cut_at(spark, size):
        rows = ledger.lines(spark, str(tmp_path)).collect()
        assert size > 7 or ranges.pieces(spark, str(tmp_path / "f")).select("block").distinct().count() > 10
    got = {name: sorted((r["line_no"], r["line"], r["ended"]) for r in rows if r["path"].endswith(f"/{name}")) for name in texts}
    for name, text in texts.items():
        parts = text.split("\n")
        want = [(i, p, i < len(parts) - 1) for i, p in enumerate(parts) if i < len(parts) - 1 or p]
        assert got[name] == want, name


@pytest.mark.parametrize("size", SIZES)
def test_policies_and_snapshot_of_every_cut(spark, tmp_path, size):
    whole = "".join(f'{{"id":"c{i}"}}\n' for i in range(40))
    shapes = {"clean": whole, "cut": whole + '{"id":', "valid": whole + '{"id":"x"}', "middle": whole + "{bad\n" + whole, "empty": "", "begun": '{"id"'}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
    at = lambda name: str(tmp_path / name)
    with cut_at(spark, size):
        assert [ledger.tolerant(spark, at(n), "id string").count() for n in ("clean", "cut", "valid", "empty")] == [40, 40, 41, 0]
        assert ledger.strict(spark, at("valid"), "id string").count() == 41
        for read in (lambda: ledger.strict(spark, at("cut"), "id string"), lambda: ledger.tolerant(spark, at("middle"), "id string"), lambda: ledger.snapshot(spark, at("middle"))):
            with pytest.raises(Exception, match="broken line 41"):
                read().collect()
        for name, kept in (("clean", whole), ("cut", whole), ("valid", whole), ("begun", "")):
            row = ledger.snapshot(spark, at(name)).first()
            assert (row["file"], row["bytes"], row["json_lines"], row["sha256"]) == (name, len(kept), kept.count("\n"), hashlib.sha256(kept.encode()).hexdigest())
    assert ledger.tolerant(spark, at("none"), "id string").count() == 0
    with pytest.raises(Exception, match="none"):
        ledger.tolerant(spark, at("none"), "id string", missing_ok=False).collect()


FIELDS = ["", "plain", 'say "hi"', "two\nlines", "a,b", '"', "é😀", "\n", "x" * 50, '",\n"']


@pytest.mark.parametrize("size", SIZES)
def test_csv_records_of_every_cut(spark, tmp_path, size):
    rng = random.Random(5)
    tables = {}
    for name, head in (("one.csv", ["id", "text", "more"]), ("two.csv", ["text", "id"]), ("only head.csv", ["id"])):
        rows = [[f"r{i}", *(rng.choice(FIELDS) for _ in head[1:])] for i in range(0 if len(head) == 1 else 25)]
        tables[name] = head, rows
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if name == "two.csv" else "\n")
        writer.writerows([head, *rows])
        (tmp_path / name).write_text(out.getvalue() + ("\n" if name == "one.csv" else ""), newline="")
    with cut_at(spark, size):
        found = readers.csv_cells(spark, str(tmp_path)).select("source_file", "number", "names", "cells", readers._cell("text").alias("text"), readers._cell("nothing").alias("nothing")).collect()
    for name, (head, rows) in tables.items():
        mine = sorted((r for r in found if r["source_file"] == name), key=lambda r: r["number"])
        assert [r["names"][: len(head)] for r in mine] == [head] * len(rows)
        assert [[c or "" for c in r["cells"][: len(head)]] for r in mine] == rows
        assert [r["number"] for r in mine] == list(range(1, len(rows) + 1))
        if rows:
            assert [r["text"] or "" for r in mine] == [row[head.index("text")] for row in rows] and {r["nothing"] for r in mine} == {None}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("indent", [None, 2])
def test_json_records_of_every_cut(spark, tmp_path, size, indent):
    said = ["", "{", "}", '"', '\\"', "a } b { c", "\\", '\\\\"}', "},\n{", "é😀", '[{"x":"}"}]']
    rng = random.Random(6)
    rows = [{"id": str(i), "deep": {"k": [{"v": rng.choice(said)}, {}]}, "said": [{"from": rng.choice(said), "value": rng.choice(said)} for _ in range(rng.randrange(4))]} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text(" [ ] ")
    (tmp_path / "c.json").write_text(json.dumps(rows[:1], indent=indent))
    with cut_at(spark, size):
        found = ranges.json_records(spark, str(tmp_path)).orderBy("path", "number").collect()
    assert [json.loads(r["record"]) for r in found] == rows + rows[:1]
    assert [r["number"] for r in found] == [*range(30), 0]


def test_array_release_in_ranges(spark, tmp_path):
    """The reader's records don't depend on where a file is cut."""
    talk = [{"from": role, "value": f'{role} says: "}}{{" \\ {i}'} for i in range(3) for role in ("human", "gpt")]
    (tmp_path / "a.json").write_text(json.dumps([{"id": f"t{i}", "conversations": talk[: 2 + i % 5]} for i in range(40)]))
    read = lambda: sorted(map(str, readers.array_json(spark, str(tmp_path), "d", min_per_role=2).collect()))
    whole = read()
    with cut_at(spark, 50):
        assert read() == whole and len(whole) == 24


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from(["a", "b", None])), max_size=30), st.integers(1, 7))
def test_runs_of_every_cut(spark, keys, size):
    rows = [(w, i, i // size, k) for i, (w, k) in enumerate(keys)]
    df = spark.createDataFrame(rows, "w int, at int, part int, k string")
    found = runs(df, key="k", order="at", part="part", within=["w"])
    want, named = {}, {}
    for w in (0, 1):
        seen = {}
        mine = [(i, k) for v, i, _, k in rows if v == w]
        for n, (key, group) in enumerate(itertools.groupby(mine, key=lambda x: x[1]), 1):
            seen[key] = seen.get(key, 0) + 1
            group = list(group)
            want |= {i: n for i, _ in group}
            named[w, n] = (len(group), key if seen[key] == 1 or key is None else f"{key}#occurrence={seen[key]}")
    assert {r["at"]: r["run"] for r in found.collect()} == want
    assert {(r["w"], r["run"]): (r["rows"], r["run_key"]) for r in run_keys(found, key="k", part="part", within=["w"]).collect()} == named


def test_turn_release_in_ranges(spark, tmp_path):
    keys = "aabbbaacaab"
    out = io.StringIO()
    csv.writer(out).writerows([["conversation_id", "role", "plain_text"], *([k, ("user", "model")[i % 2], f"line {i}\nof, {k}"] for i, k in enumerate(keys))])
    (tmp_path / "turns.csv").write_text(out.getvalue(), newline="")
    read = lambda: sorted(map(str, readers.turn_csv(spark, str(tmp_path), "d", min_per_role=1).collect()))
    whole = read()
    assert [s for s in ("source_id='a#occurrence=2'", "source_id='b'", "source_id='a'", "source_id='a#occurrence=3'") if any(s in r for r in whole)] == ["source_id='a#occurrence=2'", "source_id='b'", "source_id='a'", "source_id='a#occurrence=3'"]
    with cut_at(spark, 11):
        assert read() == whole


# ---- literals ----

CELLS = [
    """[{'a': 'it\\'s "so"', "b": "say \\"x\\" and 'y'"}]""", "[{'a': None, 'b': True, 'c': [1, -2.5, 1e3, False]}]", "[{'a': 'back\\\\slash\\\\', 'b': 'line\\nend\\ttab'}]", "[]", " [ ] ", '[{"a": "null"}]',
    "[{'a': '\\\\\\'quote'}]", "[['nested', ['deep', []]], {}]", "['é😀']",
]
BEYOND = ["[{'a': 'x' 'y'}]", "[('a', 'b')]", "['\\x41']", "[u'x']", "['\\u0041']", "[1,]", "['a\tb']", "[{1: 2}]", "['']", "['''x''']"]


def test_literals_by_expressions(spark):
    rows = spark.createDataFrame([(c,) for c in CELLS + BEYOND], "cell string")
    found = {r["cell"]: r["json"] for r in rows.select("cell", readers.literal_as_json(F.col("cell")).alias("json")).collect()}
    for cell in CELLS:
        assert json.loads(found[cell]) == ast.literal_eval(cell.replace("null", "null").strip()), cell
    for cell in BEYOND:  # left to Python, or no JSON
        value = found[cell]
        try:
            assert value is None or json.loads(value) == json.loads(json.dumps(ast.literal_eval(cell)))
        except ValueError:
            pass


@settings(max_examples=30, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), st.text(alphabet="ab'\"\\\n\t{}[]:,é", max_size=8), max_size=2), max_size=3))
def test_any_list_comes_back(spark, value):
    rows = spark.createDataFrame([(repr(value),), (json.dumps(value),)], "conversation string")
    got = [r["conversation"] for r in readers.parsed_cells(rows, "array<map<string,string>>").collect()]
    assert got == [value, value]


def test_long_literals_need_no_stack(spark):
    text = "it's \\ \"quoted\"\n" * 20_000
    rows = spark.createDataFrame([(repr([{"a": text}]),), (json.dumps([{"a": text}]),)], "conversation string")
    found = rows.select(readers.literal_as_json(F.col("conversation")).isNotNull().alias("by_expressions")).collect()
    assert found[0]["by_expressions"] and [r["conversation"][0]["a"] for r in readers.parsed_cells(rows, "array<struct<a:string>>").collect()] == [text, text]


def test_json_cells_stay_in_the_jvm(spark, monkeypatch):
    """A function in Python that fails on any cell is never given one of JSON, or of a plain literal."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def refuses(cells):
        if cells.notna().any():
            raise ValueError("a cell has come to Python")
        return cells

    monkeypatch.setattr(readers, "_evaluated", refuses)
    rows = spark.createDataFrame([('[{"a": "x"}]',), ("[{'a': 'y'}]",)], "conversation string")
    assert [r["conversation"][0]["a"] for r in readers.parsed_cells(rows, "array<struct<a:string>>").collect()] == ["x", "y"]


def test_cells_that_are_no_lists_are_errors(spark):
    for cell in ("{'a': 1}", '{"a": 1}', "3", "oops ["):
        with pytest.raises(Exception, match="(not a list|literal|syntax|EOF|malformed|closed)"):
            readers.parsed_cells(spark.createDataFrame([(cell,)], "conversation string"), "array<string>").collect()


# ---- files ----


def test_hashes_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 10)
    contents = {"a": b"-", "b b%": b"x" * 37, "c": bytes(range(256))}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    listed = files.listed(spark, str(tmp_path))
    assert {r["length"]: r["sha256"] for r in files.hashed(listed).collect()} == {len(raw): hashlib.sha256(raw).hexdigest() for raw in contents.values()}
    assert files.sha256_of(f"file://{tmp_path}/c", 5) == hashlib.sha256(bytes(range(5))).hexdigest()
    with pytest.raises(OSError, match="early"):
        files.sha256_of(f"file://{tmp_path}/c", 300)
    good = hashlib.sha256(contents["c"]).hexdigest()
    pinned = spark.createDataFrame([("d", "c", 256, good), ("d", "a", 1, good), ("d", "z", 1, good), ("d", "c", 300, good)], "dataset string, file string, bytes long, sha256 string")
    found = inventory.verify_hashes(pinned, inventory.present_files(spark, str(tmp_path)))
    assert sorted((r["file"], r["bytes"], r["state"]) for r in found.collect()) == [("a", 1, "changed"), ("c", 256, "complete"), ("c", 300, "partial"), ("z", 1, "missing")]
