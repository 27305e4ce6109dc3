"""Every corpus query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from skeinworks.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in ("conversations", "documents", "events", "labels", "orders", "pages"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    ours = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "exchanges", "user_messages", "assistant_messages", "message_turns", "characters"]
