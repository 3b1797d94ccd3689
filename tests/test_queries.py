"""A cross-section of the registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
CHECKED = ("a02_breakdown", "a06_token_distribution", "a09_relevance", "f05_match_exact_abstain", "j07_facts_at_checkpoints", "j13_declared_requests",
           "r_archive_rules", "score_runs", "w03_ledger", "w05_repeat_index", "w07_context_growth")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    frame = queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = db.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in frame.select(*columns).collect()) == theirs


def test_entry_and_registry(spark):
    assert entry(spark).columns[:3] == ["runId", "dimension", "label"]
    assert set(oracle_sql()) <= set(queries())
