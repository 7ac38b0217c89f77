"""Every query with SQL gives the same rows as that SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from brackwater.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, str(DATA))
    cols = sorted(got.columns)
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    left = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect())
    right = sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    assert left == right


def test_learnt_weights_are_bounded(spark):
    rows = {r["feature"]: r["weight"] for r in plans.QUERIES["learn_weights"](spark, str(DATA)).collect()}
    assert set(rows) == {"history", "ppr"} and all(0 <= w <= 1.5 for w in rows.values())


def test_entry_has_rows_and_oracles_have_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_calls_are_dealt_over_tasks_and_classified_once(spark, monkeypatch):
    from brackwater.plans import queries

    monkeypatch.setattr(queries, "CALLERS", 50)
    found = queries.resource_classify(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() > 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("monotonically_increasing_id") == 1  # the rules stand in the plan once
