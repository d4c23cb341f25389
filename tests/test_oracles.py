"""Every core query with SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid.plans import core

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    df = core.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    relation = duck.sql(core.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_core_plans(spark, sf_dir):
    """Core queries stay in the JVM."""
    for name, build in core.queries().items():
        plan = build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow")), name
        assert "CartesianProduct" not in plan, name
