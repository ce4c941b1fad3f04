"""Every registered query with an oracle against DuckDB."""

import glob
import os

import duckdb
import pytest

from noteproof import plans, registry

plans.load()
SF = "/root/testdata/sf0.001"
WHOLE = "/root/testdata/sf0.01"


def _norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(_norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", ["cadence_gaps", "trust_score", "history_tail"])
def test_exact_values_of_larger_tables(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{WHOLE}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, WHOLE).select(*want.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    got = sorted(repr(tuple(_norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    assert got == sorted(repr(tuple(_norm(r[k]) for k in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry_imports_and_names_agree():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
