"""The registered queries of the problems against their SQL, and what must hold of those without."""

import os

import duckdb
import pytest

from weftgraph.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, sf_dir, duck, name):
    cell = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    mine = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=repr)
    out = duck.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
