"""Every registered query: unique names, oracles that belong to queries, and equal results at the smallest scale."""

import math
import os

import duckdb
import pytest

from weftgraph.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def cell(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) == sum(len(m.QUERIES) for m in registry._modules())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    mine = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=repr)
    out = duck.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(cell(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in out.fetchall()), key=repr)
    same = lambda a, b: a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) < 1e-6)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert (rows or name == "fuzzy_merge") and all(any(v is not None for v in r) for r in rows)  # no two names are that alike here
