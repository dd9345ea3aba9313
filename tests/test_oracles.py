"""Every registered query with an SQL twin gives the twin's rows, also when the input is dealt anew."""

import glob
import math
import os

import duckdb
import pytest

from loomlight.plans import extra_queries, relation_queries, span_queries  # noqa: F401
from loomlight.plans.registry import ORACLES, QUERIES


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    twin = duck.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in twin.description], twin.fetchall())


def test_queries_without_a_twin():
    assert set(QUERIES) - set(ORACLES) == {"o05_seeded_sample", "o07_distinct_behaviours"}
