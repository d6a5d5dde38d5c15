import datetime
import math

import duckdb
import pytest

from loomgraph.plans import registry
from loomgraph.plans.world import TABLES

ORACLES = registry.oracle_sql()


def cell(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_predicate_filters_prune_scans(spark, sf):
    from loomgraph.operators import algebra as A
    from loomgraph.plans import world as W

    plan = A.match(W.triples(spark, sf), ("?s", "kg:hasExtension", ".py"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "orders" in plan
