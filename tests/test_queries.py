"""Every query with SQL gives the rows of its SQL (smallest tables)."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import registry

SF = "/root/testdata/sf0.001"


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect())
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == cols
    assert got == sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "name", "type", "depth"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
