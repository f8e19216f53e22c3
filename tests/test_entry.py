"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from facetloom.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else f"{x:.5f}" if isinstance(x, float) else str(x)
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in registry.ORACLES:
        cursor = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert got == rows(cursor.fetchall(), names)
