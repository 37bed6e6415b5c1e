"""Every registered query of the library against its SQL, over the small tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from harvestry.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    got = Counter(repr(tuple(r)) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalog.ORACLES:
        return
    relation = duck.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == Counter(map(repr, duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()))


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
