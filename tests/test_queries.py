"""Every registered citation query against its SQL, on the small tables."""

import os

import duckdb
import pytest

from bibloom.plans import catalog
from bibloom.sources.recipes import TABLES

from .conftest import SF


def norm(v):
    if v is None or isinstance(v, bool):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(found, names):
    return sorted(str([norm(r[names.index(c)]) for c in sorted(names)]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), names)


def test_every_query_of_the_entry_module_is_listed():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert os.path.isdir(SF)
