"""Every catalog query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from codelattice.plans import catalog, code_relations

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        if isinstance(x, float) or "float" in type(x).__name__:
            return repr(round(float(x), 6)) if float(x) != int(x) else str(int(x))
        return str(int(x)) if hasattr(x, "__int__") and not isinstance(x, str) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


QUERIES, ORACLES = catalog.QUERIES | code_relations.QUERIES, catalog.ORACLES | code_relations.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
