"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import depweave.catalog as catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(f"{float(x):.9g}")
    return x.item() if hasattr(x, "item") else x


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(([plain(x) for x in r] for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        assert table(got) == table(duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got) > 0
