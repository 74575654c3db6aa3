"""Every query outside the corpus operators against its DuckDB text, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tocsin import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(x, 6) if isinstance(x, float) else x


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert list(got.columns) == df.columns
        return
    sql = catalogue.ORACLE_SQL[name]
    kinds = dict(duck.execute(f"DESCRIBE {sql}").fetchdf()[["column_name", "column_type"]].values)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    assert rows(got) == rows(duck.execute(sql).fetchdf())
