"""Every query against its SQL twin, and the driver's entry points."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not re.match(r"op\d+_", n)))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    r = duck.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == cols
    want = sorted(map(repr, r.select(*[f'"{c}"' for c in cols]).fetchall()))
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == want


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 35 and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["item_features_documents", "image_features", "item_features_full"])
def test_queries_without_sql(spark, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir)
    assert rows.count() > 0 and len(rows.columns) == {"item_features_documents": 35 + 1 - 1, "image_features": 14, "item_features_full": 46}[name]
