"""Every query against its SQL in DuckDB on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from granary.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return None if isinstance(v, float) and math.isnan(v) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    q = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in q.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, q.fetchall())


def test_comparison_sees_a_difference(spark, con):
    df = catalogue.QUERIES["type_resolution"](spark, DATA)
    q = con.execute("SELECT p_partkey AS chunk_id, 'Item' AS label FROM part")
    assert rows(df.columns, df.collect()) != rows(["chunk_id", "label"], q.fetchall())
    assert con.execute("SELECT count(*) FROM documents WHERE length(text) > 1500").fetchone()[0] == spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 1500").count()
