import duckdb
import pytest

from crestline.plans import cases, queries

QUERIES, ORACLE_SQL = queries.QUERIES | cases.QUERIES, queries.ORACLE_SQL | cases.ORACLE_SQL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in ("nation", "events", "documents"):
        c.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    order = sorted(df.columns)
    key = lambda row: tuple(str(x) for x in row)
    ours = sorted((tuple(r[c] for c in order) for r in rows), key=key)
    theirs = sorted((tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall()), key=key)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query", "count", "score", "anomaly"]
