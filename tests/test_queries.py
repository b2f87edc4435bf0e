"""Every registered query of the library against its SQL on a second engine, and the registry's shape."""

import duckdb
import pytest

from lodestone.plans.catalog import QUERIES, SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def tidy(v):
    if v is None or v != v:
        return None
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    sql = con.sql(SQL[name])
    assert sorted(sql.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    want = con.sql(f"SELECT {names} FROM ({SQL[name]})").fetchall()
    assert sorted(str([tidy(v) for v in r]) for r in want) == sorted(str([tidy(r[c]) for c in cols]) for r in rows)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["question_id", "chunk_id", "score", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
