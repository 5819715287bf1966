"""Every query with SQL against DuckDB on the smallest tables, where they are."""

import os

import duckdb
import pytest

from lodegraph import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: v for m in plans.MODULES for k, v in m.queries().items()}
SQL = {k: v for m in plans.MODULES for k, v in m.oracle_sql().items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no harness tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(values):
    return sorted(tuple("∅" if v is None else str(v) for v in r) for r in values)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    assert not [f.name for f in found.schema.fields if f.dataType.typeName() in ("double", "float")]
    names = sorted(found.columns)
    sql = duck.sql(SQL[name])
    assert sorted(sql.columns) == names
    listed = ", ".join(f'"{c}"' for c in names)
    assert rows(found.select(*names).collect()) == rows(duck.sql(f"SELECT {listed} FROM ({SQL[name]}) AS q").fetchall())
