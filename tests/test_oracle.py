"""Every registered query with SQL gives DuckDB's rows and types."""

import duckdb
import pytest

from quillon import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, db, data, name):
    got = registry.queries()[name](spark, data).toArrow()
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    db.register("got", got)
    db.execute(f"CREATE OR REPLACE TEMP TABLE a AS SELECT {columns} FROM got")
    db.execute(f"CREATE OR REPLACE TEMP TABLE b AS SELECT {columns} FROM ({registry.oracle_sql()[name]})")
    kinds = [[r[1] for r in db.execute(f"DESCRIBE {t}").fetchall()] for t in "ab"]
    assert kinds[0] == kinds[1]
    assert db.execute("SELECT count(*) FROM a").fetchall() == db.execute("SELECT count(*) FROM b").fetchall()
    assert db.execute("SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)").fetchall() == [(0,)]


def test_queries_without_sql_run(spark, data):
    for name in registry.queries().keys() - registry.oracle_sql().keys():
        assert registry.queries()[name](spark, data).count() > 0
