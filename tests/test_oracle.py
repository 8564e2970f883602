"""Every query with an SQL oracle must equal DuckDB on the driver tables
(row count, column names, order-insensitive values)."""
import duckdb
import pytest

from choicekit.plans.registry import oracle_sql, queries
from choicekit.sources.tables import TABLES
from tools.oracle_check import digest

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, con, key):
    df = queries()[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[key])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_runs_with_stable_schema(spark, sf_dir):
    for key, fn in queries().items():
        if key in ORACLE:
            continue
        df = fn(spark, sf_dir)
        assert df.columns, key
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
