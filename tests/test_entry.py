"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from textmill.queries import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name].run(spark, SF).toPandas(), duck.sql(QUERIES[name].sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        differ = ~((got[c] == want[c]) | (got[c].isna() & want[c].isna()))
        assert not differ.any(), (c, got[differ].head(3), want[differ].head(3))


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_runs_and_repeats(spark, name):
    first = QUERIES[name].run(spark, SF)
    rows = sorted(map(str, first.collect()))
    assert rows
    assert len(rows) == QUERIES[name].run(spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
