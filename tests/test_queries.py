"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from lodespar.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = df.collect()
    if name in catalogue.ORACLE_SQL:
        result = duck.execute(catalogue.ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, result.fetchall())
    else:
        assert got


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_plans_stay_narrow(spark, sf):
    """Filters and columns reach the scan; the top-k is no full sort; normalisation needs no shuffle."""
    plan = lambda name: catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("a5_topk_explode")
    assert "Exchange" not in plan("f20_annualise") and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in plan("f20_annualise")
    assert "PushedFilters: [IsNotNull(p_size), EqualTo(p_size,10)]" in plan("p13_search")
