"""Every registered query that has SQL, against DuckDB."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__
from papertide.plans import views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


def test_sql_belongs_to_queries(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["topics", "facts_document"])
def test_queries_without_sql(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan(__spark_entry__.queries()["coauthor_edges"](spark, DATA))
    january = "o_orderdate >= timestamp'1995-01-01' AND o_orderdate < timestamp'1995-02-01'"
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan(views.authors(spark, DATA, january))


def test_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    """Views deal lines out by their number, and what is computed by paper stays so dealt."""
    from pyspark.sql import functions as F

    from papertide.operators import graph
    from papertide.plans import views

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(views, "ROWS_IN_TASK", 100)
    many = -(-views.table(spark, d, "lineitem").count() // 100)
    on = views.lines(spark, d, F.col("l_suppkey").alias("auid")).distinct()
    for rows in (views.lines(spark, d), on, graph._pairs(on, "eid")):
        assert rows.rdd.getNumPartitions() >= many
    monkeypatch.setattr(views, "ROWS_IN_TASK", 10**9)
    assert views.lines(spark, d).rdd.getNumPartitions() < many


def test_payloads_are_parsed_once(spark, capsys):
    """Neither the filter nor a field parses a payload anew."""
    from papertide.plans import payloads

    for table in payloads._tables(spark, "/root/testdata/sf0.001").values():
        table.explain()
        assert "parse_json" not in capsys.readouterr().out
