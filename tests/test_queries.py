"""Every query outside the llm subpackage equals its SQL at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

from sparkloom import registry
from sparkloom.session import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.7g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in names) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert got == sorted("|".join(norm(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["qa_dedup", "qa_stats", "qa_templates"])
def test_ties_in_table_order(spark, duck, name):
    """Lines of one key come in the order of the table, also where joins have sorted them otherwise."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query(spark, duck, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
