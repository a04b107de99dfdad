"""Every query with a SQL twin against DuckDB at sf0.001, and the rest for a stable schema."""

import math
import os

import duckdb
import pytest

from assaya.queries import core, documents, evaluation, more, rest, sources, texts, views  # noqa: F401  registers the queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(core.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_perfect_ratio_adds_in_the_order_of_rows(spark, tmp_path):
    """Totals of zero keep the sign that SQL on one thread gives them, although a shuffled join deals rows out in another order."""
    c = duckdb.connect(config={"threads": 1})
    c.execute("CREATE TABLE orders AS SELECT o AS o_orderkey, o % 500 AS o_custkey FROM range(2000) r(o)")
    c.execute("CREATE TABLE lineitem AS SELECT 1999 - k AS l_orderkey, 5 AS l_linenumber, 'N' AS l_returnflag, [0.04, 0.02, 0.07, 0.07][k // 500 + 1]::DOUBLE AS l_discount FROM range(2000) r(k) ORDER BY k")
    for name in ("orders", "lineitem"):
        c.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tuple(core.QUERIES["q134_perfect_ratio"](spark, str(tmp_path)).first())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == c.execute(core.SQL["q134_perfect_ratio"]).fetchone() == (500, 500, 100.0)
