"""Every core query runs, and equals its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarryline import catalog
from quarryline.streaming import dedup_stream, incremental, read_table_stream, usage_windows


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_filters_reach_the_scan(spark, sf):
    plan = catalog.queries()["f03_size_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(size), LessThanOrEqual(size,2000)]" in plan
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_streams(spark, sf, tmp_path):
    one = spark.read.parquet(f"{sf}/attempts.parquet")
    one.write.parquet(str(tmp_path / "in"))
    stream = read_table_stream(spark, str(tmp_path / "in"), one.schema)
    q = incremental(dedup_stream(stream, one.columns, "attempted_at"), lambda b: b.groupBy("provider").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy().sum("count").first()[0]
    assert got == one.where("attempted_at is not null").distinct().count()
    w = usage_windows(read_table_stream(spark, str(tmp_path / "in"), one.schema)).writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("usage").count() > 0
