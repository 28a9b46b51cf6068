"""Every query of the subpackage runs on the smallest tables and equals its SQL where there is one."""

import glob
import os

import duckdb
import pytest

from quarryline.llm import queries as Q

COLUMNS = {"p1_found": ["file_id"], "p2_found": ["file_id"], "p3_found": ["response_id", "defect"], "p4_found": ["keep_id", "copy_id"], "p5_found": ["response_id"], "p6_found": ["request_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_a", "doc_b"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = df.collect()
    assert len({repr(r) for r in rows}) == len(rows)
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for t in glob.glob(f"{sf}/*.parquet"):
            con.sql(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
        want = con.sql(Q.oracle_sql()[name])
        cols = sorted(df.columns)
        at = [want.columns.index(c) for c in cols]
        assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
