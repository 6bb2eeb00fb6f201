"""Every llm query runs on the smallest data, with stated columns, and equals its SQL in DuckDB where it has one."""

import glob
import math
import os

import pytest

from tidemark.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
COLUMNS = {"p1_found": ["delivery_id", "defect"], "p5_found": ["entity_id", "task_id"], "p6_found": ["task_id_a", "task_id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["source"], "p9_found": ["doc_id", "reading_level"]}


def show(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, sf, name):
    got = Q.QUERIES[name](spark, sf).toArrow()
    if name in COLUMNS:
        assert got.column_names == COLUMNS[name]
    if name in Q.ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{sf}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
        want = con.sql(Q.ORACLE[name]).to_arrow_table()
        rows = lambda t: sorted(tuple(map(show, r)) for r in zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)]))
        assert rows(got) == rows(want)


def test_assigned_splits_cover_all_tasks_once_and_whole_entities(spark, sf):
    a = Q.p5_assigned(spark, sf).collect()
    assert len(a) == len({r["task_id"] for r in a})
    of = {}
    assert all(of.setdefault(r["entity_id"], r["split"]) == r["split"] for r in a)


def test_combined_percentiles_are_within_their_error_of_the_exact(spark, sf):
    exact = {(r["source"], r["metric"], r["arm"], r["percentile"]): r for r in Q.p3_percentiles(spark, sf).where("scope = 'arm'").collect()}
    for r in Q.p3_combined(spark, sf).collect():
        e = exact[(r["source"], r["metric"], r["arm"], r["percentile"])]
        assert e["n"] == r["n"]
        if e["n"] > 100 and r["percentile"] == 0.5:
            assert abs(e["value"] - r["value"]) <= 0.03 * e["value"]
