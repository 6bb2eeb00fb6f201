"""Every query that isn't of the llm subpackage runs on the smallest data, and equals its SQL in DuckDB where it has one."""

import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
NAMES = [k for m in entry._modules() if not m.__name__.startswith("tidemark.llm") for k in m.QUERIES]
# Aliases of queries that are run under another name, and what is slow for what it shows here.
SKIP = {"topk_impact", "abl_carries", "grade_one"}


def table(t):
    cols = sorted(t.column_names)

    def show(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v) if isinstance(v, (int, bool)) else repr(v)

    return cols, sorted(tuple(map(show, r)) for r in zip(*[t.column(c).to_pylist() for c in cols]))


@pytest.fixture(scope="module")
def con(sf):
    import glob
    import os

    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SKIP])
def test_query(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toArrow()
    if name in (sql := entry.oracle_sql()):
        assert table(got) == table(con.sql(sql[name]).to_arrow_table())


def test_flagship(spark, sf):
    x = entry.entry(spark)
    assert x.columns == ["policy", "accuracy", "cost", "latency_mean", "latency_p95", "n"] and x.count() == 6


def test_nothing_outside_imports_the_llm_package():
    from pathlib import Path

    root = Path(entry.__file__).parent / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidemark.llm" not in p.read_text(), p
