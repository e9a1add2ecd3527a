"""Every query runs, and those with SQL agree with it."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

#: queries whose SQL is compared here; the others run in the project's parity check
SOME = ["p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p6_trailing", "p7_percentiles", "trailing_atr", "signal_first_in_n", "rank_desc_bijective", "horizon_stats", "target_before_stop", "checkpoint_path_state", "validity_windows", "asof_backward", "latest_within_lag", "split_adjustment"]


def rows(table):
    names = sorted(table.column_names)
    fix = lambda v: None if v is None or v != v else (float(f"{v:.9g}") if isinstance(v, float) else v)
    return sorted(tuple(str(fix(r[n])) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = entry.queries()[name](spark, folder).toArrow(), c.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6)} <= set(q)
    assert ("p8_found" in q) == (importlib.util.find_spec("tapeglass.llm") is not None and importlib.util.find_spec("tapeglass.llm.queries") is not None)
