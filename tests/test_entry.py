"""The driver contract: names, oracles, plans of headline queries."""

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 180
    from tallyfield.plans import load_all

    assert len(load_all()[0]) - len(load_all()[1]) <= 8


def test_flagship(spark):
    d = entry.entry(spark)
    assert d.columns == ["ds", "n", "mpjpe", "abs_mpjpe", "transl_err_m"] and d.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["records_with_box", "gate_reasons", "smooth_pairs", "pillars", "pairwise_overlap", "relabelled"])
def test_no_nested_loops_in_plans(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_scan_reads_only_what_is_used(spark):
    text = plan(entry.queries()["records_with_box"](spark, SF))
    scan = next(line for line in text.splitlines() if "FileScan" in line or "Scan parquet" in line)
    assert "o_totalprice" not in scan and "o_custkey" in scan
