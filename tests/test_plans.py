"""Plan guards: headline queries stay JVM-side (no Python UDF nodes) and scans are pruned."""

import pytest

import __spark_entry__ as E
from limnos.sources import bindings as B
from tests.conftest import SMOKE

HEADLINE = ["flagship", "num_clean_censored", "hot_summary", "alr_operational", "win_latest", "alr_live",
            "jn_hist_fuzzy", "agg_spearman"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_python_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SMOKE))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert node not in plan


def test_scan_is_pruned(spark):
    plan = _plan(B.readings(spark, SMOKE))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["agg_describe", "agg_iqr_outliers", "agg_five_number", "agg_baseline", "imp_group_median"])
def test_no_percentile_buffer(spark, name):
    """Exact percentiles come from ranks: no aggregate holds a group's values (the sketch of the bounds is bounded)."""
    plan = E.queries()[name](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and "median(" not in plan


@pytest.mark.parametrize("name,most", [("scl_minmax", 2), ("scl_zscore", 2), ("std_mapping_checks", 2), ("sv_live_summary", 4)])
def test_few_scans(spark, name, most):
    """Scans of the plan before reuse, over all tables."""
    plan = _plan(E.queries()[name](spark, SMOKE))
    assert sum(line.strip(" :+-*()0123456789").startswith("FileScan") for line in plan.split("\n")) <= most
