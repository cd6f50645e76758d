"""Every registered query against its SQL on the given tables."""

import __spark_entry__ as entry_module
import compare
import pytest

from seqcurate.plans.oracles import ORACLES  # noqa: E402
from seqcurate.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def database(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare.difference(df, database, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"perceptual_hash", "linear_svm_baseline"}))
def test_plan(spark, sf_dir, name):
    """No product of tables, no Python rows, no window over whole tables without a key."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize(
    ("name", "most"), [("temporal_segments", 2), ("boundary_timing", 3), ("nearest_boundary_error", 3), ("predicted_boundary_peaks", 1), ("asof_grid", 3), ("smooth_signal", 1), ("interpolate_signal", 1)]
)
def test_inputs_are_read_once(spark, sf_dir, name, most):
    """Scans in the plan that ran; a shuffle that is used twice is made once."""
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan ") <= most, ran


def test_filters_reach_the_scan(spark, sf_dir):
    plan = QUERIES["confidence_withheld"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(exclusion_reason)" in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("relative_path" not in line.split("ReadSchema")[1] for line in scans)
