"""Plan guards: no row-at-a-time Python UDFs, no Cartesian products or
nested-loop joins in any registered query; text scans do not read vectors."""

import pytest

from conftest import SF_SMALL

def _names():
    from promptlens.plans import registry
    registry.load_all()
    return sorted(registry.QUERIES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", _names())
def test_no_python_udf_or_cartesian(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_text_scan_reads_only_text(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["word_frequency"](spark, SF_SMALL))
    assert "embedding" not in plan and "output" not in plan.split("ReadSchema")[-1].split("]")[0]
