"""Every registered query against its SQL on DuckDB."""

import pytest

from tapeledger.plans import catalogue
from tools.compare import connect, difference

SF = "/root/testdata/sf0.001"
# The smallest data have months without a price for some symbols, which a ledger reports and SQL lists cannot hold.
WHOLE_GRID = "/root/testdata/sf0.01"
NEEDS_WHOLE_GRID = {"price_violations", "unpriced_funding", "ledger_periods", "ledger_returns", "ledger_positions", "ledger_ruin", "ledger_flags", "symbol_state_counts", "equity_curve", "drawdown_curve", "performance_metrics", "cost_drag", "crossvenue_run_compare"}


@pytest.fixture(scope="module")
def duck():
    return {sf: connect(sf) for sf in (SF, WHOLE_GRID)}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    sf = WHOLE_GRID if name in NEEDS_WHOLE_GRID else SF
    df = catalogue.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    mine = df.toPandas()
    assert name in catalogue.ORACLES
    assert difference(mine, duck[sf].execute(catalogue.ORACLES[name]).fetch_df()) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
