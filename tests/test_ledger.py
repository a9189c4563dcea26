"""Ledger: hand-computed cases, a serial loop, ruin, missing prices and no look-ahead."""

import math

import numpy as np
import pytest

from tapeledger.operators import ledger as L
from tapeledger.operators import metrics as M
from tapeledger.operators.quality import price_violations

MARKET = "symbol string, bar int, px double, rate_sum double, rate_px_sum double"
TARGETS = "run_id string, bar int, symbol string, weight double"
RUNS = "run_id string, first_bar int, last_bar int, capital double, fee_bps double, slippage_bps double, lag int, funding string, max_leverage double"


def build(spark, prices, targets, fee=0.0, slip=0.0, lag=1, funding="disabled", rates=None, limit=None, run="r"):
    n = len(next(iter(prices.values())))
    m = [(s, i, p, (rates or {}).get((s, i), 0.0), (rates or {}).get((s, i), 0.0) * (p or 0.0)) for s, ps in prices.items() for i, p in enumerate(ps)]
    t = [(run, i, s, w) for i, row in targets.items() for s, w in row.items()]
    r = [(run, 0, n - 1, 1_000_000.0, fee, slip, lag, funding, limit)]
    return spark.createDataFrame(m, MARKET), spark.createDataFrame(t, TARGETS), spark.createDataFrame(r, RUNS)


def result(spark, *args, **kw):
    m, t, r = build(spark, *args, **kw)
    return L.ledger(m, t, r, True).where("path = 'actual'").orderBy("bar").collect()


def serial(prices, targets, fee, slip, lag, rates=None, capital=1_000_000.0):
    """The definition, period by period."""
    syms = sorted(prices)
    P = np.array([[prices[s][i] for s in syms] for i in range(len(prices[syms[0]]))], float)
    q, nav, out = np.zeros(len(syms)), capital, []
    for i in range(len(P) - 1):
        row = targets.get(i - lag)
        pre = q * P[i] / nav
        w = None if row is None else np.array([row.get(s, 0.0) for s in syms])
        turn = 0.0 if w is None else np.abs(w - pre).sum()
        after = nav - nav * turn * (fee + slip) / 1e4
        if after <= 0:
            out.append((turn, nav, 0.0, "cost"))
            break
        q = q if w is None else w * after / P[i]
        f = np.array([(rates or {}).get((s, i), 0.0) for s in syms])
        end = after + (q * (P[i + 1] - P[i])).sum() - (q * P[i] * f).sum()
        if end <= 0:
            out.append((turn, nav, 0.0, "pnl"))
            break
        out.append((turn, nav, end, None))
        nav = end
    return out


def test_single_symbol(spark):
    got = result(spark, {"A": [100.0, 110.0, 121.0]}, {0: {"A": 1.0}})
    assert [g.nav_end for g in got] == pytest.approx([1e6, 1.1e6])
    assert [g.rebalance for g in got] == [False, True]


def test_two_symbols_and_exposure(spark):
    got = result(spark, {"A": [100.0, 100.0, 110.0, 110.0], "B": [50.0, 50.0, 50.0, 55.0]}, {0: {"A": 0.5, "B": -0.5}})
    assert got[1].nav_end == pytest.approx(1_050_000)
    assert got[1].gross_exposure == pytest.approx(1.0) and got[1].net_exposure == pytest.approx(0.0)
    assert got[2].nav_end == pytest.approx(1_050_000 - 50_000)


def test_costs_are_charged_on_nav_before_them(spark):
    got = result(spark, {"A": [100.0, 100.0, 100.0]}, {0: {"A": 1.0}}, fee=10.0, slip=5.0)
    assert got[1].fee_cost == pytest.approx(1000) and got[1].slippage_cost == pytest.approx(500)
    assert got[1].nav_end == pytest.approx(998_500) and got[1].fee_return == pytest.approx(-0.001)


@pytest.mark.parametrize("seed", range(6))
def test_against_the_serial_definition(spark, seed):
    rng = np.random.default_rng(seed)
    n, syms = 120, ["A", "B", "C"]
    prices = {s: (100 * np.exp(np.cumsum(rng.normal(0, 0.03 * (1 + 3 * (seed % 3)), n)))).tolist() for s in syms}
    targets = {i: {s: float(rng.choice([0, 0.3, -0.4, 0.8, 2.5 if seed > 3 else 0.1])) for s in syms if rng.random() < 0.8} or {"A": 0.0} for i in range(n) if rng.random() < 0.25}
    rates = {(s, i): float(rng.normal(0, 1e-3)) for s in syms for i in range(n)}
    lag = 1 + seed % 2
    want = serial(prices, targets, 4.5, 1.0, lag, rates)
    got = result(spark, prices, targets, 4.5, 1.0, lag, "period_start", rates)
    assert len(got) == len(want)
    for g, (turn, pre, end, stage) in zip(got, want):
        assert g.turnover == pytest.approx(turn, rel=1e-12, abs=1e-13)
        assert g.nav_pre == pytest.approx(pre, rel=1e-11) and g.nav_end == pytest.approx(end, rel=1e-11, abs=1e-9)
        assert g.ruin_stage == stage
        if stage is None:
            assert g.net_return == pytest.approx(g.gross_return + g.fee_return + g.slippage_return + g.funding_return, abs=1e-12)


def test_ruin_at_pnl_stage(spark):
    got = result(spark, {"A": [100.0, 100.0, 60.0, 60.0, 60.0]}, {0: {"A": 3.0}})
    last = got[-1]
    assert (len(got), last.ruin_stage, last.nav_end, last.net_return) == (2, "pnl", 0.0, -1.0)
    assert last.uncapped_ruin_return == pytest.approx(-1.2) and last.asset_pnl == pytest.approx(-1_200_000)


def test_ruin_at_cost_stage(spark):
    got = result(spark, {"A": [100.0, 100.0, 100.0]}, {0: {"A": 2.0}}, fee=6000.0)
    last = got[-1]
    assert (last.ruin_stage, last.nav_end, last.net_return) == ("cost", 0.0, -1.0)
    assert math.isnan(last.asset_pnl) and math.isnan(last.gross_return) and last.uncapped_ruin_return == pytest.approx(-1.2)


def test_counterfactual_has_no_costs_and_survives_the_ruin_of_the_actual_path(spark):
    m, t, r = build(spark, {"A": [100.0, 100.0, 110.0]}, {0: {"A": 2.0}}, fee=6000.0)
    d = L.ledger(m, t, r, True)
    other = d.where("path = 'counterfactual'").orderBy("bar").collect()
    assert other[-1].nav_end == pytest.approx(1_200_000) and other[-1].fee_cost == 0.0
    drag = M.cost_drag(M.performance(d, 12.0)).first()
    assert drag.comparable is False and drag.total_drag_return is None
    flags = M.run_flags(d, L.unexecuted_rebalances(t, r), r).first()
    assert "RUINED" in flags.warnings and "DRAG_NOT_COMPARABLE" in flags.warnings


def test_missing_price_while_held_is_reported_and_never_silent(spark):
    m, t, r = build(spark, {"A": [100.0, 110.0, None, 120.0, 130.0]}, {0: {"A": 1.0}})
    used = price_violations(L.prices_in_use(m, t, r, L.ledger(m, t, r))).collect()
    assert {(x.bar, x.use, x.code) for x in used} == {(2, "period_end", "MISSING_PRICE"), (2, "period_start", "MISSING_PRICE")}
    assert L.accounting_violations(L.ledger(m, t, r)).count() > 0


def test_unused_prices_are_not_read(spark):
    got = result(spark, {"A": [100.0, 110.0, 121.0], "B": [None, -1.0, 0.0]}, {0: {"A": 1.0}})
    assert got[-1].nav_end == pytest.approx(1.1e6)


def test_positions_and_states(spark):
    m, t, r = build(spark, {"A": [100.0] * 5, "B": [50.0] * 5}, {0: {"A": 1.0}, 2: {"B": 1.0}})
    p = {(x.bar, x.symbol): x for x in L.positions(m, t, r, L.ledger(m, t, r)).collect()}
    assert [p[k].state for k in ((1, "A"), (2, "A"), (3, "A"), (3, "B"))] == ["ENTERING", "HELD", "EXITING", "ENTERING"]
    assert p[1, "A"].quantity == pytest.approx(10_000) and p[3, "A"].quantity == 0.0 and p[3, "A"].trade == pytest.approx(-1.0)
    assert (1, "B") not in p


def test_no_look_ahead(spark):
    prices = {"A": [100.0, 101.0, 99.0, 104.0, 103.0, 108.0]}
    targets = {0: {"A": 1.0}, 2: {"A": 0.5}}
    before = result(spark, prices, targets, 4.5)
    changed = {"A": prices["A"][:4] + [55.0, 300.0]}
    after = result(spark, changed, targets, 4.5)
    assert before[:3] == after[:3] and before[3] != after[3]


def test_late_rebalance_is_not_executed(spark):
    m, t, r = build(spark, {"A": [100.0, 110.0, 121.0]}, {1: {"A": 1.0}, 0: {"A": 0.0}})
    assert [x.bar for x in L.unexecuted_rebalances(t, r).collect()] == [1]
    assert L.ledger(m, t, r).where("turnover > 0").count() == 0


def test_event_price_funding(spark):
    m, t, r = build(spark, {"A": [100.0, 100.0, 100.0]}, {0: {"A": 1.0}}, funding="event_price", rates={("A", 1): 0.01})
    assert L.ledger(m, t, r).where("bar = 1").first().funding_pnl == pytest.approx(-10_000)


def test_config_rules():
    with pytest.raises(ValueError):
        L.RunConfig("r", 1.0, 1.0, 0, 10, lag=0)
    with pytest.raises(ValueError):
        L.RunConfig("r", 1.0, 1.0, 5, 5)
    with pytest.raises(ValueError):
        L.RunConfig("r", 1.0, 1.0, 0, 5, funding="sometimes")


def test_metrics_edge_cases(spark):
    m, t, r = build(spark, {"A": [100.0, 100.0]}, {0: {"A": 1.0}})
    one = M.performance(L.ledger(m, t, r), 8760.0).first()
    assert one.n_periods == 1 and math.isnan(one.sharpe) and math.isnan(one.annualized_volatility) and math.isnan(one.calmar)
    m, t, r = build(spark, {"A": [100.0, 100.0, 100.0, 100.0]}, {0: {"A": 1.0}})
    flat = M.performance(L.ledger(m, t, r), 8760.0).first()
    assert flat.total_return == 0.0 and flat.annualized_volatility == 0.0 and math.isnan(flat.sharpe) and flat.max_drawdown == 0.0
    m, t, r = build(spark, {"A": [1.0, 1.0, 1e9]}, {0: {"A": 1.0}})
    assert M.performance(L.ledger(m, t, r), 1e6).first().cagr == math.inf


def test_price_violations_stop_at_ruin(spark):
    """Ruined in the second period: the prices of later bars are never read."""
    m, t, r = build(spark, {"A": [100.0, 100.0, 1.0, None, None]}, {0: {"A": 3.0}})
    periods = L.ledger(m, t, r)
    assert [p.ruin_stage for p in periods.orderBy("bar").collect()] == [None, "pnl"]
    assert price_violations(L.prices_in_use(m, t, r, periods)).count() == 0


def test_stored_positions_give_the_same_ledger(spark):
    m, t, r = build(spark, {"A": [100.0, 100.0, 110.0, 110.0], "B": [50.0, 50.0, 50.0, 55.0]}, {0: {"A": 0.5, "B": -0.5}, 1: {"A": 1.0}}, fee=5.0)
    held = L.stored_positions(m, t, r)
    plain = L.ledger(m, t, r)
    stored = L.ledger(m, t, r, held=held)
    assert stored.orderBy("bar").collect() == plain.orderBy("bar").collect()
    by = ["bar", "symbol"]
    assert L.positions(m, t, r, plain, held).orderBy(*by).collect() == L.positions(m, t, r, plain).orderBy(*by).collect()
    assert "collect_list" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_run_findings(spark):
    m, t, r = build(spark, {"A": [1.0, 2.0, 3.0]}, {0: {"A": 1.0, "Q": 1.0}, 1: {"A": None}}, fee=-1.0, lag=0, funding="sometimes")
    bare = spark.createDataFrame([("idle", 5, 5, float("nan"), None, None, None, None, None)], RUNS)
    found = {(f.run_id, f.severity, f.code, f.n) for f in L.run_findings(m, t, r.unionByName(bare)).collect()}
    assert found == {("r", "error", "LAG_BELOW_ONE", 1), ("r", "error", "UNKNOWN_FUNDING_MODE", 1), ("r", "warning", "NEGATIVE_COST", 1), ("r", "error", "MISSING_WEIGHT", 1), ("r", "error", "UNKNOWN_SYMBOL", 1),
                     ("idle", "error", "TOO_FEW_BARS", 1), ("idle", "error", "FEE_REQUIRED", 1), ("idle", "error", "SLIPPAGE_REQUIRED", 1), ("idle", "error", "BAD_CAPITAL", 1), ("idle", "error", "LAG_BELOW_ONE", 1),
                     ("idle", "error", "UNKNOWN_FUNDING_MODE", 1), ("idle", "error", "NO_TARGETS", 1)}
    assert L.sound_runs(r.unionByName(bare), L.run_findings(m, t, r.unionByName(bare))).count() == 0


def test_flags_of_funding_and_growth(spark):
    m, t, r = build(spark, {"A": [100.0, 101.0, 102.0, 103.0]}, {0: {"A": 1.0}}, funding="period_start")
    marked = r.select("run_id").withColumn("suppress_cagr", r.run_id == "r").join(r, on="run_id")
    flags = M.run_flags(L.ledger(m, t, r, True), L.unexecuted_rebalances(t, r), marked, r.select("run_id")).first()
    assert {"FUNDING_GAP_SUSPICIOUS", "CAGR_SUPPRESSED"} <= set(flags.warnings)


def test_periods_are_not_joined_by_bar(spark):
    m, t, r = build(spark, {"A": [10.0, 11.0, 12.0, 13.0]}, {0: {"A": 1.0}})
    plan = L.ledger(m, t, r, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, ((run_id" not in plan and "Join LeftOuter, (((run_id" not in plan
