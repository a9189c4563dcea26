"""Queries on the portfolio ledger. The SQL side walks the periods one by one; the Spark side has no loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions.timegrid import DAY_US, HOUR_US, bucket_start
from tapeledger.operators import compare, intervals, ledger, metrics, quality, signals
from tapeledger.plans import views as V
from tapeledger.plans.quality_queries import _CLAIMED_SQL, claimed_coverage
from tapeledger.plans.registry import query
from tapeledger.session import cut_lineage

_PERF_COLS = {"total_return": 9, "cagr": 8, "annualized_volatility": 8, "sharpe": 7, "downside_dev_ann": 8, "sortino": 7, "max_drawdown": 9, "calmar": 7, "avg_turnover": 9, "annualized_turnover": 8}
_PERF_SQL = """round(total_return, 9) AS total_return, round(cagr, 8) AS cagr, round(vol, 8) AS annualized_volatility, round(sharpe, 7) AS sharpe, round(dd, 8) AS downside_dev_ann, round(sortino, 7) AS sortino,
  round(mdd, 9) AS max_drawdown, round(calmar, 7) AS calmar, round(avg_turnover, 9) AS avg_turnover, round(avg_turnover * 12, 8) AS annualized_turnover"""


def _rounded(df, digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _stored(**tables):
    return tuple(cut_lineage(df, name) for name, df in tables.items())


def supplier_inputs(spark, sf):
    """Prices, targets and settings as stored tables: the ledger reads each of them more than once."""
    return _stored(market=V.supplier_market(spark, sf), targets=V.supplier_targets(spark, sf), runs=V.supplier_runs(spark, sf))


def supplier_ledger(spark, sf, counterfactual=True):
    return ledger.ledger(*supplier_inputs(spark, sf), counterfactual=counterfactual)


_MONEY = ["nav_pre", "fee_cost", "slippage_cost", "nav_after_cost", "asset_pnl", "funding_pnl", "nav_end"]


@query("ledger_periods", """SELECT l.run_id, l.path, bar, rebalance, round(turnover, 8) AS turnover, round(nav_pre, 1) AS nav_pre, round(turnover * nav_pre * fee, 1) AS fee_cost, round(turnover * nav_pre * slip, 1) AS slippage_cost,
  round(nav_after_cost, 1) AS nav_after_cost, round(asset_pnl, 1) AS asset_pnl, round(funding_pnl, 1) AS funding_pnl, round(nav_end, 1) AS nav_end, round(CASE WHEN stage IS NOT NULL THEN -1.0::DOUBLE ELSE nav_end / nav_pre - 1 END, 8) AS net_return,
  round(CASE WHEN stage = 'cost' THEN list_sum([abs(x) for x in wpre]) ELSE list_sum(list_transform(range(1, len(p) + 1), lambda j: abs(q[j] * p[j]))) / nav_after_cost END, 8) AS gross_exposure,
  round(CASE WHEN stage = 'cost' THEN list_sum(wpre) ELSE list_sum(list_transform(range(1, len(p) + 1), lambda j: q[j] * p[j])) / nav_after_cost END, 8) AS net_exposure, stage AS ruin_stage
  FROM led l JOIN rn r ON r.run_id = l.run_id AND r.path = l.path""", ("led",))
def ledger_periods(spark, sf):
    d = supplier_ledger(spark, sf)
    d = _rounded(d, {**{c: 1 for c in _MONEY}, "turnover": 8, "net_return": 8, "gross_exposure": 8, "net_exposure": 8})
    return d.select("run_id", "path", "bar", "rebalance", "turnover", *_MONEY, "net_return", "gross_exposure", "net_exposure", "ruin_stage")


@query("ledger_returns", """SELECT run_id, path, bar, round(asset_pnl / nav_pre, 8) AS gross_return, round(funding_pnl / nav_pre, 8) AS funding_return, round((nav_after_cost - nav_pre) / nav_pre, 8) AS cost_return FROM led""", ("led",))
def ledger_returns(spark, sf):
    """The additive parts of each period's return."""
    d = supplier_ledger(spark, sf).select("run_id", "path", "bar", "gross_return", "funding_return", (F.col("fee_return") + F.col("slippage_return")).alias("cost_return"))
    return _rounded(d, {"gross_return": 8, "funding_return": 8, "cost_return": 8})


_POSITIONS = """SELECT run_id, bar, syms[j] AS symbol, CASE WHEN q_prev[j] <> 0 AND (CASE WHEN rebalance THEN w[j] <> 0 ELSE true END) THEN 'HELD' WHEN q_prev[j] <> 0 THEN 'EXITING' ELSE 'ENTERING' END AS state,
  q[j] AS quantity, q[j] * p[j] AS notional, CASE WHEN stage = 'cost' THEN wpre[j] ELSE q[j] * p[j] / nav_after_cost END AS weight_held, wpre[j] AS pre_trade_weight, CASE WHEN rebalance THEN w[j] - wpre[j] ELSE 0 END AS trade
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS j FROM led, names WHERE path = 'actual') WHERE q_prev[j] <> 0 OR (rebalance AND w[j] <> 0)"""


def _positions(spark, sf):
    m, t, r = supplier_inputs(spark, sf)
    held = ledger.stored_positions(m, t, r)
    return ledger.positions(m, t, r, ledger.ledger(m, t, r, held=held), held)


@query("ledger_positions", f"SELECT run_id, bar, symbol, state, round(quantity, 4) AS quantity, round(notional, 1) AS notional, round(weight_held, 8) AS weight_held, round(pre_trade_weight, 8) AS pre_trade_weight, round(trade, 8) AS trade FROM ({_POSITIONS})", ("led",))
def ledger_positions(spark, sf):
    return _rounded(_positions(spark, sf), {"quantity": 4, "notional": 1, "weight_held": 8, "pre_trade_weight": 8, "trade": 8})


@query("symbol_state_counts", f"SELECT symbol, state, count(*) AS n FROM ({_POSITIONS}) GROUP BY ALL", ("led",))
def symbol_state_counts(spark, sf):
    return _positions(spark, sf).groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"))


@query("ledger_ruin", """SELECT run_id, path, bar, stage AS ruin_stage, round(CASE stage WHEN 'cost' THEN nav_after_cost ELSE nav_after_cost + asset_pnl + funding_pnl END / nav_pre - 1, 8) AS uncapped_ruin_return FROM led WHERE stage IS NOT NULL""", ("led",))
def ledger_ruin(spark, sf):
    d = supplier_ledger(spark, sf).where("ruin_stage is not null")
    return _rounded(d.select("run_id", "path", "bar", "ruin_stage", "uncapped_ruin_return"), {"uncapped_ruin_return": 8})


@query("equity_curve", "SELECT run_id, path, bar, round(equity, 1) AS equity FROM curve", ("curve",))
def equity_curve(spark, sf):
    m, t, r = supplier_inputs(spark, sf)
    return _rounded(ledger.equity_curve(ledger.ledger(m, t, r, True)), {"equity": 1})


@query("drawdown_curve", "SELECT run_id, path, bar, round(equity / max(equity) OVER (PARTITION BY run_id, path ORDER BY bar) - 1, 8) AS drawdown FROM curve", ("curve",))
def drawdown_curve(spark, sf):
    m, t, r = supplier_inputs(spark, sf)
    d = metrics.drawdowns(ledger.equity_curve(ledger.ledger(m, t, r, True)))
    return _rounded(d.select("run_id", "path", "bar", "drawdown"), {"drawdown": 8})


def _performance(m, t, r, counterfactual=True):
    return metrics.performance(ledger.ledger(m, t, r, counterfactual), 12.0)


@query("performance_metrics", f"SELECT run_id, path, n AS n_periods, {_PERF_SQL} FROM perf", ("perf",))
def performance_metrics(spark, sf):
    return _rounded(_performance(*supplier_inputs(spark, sf)), _PERF_COLS).drop("rebalance_count", "ruined")


@query("cost_drag", """SELECT a.run_id, ok AS comparable, round(CASE WHEN ok THEN c.total_return - a.total_return END, 8) AS total_drag_return, round(CASE WHEN ok THEN c.cagr - a.cagr END, 8) AS cagr_drag FROM (
  SELECT *, a.n = c.n AND NOT EXISTS (SELECT 1 FROM led WHERE led.run_id = a.run_id AND stage IS NOT NULL) AS ok FROM perf a JOIN perf c ON a.run_id = c.run_id AND a.path = 'actual' AND c.path = 'counterfactual')"""
       .replace("SELECT *, a.n = c.n", "SELECT a, c, a.n = c.n").replace("a.run_id, ok", "a.run_id AS run_id, ok"), ("perf",))
def cost_drag(spark, sf):
    return _rounded(metrics.cost_drag(_performance(*supplier_inputs(spark, sf))), {"total_drag_return": 8, "cagr_drag": 8})


@query("ledger_flags", """WITH a AS (SELECT run_id, count(*) AS n_periods, count(*) FILTER (WHERE rebalance) AS rebalance_count, max(stage) AS ruin_stage,
  count(*) FILTER (WHERE CASE WHEN stage = 'cost' THEN list_sum([abs(x) for x in wpre]) ELSE list_sum(list_transform(range(1, len(p) + 1), lambda j: abs(q[j] * p[j]))) / nav_after_cost END > 1.05) AS n_leverage_breaches FROM led WHERE path = 'actual' GROUP BY run_id),
  c AS (SELECT run_id, count(*) AS n, max(stage) AS stage FROM led WHERE path = 'counterfactual' GROUP BY run_id),
  u AS (SELECT t.run_id, count(DISTINCT t.bar) AS n FROM targets t JOIN runs r ON r.run_id = t.run_id WHERE t.bar + lag > last_bar - 1 GROUP BY t.run_id),
  days AS (SELECT DISTINCT 'S' || (l_partkey % 8) AS symbol, l_shipdate::DATE AS day FROM lineitem), gaps AS (SELECT symbol, day - lag(day) OVER (PARTITION BY symbol ORDER BY day) AS gap FROM days),
  usual AS (SELECT symbol, gap FROM (SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, gap) AS k FROM (SELECT symbol, gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY symbol, gap)) WHERE k = 1),
  sus AS (SELECT DISTINCT run_id FROM targets JOIN usual USING (symbol) WHERE weight <> 0 AND gap < CASE WHEN symbol IN ('S0', 'S2') THEN 3 ELSE 1.5 END / 2),
  d AS (SELECT a.*, funding, coalesce(u.n, 0) AS n_unexecuted, CASE WHEN c.stage IS NULL THEN 'COMPLETED' ELSE 'RUINED' END AS cf, c.n AS cn FROM a JOIN runs USING (run_id) JOIN c USING (run_id) LEFT JOIN u USING (run_id))
  SELECT run_id, n_periods, rebalance_count, ruin_stage, n_leverage_breaches, n_unexecuted, concat_ws(',', CASE WHEN substr(run_id, 2)::INT % 4 = 1 THEN 'CAGR_SUPPRESSED' END, CASE WHEN cf <> 'COMPLETED' THEN 'COUNTERFACTUAL_' || cf END,
  CASE WHEN cf <> 'COMPLETED' OR ruin_stage IS NOT NULL OR cn <> n_periods THEN 'DRAG_NOT_COMPARABLE' END, CASE WHEN funding <> 'disabled' AND run_id IN (SELECT run_id FROM sus) THEN 'FUNDING_GAP_SUSPICIOUS' END, CASE WHEN funding = 'disabled' THEN 'FUNDING_NOT_MODELLED' END,
  CASE WHEN n_leverage_breaches > 0 THEN 'LEVERAGE_BREACH' END, CASE WHEN ruin_stage IS NOT NULL THEN 'RUINED' END, CASE WHEN n_unexecuted > 0 THEN 'UNEXECUTED_REBALANCES:' || n_unexecuted END) AS warnings FROM d""", ("led", "targets", "runs"))
def ledger_flags(spark, sf):
    m, t, r = supplier_inputs(spark, sf)
    days = V.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), (F.col("l_partkey") % 8).cast("string")).alias("symbol"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("timestamp")).distinct()
    whole = days.groupBy("symbol").agg(F.min("timestamp").alias("coverage_start"), F.max("timestamp").alias("coverage_end"))
    wide = F.col("symbol").isin("S0", "S2")
    checks = [intervals.coverage_checks(days.where(w), whole.where(w), max_gap_us=limit * DAY_US // 2) for w, limit in ((wide, 6), (~wide, 3))]
    suspicious = checks[0].unionByName(checks[1]).where("tolerance_suspicious").select("symbol")
    suspicious = t.where("weight <> 0").join(suspicious.distinct(), on="symbol", how="left_semi").select("run_id").distinct()
    r = r.withColumn("suppress_cagr", F.substring("run_id", 2, 9).cast("int") % 4 == 1)
    d = metrics.run_flags(ledger.ledger(m, t, r, True), ledger.unexecuted_rebalances(t, r), r, suspicious)
    return d.withColumn("warnings", F.concat_ws(",", "warnings"))


@query("unexecuted_rebalances", "SELECT DISTINCT t.run_id, t.bar FROM targets t JOIN runs r ON r.run_id = t.run_id WHERE t.bar + lag > last_bar - 1 AND t.bar BETWEEN first_bar AND last_bar", ("targets", "runs"))
def unexecuted_rebalances(spark, sf):
    _, t, r = supplier_inputs(spark, sf)
    return ledger.unexecuted_rebalances(t, r)


_HELD_SQL = """b AS (SELECT DISTINCT t.run_id, t.bar, t.bar + lag AS begin, last_bar FROM targets t JOIN runs r ON r.run_id = t.run_id WHERE t.bar >= first_bar AND t.bar + lag < last_bar),
  st AS (SELECT *, coalesce(lead(begin) OVER (PARTITION BY run_id ORDER BY begin), last_bar) - 1 AS until FROM b),
  held AS (SELECT st.run_id, t.symbol, unnest(generate_series(begin, until)) AS bar FROM st JOIN targets t ON t.run_id = st.run_id AND t.bar = st.bar WHERE t.weight <> 0),
  read AS (SELECT held.* FROM held SEMI JOIN (SELECT * FROM led WHERE path = 'actual') l ON l.run_id = held.run_id AND l.bar = held.bar)"""


@query("price_violations", f"""WITH pm AS (SELECT symbol, bar, CASE WHEN px > 1580 THEN NULL WHEN px < 1450 THEN -px ELSE px END AS px FROM market), {_HELD_SQL},
  used AS (SELECT run_id, symbol, bar, 'period_start' AS use FROM read UNION ALL SELECT run_id, symbol, bar + 1, 'period_end' FROM read)
  SELECT used.run_id, used.symbol, used.bar, use, CASE WHEN px IS NULL THEN 'MISSING_PRICE' ELSE 'INVALID_PRICE' END AS code FROM used LEFT JOIN pm ON pm.symbol = used.symbol AND pm.bar = used.bar WHERE px IS NULL OR px <= 0""", ("led", "targets", "runs"))
def price_violations(spark, sf):
    """Prices in use, up to the ruin of each run, that are missing or not positive, after some prices of the market were spoilt."""
    m, t, r = supplier_inputs(spark, sf)
    spoilt = m.withColumn("px", F.when(F.col("px") > 1580, F.lit(None)).when(F.col("px") < 1450, -F.col("px")).otherwise(F.col("px")))
    return quality.price_violations(ledger.prices_in_use(spoilt, t, r, ledger.ledger(m, t, r))).select("run_id", "symbol", "bar", "use", "code")


@query("unpriced_funding", f"""WITH {_HELD_SQL} SELECT held.run_id, held.symbol, held.bar, 1 + held.bar % 2 AS n_unpriced FROM held JOIN runs r ON r.run_id = held.run_id JOIN market m ON m.symbol = held.symbol AND m.bar = held.bar
  WHERE r.funding = 'event_price' AND m.px > 1550""", ("led", "targets", "runs"))
def unpriced_funding(spark, sf):
    """Held periods with funding events whose price is missing, for runs that pay at event prices."""
    m, t, r = supplier_inputs(spark, sf)
    events = m.select("symbol", "bar", F.when(F.col("px") > 1550, 1 + F.col("bar") % 2).otherwise(0).alias("n_unpriced"))
    return ledger.unpriced_funding(m, t, r, events)


_BAD_RUNS = """rr AS (SELECT run_id, s, CASE WHEN s % 5 = 4 THEN last_bar ELSE first_bar END AS first_bar, last_bar, CASE WHEN s % 9 = 8 THEN 0.0::DOUBLE ELSE capital END AS capital, CASE WHEN s % 3 = 2 THEN NULL WHEN s % 4 = 1 THEN -5.0::DOUBLE ELSE fee_bps END AS fee_bps, slippage_bps,
  CASE WHEN s % 6 = 3 THEN 0 ELSE lag END AS lag, CASE WHEN s % 7 = 0 THEN 'sometimes' ELSE funding END AS funding FROM (SELECT *, substr(run_id, 2)::INT AS s FROM runs) WHERE s % 10 <> 7),
  tt AS (SELECT run_id, bar, CASE WHEN substr(run_id, 2)::INT % 4 = 2 AND symbol = 'S2' THEN 'X9' ELSE symbol END AS symbol, CASE WHEN substr(run_id, 2)::INT % 5 = 1 AND symbol = 'S1' THEN NULL ELSE weight END AS weight FROM targets WHERE substr(run_id, 2)::INT % 10 <> 6),
  dd AS (SELECT * FROM rr UNION ALL SELECT * FROM rr WHERE s % 10 = 2)"""


@query("run_findings", f"""WITH {_BAD_RUNS} SELECT run_id, 'error' AS severity, 'LAG_BELOW_ONE' AS code, 1::BIGINT AS n FROM dd WHERE lag < 1 UNION ALL SELECT run_id, 'error', 'TOO_FEW_BARS', 1 FROM dd WHERE last_bar - first_bar < 1
  UNION ALL SELECT run_id, 'error', 'UNKNOWN_FUNDING_MODE', 1 FROM dd WHERE funding = 'sometimes' UNION ALL SELECT run_id, 'error', 'FEE_REQUIRED', 1 FROM dd WHERE fee_bps IS NULL UNION ALL SELECT run_id, 'error', 'BAD_CAPITAL', 1 FROM dd WHERE capital <= 0
  UNION ALL SELECT run_id, 'warning', 'NEGATIVE_COST', 1 FROM dd WHERE fee_bps < 0 UNION ALL SELECT run_id, 'error', 'MISSING_WEIGHT', count(*) FROM tt WHERE weight IS NULL GROUP BY run_id UNION ALL SELECT run_id, 'error', 'UNKNOWN_SYMBOL', count(*) FROM tt WHERE symbol = 'X9' GROUP BY run_id
  UNION ALL SELECT run_id, 'warning', 'UNEXECUTED_REBALANCES', count(*) FROM (SELECT DISTINCT t.run_id, t.bar, d.first_bar FROM tt t JOIN rr d ON d.run_id = t.run_id WHERE t.bar + lag > last_bar - 1 AND t.bar BETWEEN first_bar AND last_bar) x
    GROUP BY run_id UNION ALL SELECT run_id, 'error', 'NO_TARGETS', 1 FROM rr WHERE s % 10 = 6
  UNION ALL SELECT run_id, 'error', 'UNKNOWN_RUN', count(*) FROM tt WHERE run_id NOT IN (SELECT run_id FROM rr) GROUP BY run_id UNION ALL SELECT run_id, 'error', 'DUPLICATE_RUN', 2 FROM rr WHERE s % 10 = 2""", ("targets", "runs"))
def run_findings(spark, sf):
    """Settings and targets of the supplier portfolios, spoilt by rules on the supplier's number."""
    m, t, r = supplier_inputs(spark, sf)
    s = F.substring("run_id", 2, 9).cast("int")
    r = r.where(s % 10 != 7).withColumns({
        "first_bar": F.when(s % 5 == 4, F.col("last_bar")).otherwise(F.col("first_bar")), "capital": F.when(s % 9 == 8, 0.0).otherwise(F.col("capital")),
        "fee_bps": F.when(s % 3 == 2, F.lit(None)).when(s % 4 == 1, -5.0).otherwise(F.col("fee_bps")), "lag": F.when(s % 6 == 3, 0).otherwise(F.col("lag")), "funding": F.when(s % 7 == 0, "sometimes").otherwise(F.col("funding"))})
    t = t.where(s % 10 != 6).withColumns({"weight": F.when((s % 5 == 1) & (F.col("symbol") == "S1"), F.lit(None)).otherwise(F.col("weight")), "symbol": F.when((s % 4 == 2) & (F.col("symbol") == "S2"), "X9").otherwise(F.col("symbol"))})
    return ledger.run_findings(m, t, r.unionByName(r.where(s % 10 == 2)))


@query("executions", """SELECT symbol, timestamp, 'next_open' AS mode, open AS px, timestamp AS executed_at FROM bars_1h UNION ALL SELECT symbol, timestamp, 'next_close', close, timestamp + INTERVAL 1 HOUR FROM bars_1h""", ("bars_1h",))
def executions(spark, sf):
    """Price and instant of execution in each bar, for both modes."""
    b = V.bars_1h(spark, sf)
    modes = [ledger.executions(b, mode, HOUR_US).select("symbol", "timestamp", F.lit(mode).alias("mode"), "px", "executed_at") for mode in ("next_open", "next_close")]
    return modes[0].unionByName(modes[1])


_STRETCH_SQL = """st AS (SELECT symbol, 'r' || (trade_id % 20) AS run_id, date_trunc('day', timestamp) AS day, date_trunc('hour', min(timestamp)) AS s, date_trunc('hour', max(timestamp)) + INTERVAL 1 HOUR AS e FROM ticks GROUP BY ALL)"""


@query("held_coverage", f"""WITH c AS ({_CLAIMED_SQL}), {_STRETCH_SQL}, g AS (SELECT symbol, timestamp, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp, trade_id) AS before FROM ticks),
  p AS (SELECT symbol, run_id, day, s, e, unnest(generate_series(s, e - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM st)
  SELECT st.symbol, st.run_id, st.s AS stretch_start, st.e AS stretch_end, (epoch_us(st.e) - epoch_us(st.s)) // 3600000000 AS n_periods,
  (SELECT count(*) FROM p WHERE p.symbol = st.symbol AND p.run_id = st.run_id AND p.day = st.day AND EXISTS (SELECT 1 FROM c WHERE c.symbol = p.symbol AND coverage_start <= h AND h + INTERVAL 1 HOUR <= coverage_end)) AS n_covered,
  (SELECT max(epoch_us(timestamp) - epoch_us(before)) FROM g WHERE g.symbol = st.symbol AND g.timestamp >= st.s AND g.before < st.e) AS max_gap_us FROM st""", ("coverage",))
def held_coverage(spark, sf):
    """Held stretches against funding coverage: periods that a single record holds, and the widest spacing of funding events
    that touches the stretch. Neither stretches nor records are expanded to periods."""
    ticks = V.ticks(spark, sf)
    day = F.date_trunc("day", "timestamp")
    st = ticks.groupBy("symbol", F.concat(F.lit("r"), (F.col("trade_id") % 20).cast("string")).alias("run_id"), day.alias("_day")).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    st = cut_lineage(st.select("symbol", "run_id", bucket_start("a", HOUR_US).alias("stretch_start"), (bucket_start("b", HOUR_US) + F.expr("INTERVAL 1 HOUR")).alias("stretch_end")), "held-stretches")
    key = ["symbol", "run_id", "stretch_start"]
    covered = intervals.covered_periods(claimed_coverage(spark, sf), st, key)
    gaps = intervals.stretch_gaps(ticks.select("symbol", "timestamp", "trade_id"), st, key, tie="trade_id")
    return st.join(covered, on=key).join(gaps, on=key)


@query("funding_by_period", """SELECT symbol, (floor((epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-02')) / 3600000000::DOUBLE))::INT AS bar, count(*) AS n_events, round(sum((px - 50) / 1e6::DOUBLE), 10) AS rate_sum,
  CASE WHEN count(*) FILTER (WHERE NOT coalesce(sz > 0, false)) > 0 THEN 'NaN'::DOUBLE ELSE round(sum(sz * (px - 50) / 1e6::DOUBLE), 9) END AS rate_px_sum, count(*) FILTER (WHERE NOT coalesce(sz > 0, false)) AS n_unpriced FROM ticks GROUP BY ALL""", ("ticks",))
def funding_by_period(spark, sf):
    """Hourly periods from the second of January; earlier events fall into negative periods and are not lost."""
    e = V.ticks(spark, sf).select("symbol", "timestamp", ((F.col("px") - 50) / 1e6).alias("funding_rate"), F.col("sz").alias("notional_price"))
    d = ledger.funding_by_bar(e, F.lit("2024-01-02").cast("timestamp_ntz"), 3_600_000_000)
    return _rounded(d, {"rate_sum": 10, "rate_px_sum": 9})


@query("funding_excluded", """SELECT symbol, count(*) FILTER (WHERE timestamp < TIMESTAMP '2024-01-02' OR timestamp >= TIMESTAMP '2024-01-22') AS n_excluded FROM ticks GROUP BY symbol""", ("ticks",))
def funding_excluded(spark, sf):
    e = V.ticks(spark, sf).select("symbol", "timestamp", F.lit(0.0).alias("funding_rate"), F.col("sz").alias("notional_price"))
    return ledger.excluded_events(ledger.funding_by_bar(e, F.lit("2024-01-02").cast("timestamp_ntz"), 3_600_000_000), 20 * 24 + 1)


# --- moving-average portfolio ------------------------------------------------------------------------------------------

_SMA_VIEWS = {
    "market": """SELECT *, 0.0::DOUBLE AS rate_sum, 0.0::DOUBLE AS rate_px_sum FROM (SELECT 'S' || (l_partkey % 4) AS symbol, ((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1)::INT AS bar,
    round(sum(l_extendedprice) / sum(l_quantity), 6) AS px FROM lineitem GROUP BY 1, 2)""",
    "runs": """SELECT 'sma/fee_bps=' || fee || '/lag=' || lag AS run_id, first_bar, last_bar, 1234567.891::DOUBLE AS capital, fee::DOUBLE AS fee_bps, 1.0::DOUBLE AS slippage_bps, lag, 'disabled' AS funding
    FROM (SELECT min(bar) + 5 AS first_bar, max(bar) AS last_bar FROM market), (SELECT unnest(['0.0', '4.5', '20.0']) AS fee), (SELECT unnest([1, 2]) AS lag)""",
    "targets": """SELECT r.run_id, w.bar, w.symbol, w.weight FROM (SELECT symbol, bar, CASE WHEN px > sma THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM sma) w
    JOIN (SELECT bar FROM (SELECT symbol, bar, (px > sma) AS s, lag(px > sma) OVER (PARTITION BY symbol ORDER BY bar) AS l FROM sma) GROUP BY bar HAVING bool_or(s IS DISTINCT FROM l)) m ON m.bar = w.bar CROSS JOIN runs r""",
    "sma": "SELECT * FROM (SELECT symbol, bar, px, avg(px) OVER f AS sma, count(*) OVER f AS n FROM market WINDOW f AS (PARTITION BY symbol ORDER BY bar ROWS 5 PRECEDING)) WHERE n = 6",
}
V.SQL_VIEWS.setdefault("sma", _SMA_VIEWS["sma"])


def sma_inputs(spark, sf):
    """Six-month average on four symbols, equal weights, rebalanced on change, for a grid of fees and lags."""
    (m,) = _stored(market=V.monthly_prices(spark, sf, 4))
    s = signals.sma_signal(m.withColumnRenamed("px", "close"), 6, ["symbol"], "bar")
    w = signals.equal_weights(s, 4).select("symbol", "bar", "target_weight").withColumn("run_id", F.lit("sma"))
    mask = signals.rebalance_on_change(w, ["run_id"], "bar").where("rebalance").select("bar")
    bounds = m.agg((F.min("bar") + 5).alias("first_bar"), F.max("bar").alias("last_bar"))
    base = bounds.select(F.lit("sma").alias("run_id"), "first_bar", "last_bar", F.lit(1234567.891).alias("capital"), F.lit(1.0).alias("slippage_bps"), F.lit("disabled").alias("funding"))
    runs = ledger.run_grid(base, fee_bps=[0.0, 4.5, 20.0], lag=[1, 2])
    marked = w.join(mask, on="bar").select("bar", "symbol", F.col("target_weight").alias("weight"), F.lit("sma").alias("_base"))
    targets = runs.select("run_id", F.lit("sma").alias("_base")).join(marked, on="_base").drop("_base")
    return m, *_stored(targets=targets, runs=runs)


_SMA_NEEDS = ("market", "sma", "runs", "targets", "perf")


@query("sma_backtest_metrics", f"SELECT run_id, path, n AS n_periods, {_PERF_SQL} FROM perf", _SMA_NEEDS, **_SMA_VIEWS)
def sma_backtest_metrics(spark, sf):
    return _rounded(_performance(*sma_inputs(spark, sf)), _PERF_COLS).drop("rebalance_count", "ruined")


@query("run_grid_metrics", "SELECT run_id, round(c.total_return - a.total_return, 8) AS total_drag_return FROM perf a JOIN perf c USING (run_id) WHERE a.path = 'actual' AND c.path = 'counterfactual'", _SMA_NEEDS, **_SMA_VIEWS)
def run_grid_metrics(spark, sf):
    """Cost drag of every combination of fee and lag."""
    return _rounded(metrics.cost_drag(_performance(*sma_inputs(spark, sf))).select("run_id", "total_drag_return"), {"total_drag_return": 8})


_WEIGHTS = "SELECT symbol, bar, CASE WHEN px > 1530 THEN 0.25::DOUBLE WHEN px < 1480 THEN NULL ELSE 0.0::DOUBLE END AS target_weight FROM monthly_prices"


def _weights(spark, sf):
    px = F.col("px")
    w = V.monthly_prices(spark, sf).withColumn("target_weight", F.when(px > 1530, 0.25).when(px >= 1480, 0.0))
    return w.select(F.lit("w").alias("run_id"), "symbol", "bar", "target_weight")


@query("rebalance_on_change", f"""SELECT 'w' AS run_id, bar, bool_or(rn = 1 OR target_weight IS DISTINCT FROM before) AS rebalance FROM (SELECT *, row_number() OVER w AS rn, lag(target_weight) OVER w AS before FROM ({_WEIGHTS})
  WINDOW w AS (PARTITION BY symbol ORDER BY bar)) GROUP BY bar""", ("monthly_prices",))
def rebalance_on_change(spark, sf):
    return signals.rebalance_on_change(_weights(spark, sf), ["run_id"], "bar")


@query("rebalance_on_dates", f"SELECT DISTINCT 'w' AS run_id, bar, bar % 3 = 0 AS rebalance FROM ({_WEIGHTS})", ("monthly_prices",))
def rebalance_on_dates(spark, sf):
    w = _weights(spark, sf)
    return signals.rebalance_on_dates(w, w.where(F.col("bar") % 3 == 0), ["run_id"], "bar")


@query("exit_unnamed", f"""WITH w AS ({_WEIGHTS}) SELECT symbol, bar, target_weight FROM w WHERE bar % 3 <> 0 UNION ALL
  SELECT symbol, bar, CASE WHEN target_weight IS NULL AND coalesce(lag(target_weight) OVER (PARTITION BY symbol ORDER BY bar) <> 0, false) THEN 0.0::DOUBLE ELSE target_weight END FROM w WHERE bar % 3 = 0""", ("monthly_prices",))
def exit_unnamed(spark, sf):
    w = _weights(spark, sf)
    return signals.exit_unnamed(w, w.where(F.col("bar") % 3 == 0), ["run_id"], "bar").drop("run_id")


# --- two venues, one strategy --------------------------------------------------------------------------------------------

_TWO = {
    "market": """SELECT *, 0.0::DOUBLE AS rate_sum, 0.0::DOUBLE AS rate_px_sum FROM (SELECT l_returnflag || 'S' || (l_partkey % 4) AS symbol, ((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1)::INT AS bar,
    round(sum(l_extendedprice) / sum(l_quantity), 6) AS px FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)""",
    "runs": "SELECT v AS run_id, min(bar) + 5 AS first_bar, max(bar) AS last_bar, 1234567.891::DOUBLE AS capital, 4.5::DOUBLE AS fee_bps, 1.0::DOUBLE AS slippage_bps, 1 AS lag, 'disabled' AS funding FROM market, (SELECT unnest(['A', 'R']) AS v) GROUP BY v",
    "targets": """SELECT left(w.symbol, 1) AS run_id, w.bar, w.symbol, w.weight FROM (SELECT symbol, bar, CASE WHEN px > sma THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM sma) w
    JOIN (SELECT left(symbol, 1) AS v, bar FROM (SELECT symbol, bar, (px > sma) AS s, lag(px > sma) OVER (PARTITION BY symbol ORDER BY bar) AS l FROM sma) GROUP BY ALL HAVING bool_or(s IS DISTINCT FROM l)) m ON m.v = left(w.symbol, 1) AND m.bar = w.bar""",
    "sma": _SMA_VIEWS["sma"],
}


@query("crossvenue_run_compare", """SELECT p.run_id AS venue, (SELECT count(*) FROM led WHERE led.run_id = p.run_id AND path = 'actual' AND rebalance) AS n_rebalances, round(total_return, 9) AS total_return, round(mdd, 9) AS max_drawdown, round(vol, 8) AS realized_volatility,
  (SELECT count(*) FROM (SELECT symbol, px, lag(px) OVER (PARTITION BY symbol ORDER BY bar) AS before FROM market) WHERE px = before AND left(symbol, 1) = p.run_id) AS n_repeated_prices FROM perf p WHERE path = 'actual'""", _SMA_NEEDS, **_TWO)
def crossvenue_run_compare(spark, sf):
    """The same strategy on the prices of two venues (return flags): the venue is the run."""
    li = V.table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    symbol = F.concat("l_returnflag", F.lit("S"), (F.col("l_partkey") % 4).cast("string"))
    bar = ((F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate") - 1).cast("int")
    (m,) = _stored(market=li.groupBy(symbol.alias("symbol"), bar.alias("bar")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("px")))
    s = signals.sma_signal(m.withColumnRenamed("px", "close"), 6, ["symbol"], "bar")
    w = signals.equal_weights(s, 4).select(F.left("symbol", F.lit(1)).alias("run_id"), "symbol", "bar", "target_weight")
    mask = signals.rebalance_on_change(w, ["run_id"], "bar").where("rebalance").select("run_id", "bar")
    targets = w.join(mask, on=["run_id", "bar"]).select("run_id", "bar", "symbol", F.col("target_weight").alias("weight"))
    bounds = m.agg((F.min("bar") + 5).alias("first_bar"), F.max("bar").alias("last_bar"))
    runs = bounds.select(F.explode(F.array(F.lit("A"), F.lit("R"))).alias("run_id"), "first_bar", "last_bar", F.lit(1234567.891).alias("capital"), F.lit(4.5).alias("fee_bps"), F.lit(1.0).alias("slippage_bps"), F.lit(1).alias("lag"))
    perf = _performance(m, *_stored(targets=targets, runs=runs), False)
    repeats = compare.repeated_closes(m.select("symbol", F.col("bar").alias("timestamp"), F.col("px").alias("close")))
    repeats = repeats.groupBy(F.left("symbol", F.lit(1)).alias("run_id")).agg(F.sum("n_repeated").cast("bigint").alias("n_repeated_prices"))
    d = perf.join(repeats, on="run_id")
    d = d.select(F.col("run_id").alias("venue"), F.col("rebalance_count").alias("n_rebalances"), "total_return", "max_drawdown", F.col("annualized_volatility").alias("realized_volatility"), "n_repeated_prices")
    return _rounded(d, {"total_return": 9, "max_drawdown": 9, "realized_volatility": 8})
