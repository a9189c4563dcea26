"""Portfolio ledger: net asset value, trades, costs, funding and ruin for many runs at once.

A period-by-period loop over NAV is not needed. Between two rebalances the quantities are constant, and with the
NAV at the start of a stretch set to one, quantity per unit is ``a = weight / price at the rebalance``. So within
stretch k

    x_i = sum_j a_kj * (P_{i+1,j} - P_ij - funding_ij)         one aggregation over held positions
    H_i = 1 + running sum of x inside the stretch               growth since the rebalance
    t_k = sum_j |w_kj - a_{k-1,j} * P_j / H_{last of k-1}|      turnover of the rebalance
    NAV_{i+1} = NAV_0 * prod over earlier rebalances of (1 - c t) * H_last, times (1 - c t_k) * H_i

Only held positions are expanded to periods. The heavy step is one equality join of those positions with prices
and one map-side-combined sum per (run, period). What remains are windows over the periods of one run: as many
rows as the run has bars, 87,600 for ten years of hours, whatever the number of runs or symbols.

Inputs
    market   symbol, bar, px [, rate_sum, rate_px_sum]   one row per symbol and bar on a gap-free integer grid
    targets  run_id, bar, symbol, weight                 rows on rebalance bars only; unnamed symbols go to zero
    runs     run_id, first_bar, last_bar, capital, fee_bps, slippage_bps, lag [, funding, max_leverage]
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.functions.numeric import finite, finite_positive, ratio
from tapeledger.functions.timegrid import epoch_us, from_epoch_us
from tapeledger.operators.intervals import single_cover
from tapeledger.session import cut_lineage

FUNDING_MODES = ("disabled", "period_start", "event_price")


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run, checked when it is made."""

    run_id: str
    fee_bps: float
    slippage_bps: float
    first_bar: int
    last_bar: int
    capital: float = 1_000_000.0
    lag: int = 1
    funding: str = "disabled"
    max_leverage: float | None = None

    def __post_init__(self) -> None:
        if self.lag < 1:
            raise ValueError("a lag below one bar would trade on prices the signal has already seen")
        if self.last_bar - self.first_bar < 1:
            raise ValueError("a run needs at least two bars")
        if self.funding not in FUNDING_MODES:
            raise ValueError(f"funding must be one of {FUNDING_MODES}")
        if self.fee_bps is None or self.slippage_bps is None:
            raise ValueError("fee_bps and slippage_bps are required")


def run_grid(runs: DataFrame, **choices: list) -> DataFrame:
    """Every combination of the listed settings for every run; the run id gets a suffix per setting."""
    out = runs
    for name, values in choices.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        out = out.withColumn("run_id", F.concat_ws("/", "run_id", F.concat(F.lit(f"{name}="), F.col(name).cast("string"))))
    return out


def execution_price(bars: DataFrame, mode: str) -> DataFrame:
    """The one price series a run uses: the open of the bar it trades in, or its close."""
    if mode not in ("next_open", "next_close"):
        raise ValueError(f"unknown execution mode {mode!r}")
    return bars.withColumn("px", F.col("open" if mode == "next_open" else "close"))


def execution_shift_us(mode: str, width_us: int) -> int:
    """A bar's open happens at its label, its close one bar width later."""
    return {"next_open": 0, "next_close": width_us}[mode]


def executions(bars: DataFrame, mode: str, width_us: int) -> DataFrame:
    """Price ``px`` and instant ``executed_at`` at which a target would be executed in each bar."""
    return execution_price(bars, mode).withColumn("executed_at", from_epoch_us(epoch_us("timestamp") + F.lit(execution_shift_us(mode, width_us))))


def _with_next_price(market: DataFrame) -> DataFrame:
    along = Window.partitionBy("symbol").orderBy("bar")
    follows = F.lead("bar").over(along) == F.col("bar") + 1
    out = market.withColumn("px_next", F.when(follows, F.lead("px").over(along)))
    for name in ("rate_sum", "rate_px_sum"):
        if name not in market.columns:
            out = out.withColumn(name, F.lit(0.0))
    return out.select("symbol", "bar", "px", "px_next", F.coalesce("rate_sum", F.lit(0.0)).alias("rate_sum"), F.coalesce("rate_px_sum", F.lit(0.0)).alias("rate_px_sum"))


def _settings(runs: DataFrame) -> DataFrame:
    out = runs
    for name, default in (("funding", F.lit("disabled")), ("max_leverage", F.lit(None).cast("double"))):
        if name not in runs.columns:
            out = out.withColumn(name, default)
    return out


def stretches(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Executed rebalances: run_id, symbol, weight, begin (execution bar), until (last bar before the next one).
    A rebalance whose execution bar has no period after it is not executed. A missing weight is NaN, never an exit."""
    settings = runs.select("run_id", "first_bar", "last_bar", "lag")
    executed = targets.join(settings, on="run_id").withColumn("begin", F.col("bar") + F.col("lag"))
    executed = executed.where((F.col("bar") >= F.col("first_bar")) & (F.col("begin") < F.col("last_bar")))
    bars = executed.select("run_id", "begin", "last_bar").distinct()
    nxt = F.lead("begin").over(Window.partitionBy("run_id").orderBy("begin"))
    bars = bars.select("run_id", "begin", (F.coalesce(nxt, F.col("last_bar")) - 1).alias("until"), nxt.isNotNull().alias("replaced"))
    return executed.select("run_id", "begin", "symbol", F.coalesce(F.col("weight").cast("double"), F.lit(float("nan"))).alias("weight")).join(bars, on=["run_id", "begin"])


def sized(stretch: DataFrame, market: DataFrame) -> DataFrame:
    """Stretches with a position and their unit quantity ``a`` (NULL where the entry price is missing)."""
    entry = market.select("symbol", F.col("bar").alias("begin"), F.col("px").alias("entry_px"))
    held = stretch.where(F.col("weight") != 0).join(entry, on=["symbol", "begin"], how="left")
    return held.withColumn("a", ratio(F.col("weight"), F.col("entry_px")))


def held_positions(stretch: DataFrame, market: DataFrame) -> DataFrame:
    """One row per (run, symbol, period) with a position: weight, unit quantity ``a``, price and next price."""
    spread = sized(stretch, market).withColumn("bar", F.explode(F.sequence("begin", "until")))
    return spread.join(_with_next_price(market), on=["symbol", "bar"], how="left")


def _trade_legs(stretch: DataFrame, market: DataFrame) -> DataFrame:
    """Per rebalance and symbol that is held on either side: new weight ``w`` and value ``v`` of the old position per
    unit of the stretch before."""
    exit_px = market.select("symbol", (F.col("bar") - 1).alias("until"), F.col("px").alias("exit_px"))
    zero = F.lit(0.0)
    enters = stretch.select("run_id", F.col("begin").alias("bar"), "symbol", F.col("weight").alias("w"), zero.alias("v"))
    leaves = sized(stretch, market).where("replaced").join(exit_px, on=["symbol", "until"], how="left")
    value = F.coalesce(F.col("a") * F.col("exit_px"), F.lit(float("nan")))
    leaves = leaves.select("run_id", (F.col("until") + 1).alias("bar"), "symbol", zero.alias("w"), value.alias("v"))
    return enters.unionByName(leaves).groupBy("run_id", "bar", "symbol").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))


def _period_sums(held: DataFrame, stretch: DataFrame, runs: DataFrame) -> DataFrame:
    """Per (run, bar): asset and funding return per unit, exposure sums, and whether it rebalances.
    Periods without a position come in as zero rows. A missing price turns the sums into NaN, never into zero."""
    amounts = {
        "ax": F.col("a") * (F.col("px_next") - F.col("px")),
        "fx_start": -F.col("a") * F.col("px") * F.col("rate_sum"),
        "fx_event": -F.col("a") * F.col("rate_px_sum"),
        "gross": F.abs(F.col("a") * F.col("px")),
        "net": F.col("a") * F.col("px"),
    }
    nan, no = F.lit(float("nan")), F.lit(False)
    part = held.select("run_id", "bar", *[F.coalesce(c, nan).alias(n) for n, c in amounts.items()], no.alias("rebalance"))
    every = F.explode(F.sequence("first_bar", F.col("last_bar") - 1)).alias("bar")
    blank = [F.lit(0.0).alias(n) for n in amounts]
    rows = part.unionByName(runs.select("run_id", every, *blank, no.alias("rebalance"))).unionByName(stretch.select("run_id", F.col("begin").alias("bar"), *blank, F.lit(True).alias("rebalance")))
    return rows.groupBy("run_id", "bar").agg(*[F.sum(n).alias(n) for n in amounts], F.bool_or("rebalance").alias("rebalance"))


def _with_growth(sums: DataFrame, settings: DataFrame, counterfactual: bool) -> DataFrame:
    """Periods of every path with ``growth`` since the rebalance and ``before``, what it had come to before the period."""
    paths = F.array(F.lit("actual"), F.lit("counterfactual")) if counterfactual else F.array(F.lit("actual"))
    actual = F.col("path") == "actual"
    d = sums.join(settings, on="run_id").withColumn("path", F.explode(paths)).withColumns(
        {
            "fee": F.when(actual, F.col("fee_bps")).otherwise(0.0) / 10_000,
            "slip": F.when(actual, F.col("slippage_bps")).otherwise(0.0) / 10_000,
            "fx": F.when(actual & (F.col("funding") == "period_start"), F.col("fx_start")).when(actual & (F.col("funding") == "event_price"), F.col("fx_event")).otherwise(0.0),
        }
    )
    run = Window.partitionBy("run_id", "path").orderBy("bar")
    d = d.withColumn("stretch", F.sum(F.col("rebalance").cast("bigint")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("run_id", "path", "stretch").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("growth", 1.0 + F.sum(F.col("ax") + F.col("fx")).over(inside))
    return d.withColumn("before", F.coalesce(F.lag("growth").over(run), F.lit(1.0)))


def _turnovers(grown: DataFrame, legs: DataFrame) -> DataFrame:
    """Per rebalance of a path: turnover and the exposures of the old positions, summed over one row per symbol and leg."""
    old = ratio(F.col("v"), F.col("before"))
    each = grown.where("rebalance").select("run_id", "path", "bar", "before").join(legs, on=["run_id", "bar"])
    return each.groupBy("run_id", "path", "bar").agg(F.sum(F.abs(F.col("w") - old)).alias("traded"), F.sum(F.abs(old)).alias("old_gross"), F.sum(old).alias("old_net"))


def ledger(market: DataFrame, targets: DataFrame, runs: DataFrame, counterfactual: bool = False, held: DataFrame | None = None) -> DataFrame:
    """One row per (run, path, bar) up to and including the period of ruin.

    ``path`` is ``actual`` or, if asked for, ``counterfactual``: the same trades without costs and funding. The
    position sums are shared by both paths. What is traded stays one row per symbol and leg: the growth of a stretch does
    not depend on it, so turnovers are summed in a shuffle of their own. ``held`` are ``held_positions``, if they are stored."""
    settings = _settings(runs)
    stretch = stretches(targets, settings)
    sums = _period_sums(held_positions(stretch, market) if held is None else held, stretch, settings)
    grown = cut_lineage(_with_growth(sums, settings, counterfactual), "ledger-growth")
    # turnovers come as rows of their own beside the periods they belong to: a join by bar would shuffle all periods once more
    traded = _turnovers(grown, _trade_legs(stretch, market))
    d = grown.withColumn("_period", F.lit(True)).unionByName(traded, allowMissingColumns=True).repartition("run_id", "path")
    here = Window.partitionBy("run_id", "path", "bar")  # two rows at most
    d = d.withColumns({c: F.max(c).over(here) for c in ("traded", "old_gross", "old_net")}).where("_period")
    run = Window.partitionBy("run_id", "path").orderBy("bar")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("turnover", F.when(F.col("rebalance"), F.col("traded")).otherwise(0.0))
    d = d.withColumn("keep", 1.0 - (F.col("fee") + F.col("slip")) * F.col("turnover"))
    d = d.withColumn("factor", F.when(F.col("rebalance"), F.col("keep") * F.col("before")).otherwise(1.0))
    d = d.withColumn("scale", F.col("capital") * F.product("factor").over(so_far))
    d = d.withColumn("nav_pre", F.coalesce(F.lag("scale").over(run), F.col("capital")) * F.col("before"))
    d = d.withColumn("stage", F.when(F.col("keep") <= 0, "cost").when(F.col("growth") <= 0, "pnl"))
    d = d.withColumn("ruin_bar", F.min(F.when(F.col("stage").isNotNull(), F.col("bar"))).over(Window.partitionBy("run_id", "path")))
    d = d.where(F.col("ruin_bar").isNull() | (F.col("bar") <= F.col("ruin_bar")))
    return _report(d)


def _report(d: DataFrame) -> DataFrame:
    ruined_at_cost, ruined = F.col("stage") == "cost", F.col("stage").isNotNull()
    cost = F.coalesce(ruined_at_cost, F.lit(False))
    nan = F.lit(float("nan"))
    start_growth = F.when(F.col("rebalance"), F.lit(1.0)).otherwise(F.col("before"))
    d = d.withColumn("nav_after_cost", F.col("nav_pre") * F.col("keep"))
    asset = F.when(cost, nan).otherwise(F.col("scale") * F.col("ax"))
    funding = F.when(cost, nan).otherwise(F.col("scale") * F.col("fx"))
    end = F.col("scale") * F.col("growth")
    uncapped = F.when(cost, F.col("keep") - 1.0).when(ruined, ratio(end, F.col("nav_pre")) - 1.0)
    d = d.withColumns(
        {
            "trade_notional": F.col("turnover") * F.col("nav_pre"),
            "fee_cost": F.col("turnover") * F.col("nav_pre") * F.col("fee"),
            "slippage_cost": F.col("turnover") * F.col("nav_pre") * F.col("slip"),
            "asset_pnl": asset, "funding_pnl": funding,
            "nav_end": F.when(ruined, F.lit(0.0)).otherwise(end),
            "net_return": F.when(ruined, F.lit(-1.0)).otherwise(ratio(end, F.col("nav_pre")) - 1.0),
            "fee_return": -F.col("turnover") * F.col("fee"), "slippage_return": -F.col("turnover") * F.col("slip"),
            "gross_exposure": F.when(cost, F.col("old_gross")).otherwise(ratio(F.col("gross"), start_growth)),
            "net_exposure": F.when(cost, F.col("old_net")).otherwise(ratio(F.col("net"), start_growth)),
            "uncapped_ruin_return": uncapped, "ruin_stage": F.col("stage"),
        }
    )
    d = d.withColumns({"gross_return": ratio(F.col("asset_pnl"), F.col("nav_pre")), "funding_return": ratio(F.col("funding_pnl"), F.col("nav_pre"))})
    d = d.withColumn("leverage_breach", F.coalesce(F.col("gross_exposure") > F.col("max_leverage"), F.lit(False)))
    return d.select(
        "run_id", "path", "bar", "rebalance", "turnover", "nav_pre", "fee_cost", "slippage_cost", "trade_notional", "nav_after_cost",
        "asset_pnl", "funding_pnl", "nav_end", "net_return", "gross_return", "fee_return", "slippage_return", "funding_return",
        "gross_exposure", "net_exposure", "leverage_breach", "ruin_stage", "uncapped_ruin_return",
    )


def positions(market: DataFrame, targets: DataFrame, runs: DataFrame, periods: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Per (run, bar, symbol) of the actual path: state, quantity, notional, weight held, weight before the trade
    and trade. Rows exist for symbols that are held or trade in the period; every other symbol is INACTIVE."""
    if held is None:
        held = held_positions(stretches(targets, _settings(runs)), market)
    now = held.select("run_id", "bar", "symbol", "a", "px", "weight", (F.col("bar") == F.col("begin")).alias("_starts"), F.lit(0.0).alias("_pa"), F.lit(None).cast("double").alias("_ppx"))
    # the same position one period later: what is held before that period's trade
    later = held.where((F.col("bar") < F.col("until")) | F.col("replaced")).select(
        "run_id", (F.col("bar") + 1).alias("bar"), "symbol", F.lit(0.0).alias("a"), F.lit(None).cast("double").alias("px"), F.lit(0.0).alias("weight"), F.lit(False).alias("_starts"), F.col("a").alias("_pa"), F.col("px_next").alias("_ppx"),
    )
    both = now.unionByName(later).groupBy("run_id", "bar", "symbol").agg(
        F.sum("a").alias("a"), F.max("px").alias("px"), F.sum("weight").alias("weight"), F.sum("_pa").alias("prev_a"), F.max("_ppx").alias("prev_px"),
    )
    d = both.join(_with_units(periods), on=["run_id", "bar"])
    had, has = F.col("prev_a") != 0, F.col("a") != 0
    state = F.when(had & has, "HELD").when(has, "ENTERING").when(had, "EXITING").otherwise("INACTIVE")
    cost = F.coalesce(F.col("ruin_stage") == "cost", F.lit(False))
    px = F.coalesce("px", "prev_px")
    before = F.col("_prev_unit") * F.col("prev_a")
    w_pre = F.when(had, ratio(before * px, F.col("nav_pre"))).otherwise(0.0)
    quantity = F.when(cost, before).otherwise(F.col("_unit") * F.col("a"))
    return d.select(
        "run_id", "bar", "symbol", state.alias("state"), quantity.alias("quantity"), (quantity * px).alias("notional"),
        F.when(cost, w_pre).otherwise(ratio(quantity * px, F.col("nav_after_cost"))).alias("weight_held"), w_pre.alias("pre_trade_weight"),
        F.when(F.col("rebalance"), F.col("weight") - w_pre).otherwise(0.0).alias("trade"),
    )


def _with_units(periods: DataFrame) -> DataFrame:
    """NAV after cost at the last rebalance: what one unit of ``a`` is worth in cash, now and before the trade."""
    run = Window.partitionBy("run_id").orderBy("bar")
    at = F.last(F.when(F.col("rebalance"), F.col("nav_after_cost")), ignorenulls=True)
    p = periods.where("path = 'actual'").withColumn("_unit", at.over(run.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_prev_unit", at.over(run.rowsBetween(Window.unboundedPreceding, -1)))
    return p.select("run_id", "bar", "rebalance", "nav_pre", "nav_after_cost", "ruin_stage", "_unit", "_prev_unit")


def equity_curve(periods: DataFrame) -> DataFrame:
    """Equity at the start and after every period: one point more than there are periods."""
    first = F.min("bar").over(Window.partitionBy("run_id", "path"))
    end = F.struct((F.col("bar") + 1).alias("bar"), F.col("nav_end").alias("equity"))
    start = F.struct("bar", F.col("nav_pre").alias("equity"))
    points = F.when(F.col("bar") == first, F.array(start, end)).otherwise(F.array(end))
    return periods.select("run_id", "path", points.alias("_points")).select("run_id", "path", F.inline("_points"))


def accounting_violations(periods: DataFrame) -> DataFrame:
    """Periods whose NAV is not a number: an error of the inputs, never a ruin."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | F.col(c).isNull()
    return periods.where(bad("nav_after_cost") | bad("nav_end")).select("run_id", "path", "bar", F.lit("NON_FINITE_NAV").alias("code"))


def stored_positions(market: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """``held_positions`` written once, for callers that read them for the ledger and for the positions."""
    return cut_lineage(held_positions(stretches(targets, _settings(runs)), market), "held-positions")


def prices_in_use(market: DataFrame, targets: DataFrame, runs: DataFrame, periods: DataFrame) -> DataFrame:
    """The prices a run reads: at the start and the end of every period in which it holds the symbol, up to its ruin
    (``periods``, its ledger). The end price of the last period of a stretch is the price at which the symbol exits or is resized."""
    held = held_positions(stretches(targets, _settings(runs)), market)
    held = held.join(periods.where("path = 'actual'").select("run_id", "bar"), on=["run_id", "bar"], how="left_semi")
    starts = held.select("run_id", "symbol", "bar", F.lit("period_start").alias("use"), "px")
    ends = held.select("run_id", "symbol", (F.col("bar") + 1).alias("bar"), F.lit("period_end").alias("use"), F.col("px_next").alias("px"))
    return starts.unionByName(ends)


def unexecuted_rebalances(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Rebalance bars whose execution would come too late to have a period of their own."""
    marked = targets.select("run_id", "bar").distinct().join(runs.select("run_id", "first_bar", "last_bar", "lag"), on="run_id")
    late = F.col("bar") + F.col("lag") > F.col("last_bar") - 1
    return marked.where(late & F.col("bar").between(F.col("first_bar"), F.col("last_bar"))).select("run_id", "bar")


def target_violations(targets: DataFrame, market: DataFrame) -> DataFrame:
    """Targets that cannot be executed: no weight on a rebalance bar, or a symbol the market does not have."""
    empty = targets.where(F.col("weight").isNull() | F.isnan("weight")).select("run_id", "bar", "symbol", F.lit("MISSING_WEIGHT").alias("code"))
    known = market.select("symbol").distinct()
    unknown = targets.join(known, on="symbol", how="left_anti").select("run_id", "bar", "symbol", F.lit("UNKNOWN_SYMBOL").alias("code"))
    return empty.unionByName(unknown)


def setting_findings(runs: DataFrame) -> DataFrame:
    """Broken settings, one row per run and code. Errors keep a run from being computed; a negative cost is a warning."""
    r, bad = _settings(runs), lambda c: ~finite(F.col(c))
    codes = F.array_compact(F.array(
        F.when(F.coalesce(F.col("lag") < 1, F.lit(True)), F.lit("error:LAG_BELOW_ONE")),
        F.when(F.coalesce(F.col("last_bar") - F.col("first_bar") < 1, F.lit(True)), F.lit("error:TOO_FEW_BARS")),
        F.when(~F.coalesce(F.col("funding").isin(*FUNDING_MODES), F.lit(False)), F.lit("error:UNKNOWN_FUNDING_MODE")),
        F.when(bad("fee_bps"), F.lit("error:FEE_REQUIRED")), F.when(bad("slippage_bps"), F.lit("error:SLIPPAGE_REQUIRED")),
        F.when(~finite_positive(F.col("capital")), F.lit("error:BAD_CAPITAL")),
        F.when((F.col("fee_bps") < 0) | (F.col("slippage_bps") < 0), F.lit("warning:NEGATIVE_COST")),
    ))
    found = r.select("run_id", F.explode(codes).alias("c"))
    return found.select("run_id", F.split_part("c", F.lit(":"), F.lit(1)).alias("severity"), F.split_part("c", F.lit(":"), F.lit(2)).alias("code"), F.lit(1).cast("bigint").alias("n"))


def run_findings(market: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """What is wrong with runs before they are computed: ``run_id, severity, code, n``. Settings, targets that cannot be
    executed, runs without targets, targets without a run, and rebalances that come too late (a warning)."""
    known = runs.select("run_id").distinct()
    broken = target_violations(targets, market).groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.lit("error").alias("severity"), "code", "n")
    late = unexecuted_rebalances(targets, runs.dropDuplicates(["run_id"])).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.lit("warning").alias("severity"), F.lit("UNEXECUTED_REBALANCES").alias("code"), "n")
    asked = targets.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    idle = known.join(asked, on="run_id", how="left_anti").select("run_id", F.lit("error").alias("severity"), F.lit("NO_TARGETS").alias("code"), F.lit(1).cast("bigint").alias("n"))
    stray = asked.join(known, on="run_id", how="left_anti").select("run_id", F.lit("error").alias("severity"), F.lit("UNKNOWN_RUN").alias("code"), "n")
    twice = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("run_id", F.lit("error").alias("severity"), F.lit("DUPLICATE_RUN").alias("code"), "n")
    return setting_findings(runs).unionByName(broken).unionByName(late).unionByName(idle).unionByName(stray).unionByName(twice)


def sound_runs(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """The runs without an error, fit for the ledger."""
    return runs.join(findings.where("severity = 'error'").select("run_id").distinct(), on="run_id", how="left_anti")


def funding_by_bar(events: DataFrame, origin: Column, width_us: int, shift_us: int = 0) -> DataFrame:
    """Funding events per (symbol, bar): an event in ``[T_i, T_i+1)`` belongs to bar i. On a regular grid that is a
    division, so the range join becomes a plain aggregation. Where an event has no usable price the amount at event
    prices is NaN: a run that pays such an event is not finite rather than too cheap."""
    bar = F.floor((epoch_us("timestamp") - epoch_us(origin) - F.lit(shift_us)) / F.lit(width_us)).cast("int")
    usable = F.when(finite_positive(F.col("notional_price")), F.col("notional_price"))
    return events.groupBy("symbol", bar.alias("bar")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("funding_rate").alias("rate_sum"),
        F.when(F.count(usable) == F.count(F.lit(1)), F.sum(F.col("funding_rate") * usable)).otherwise(F.lit(float("nan"))).alias("rate_px_sum"),
        (F.count(F.lit(1)) - F.count(usable)).alias("n_unpriced"),
    )


def excluded_events(funding: DataFrame, n_bars: Column | int) -> DataFrame:
    """Events before the first execution instant or at and after the last one."""
    last = (n_bars if isinstance(n_bars, Column) else F.lit(n_bars)) - 1
    return funding.groupBy("symbol").agg(F.sum(F.when((F.col("bar") < 0) | (F.col("bar") >= last), F.col("n_events")).otherwise(0)).alias("n_excluded"))


def unpriced_funding(market: DataFrame, targets: DataFrame, runs: DataFrame, funding: DataFrame) -> DataFrame:
    """Held periods with a funding event that has no usable price, for runs that pay funding at event prices."""
    asked = _settings(runs).where("funding = 'event_price'")
    held = held_positions(stretches(targets, asked), market).select("run_id", "symbol", "bar")
    return held.join(funding.where("n_unpriced > 0").select("symbol", "bar", "n_unpriced"), on=["symbol", "bar"])


def uncovered_funding(market: DataFrame, targets: DataFrame, runs: DataFrame, coverage: DataFrame, bar_start: Column, bar_end: Column) -> DataFrame:
    """Held periods of funded runs that no single coverage record holds whole."""
    asked = _settings(runs).where("funding <> 'disabled'")
    held = held_positions(stretches(targets, asked), market).select("run_id", "symbol", "bar")
    periods = held.withColumns({"period_start": bar_start, "period_end": bar_end})
    return single_cover(periods, coverage).where("n_records <> 1")
