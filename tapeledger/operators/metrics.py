"""Performance figures of ledger runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.functions.numeric import ratio


def drawdowns(curve: DataFrame, keys: list[str] = ["run_id", "path"]) -> DataFrame:
    """Running maximum of the equity curve (its first point included) and the drop below it."""
    so_far = Window.partitionBy(*keys).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    out = curve.withColumn("peak", F.max("equity").over(so_far))
    return out.withColumn("drawdown", ratio(F.col("equity"), F.col("peak")) - 1.0)


def performance(
    periods: DataFrame, periods_per_year: Column | float, risk_free: float = 0.0, mar: float = 0.0, keys: list[str] = ["run_id", "path"],
) -> DataFrame:
    """The ten figures per run, its number of rebalances and whether it was ruined. With fewer than two periods everything that needs a spread is NaN; a ratio over
    zero is NaN; an overflowing growth rate stays infinite.

    One pass: the ledger is already partitioned by run, so the running peak (which starts at the capital, the NAV
    before the first period) and the aggregation that follows need no shuffle of their own."""
    per_year = periods_per_year if isinstance(periods_per_year, Column) else F.lit(float(periods_per_year))
    nan = F.lit(float("nan"))
    r = F.col("net_return")
    so_far = Window.partitionBy(*keys).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.first("nav_pre").over(so_far), F.max("nav_end").over(so_far))
    d = periods.withColumn("_drop", F.least(ratio(F.col("nav_end"), peak) - 1.0, F.lit(0.0))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg(r - risk_free).alias("_excess"), F.avg(r - mar).alias("_over_mar"), F.stddev_samp(r).alias("_std"),
        F.avg(F.pow(F.least(r - mar, F.lit(0.0)), 2)).alias("_down2"), F.avg("turnover").alias("avg_turnover"), F.min_by("nav_pre", "bar").alias("_first"),
        F.max_by("nav_end", "bar").alias("_last"), F.min("_drop").alias("max_drawdown"),
        F.count_if("rebalance").alias("rebalance_count"), F.bool_or(F.col("ruin_stage").isNotNull()).alias("ruined"),
    )
    many = F.col("n_periods") >= 2
    grown = ratio(F.col("_last"), F.col("_first"))
    d = d.withColumns(
        {
            "total_return": grown - 1.0, "cagr": F.pow(grown, per_year / F.col("n_periods")) - 1.0,
            "annualized_volatility": F.when(many, F.col("_std") * F.sqrt(per_year)).otherwise(nan),
            "downside_dev_ann": F.when(many, F.sqrt("_down2") * F.sqrt(per_year)).otherwise(nan),
        }
    )
    guarded = lambda top, low: F.when(~many | (F.col(low) == 0), nan).otherwise(top / F.col(low))
    return d.select(
        *keys, "n_periods", "total_return", "cagr", "annualized_volatility",
        guarded(F.col("_excess") * per_year, "annualized_volatility").alias("sharpe"), "downside_dev_ann",
        guarded(F.col("_over_mar") * per_year, "downside_dev_ann").alias("sortino"), "max_drawdown",
        F.when(F.col("max_drawdown") == 0, nan).otherwise(F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "avg_turnover", (F.col("avg_turnover") * per_year).alias("annualized_turnover"), "rebalance_count", "ruined",
    )


def run_flags(periods: DataFrame, unexecuted: DataFrame, runs: DataFrame, suspicious: DataFrame | None = None) -> DataFrame:
    """Per run of the actual path: counts, ruin and leverage flags, and the warning tokens in sorted order.

    ``suspicious(run_id)`` are runs that read funding from coverage whose gap limit looks far too wide. Runs whose column
    ``suppress_cagr`` is true are told so: their growth rate is not to be shown."""
    actual, other = F.col("path") == "actual", F.col("path") == "counterfactual"
    ended = lambda path, stage: F.bool_or(path & (F.coalesce(F.col("ruin_stage"), F.lit("")) == stage))
    both = periods.groupBy("run_id").agg(
        F.count_if(actual).alias("n_periods"), F.count_if(actual & F.col("rebalance")).alias("rebalance_count"), F.count_if(actual & F.col("leverage_breach")).alias("n_leverage_breaches"),
        ended(actual, "cost").alias("_cost"), ended(actual, "pnl").alias("_pnl"), F.count_if(other).alias("_cf_periods"), (ended(other, "cost") | ended(other, "pnl")).alias("_cf_ruined"),
    )
    late = unexecuted.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_unexecuted"))
    suppress = F.col("suppress_cagr") if "suppress_cagr" in runs.columns else F.lit(False)
    d = runs.select("run_id", suppress.alias("suppress_cagr"), *(["funding"] if "funding" in runs.columns else [])).join(both, on="run_id").join(late, on="run_id", how="left")
    d = d.withColumns({"n_unexecuted": F.coalesce("n_unexecuted", F.lit(0)), "ruin_stage": F.when(F.col("_cost"), "cost").when(F.col("_pnl"), "pnl")})
    status = F.when(F.col("_cf_periods") == 0, "NOT_COMPUTED").when(F.col("_cf_ruined"), "RUINED").otherwise("COMPLETED")
    comparable = (status == "COMPLETED") & F.col("ruin_stage").isNull() & (F.col("_cf_periods") == F.col("n_periods"))
    funded = F.col("funding") != "disabled" if "funding" in runs.columns else F.lit(False)
    marked = (suspicious if suspicious is not None else runs.limit(0)).select("run_id", F.lit(True).alias("_suspicious")).distinct()
    d = d.join(marked, on="run_id", how="left")
    tokens = F.array_sort(F.array_compact(F.array(
        F.when(F.col("ruin_stage").isNotNull(), "RUINED"), F.when(F.col("n_leverage_breaches") > 0, "LEVERAGE_BREACH"),
        F.when(~funded, "FUNDING_NOT_MODELLED"), F.when(status != "COMPLETED", F.concat(F.lit("COUNTERFACTUAL_"), status)),
        F.when(F.col("n_unexecuted") > 0, F.concat(F.lit("UNEXECUTED_REBALANCES:"), F.col("n_unexecuted").cast("string"))),
        F.when(~comparable, "DRAG_NOT_COMPARABLE"), F.when(funded & F.col("_suspicious"), "FUNDING_GAP_SUSPICIOUS"), F.when(F.col("suppress_cagr"), "CAGR_SUPPRESSED"),
    )))
    return d.select("run_id", "n_periods", "rebalance_count", "ruin_stage", "n_leverage_breaches", "n_unexecuted", tokens.alias("warnings"))


def cost_drag(performance_rows: DataFrame) -> DataFrame:
    """Counterfactual minus actual, only when both paths completed with the same number of periods."""
    side = lambda path, c: F.max(F.when(F.col("path") == path, F.col(c))).alias(f"{path}_{c}")
    both = performance_rows.groupBy("run_id").agg(*[side(p, c) for p in ("actual", "counterfactual") for c in ("n_periods", "total_return", "cagr", "ruined")])
    ok = ~F.col("actual_ruined") & ~F.col("counterfactual_ruined") & (F.col("actual_n_periods") == F.col("counterfactual_n_periods"))
    return both.select(
        "run_id", F.coalesce(ok, F.lit(False)).alias("comparable"),
        F.when(ok, F.col("counterfactual_total_return") - F.col("actual_total_return")).alias("total_drag_return"),
        F.when(ok, F.col("counterfactual_cagr") - F.col("actual_cagr")).alias("cagr_drag"),
    )
