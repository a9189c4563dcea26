"""Moving averages, signals, target weights and rebalance masks, all in long form (run, symbol, bar)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(bars: DataFrame, rows: int, keys: list[str] = ["symbol"], order: str = "timestamp", value: str = "close") -> DataFrame:
    """Mean of the last ``rows`` values; NULL until that many exist."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return bars.withColumn("sma", F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame)))


def after_warm_up(bars: DataFrame, rows: int, keys: list[str] = ["symbol"], order: str = "timestamp") -> DataFrame:
    """Drop the first ``rows - 1`` bars of each series."""
    along = Window.partitionBy(*keys).orderBy(order)
    return bars.withColumn("_n", F.row_number().over(along)).where(F.col("_n") >= rows).drop("_n")


def sma_signal(bars: DataFrame, rows: int, keys: list[str] = ["symbol"], order: str = "timestamp") -> DataFrame:
    """1 where the close is strictly above its average, else 0; bars without a full average are left out."""
    averaged = moving_average(bars, rows, keys, order)
    return averaged.where(F.col("sma").isNotNull()).withColumn("signal", (F.col("close") > F.col("sma")).cast("double"))


def rebalance_on_change(weights: DataFrame, keys: list[str], order: str, weight: str = "target_weight") -> DataFrame:
    """(keys, order, rebalance): true on the first bar of a run and wherever any symbol's weight differs from
    the bar before. Each symbol is compared with its own past, so the symbols of a run stay in parallel tasks."""
    along = Window.partitionBy(*keys, "symbol").orderBy(order)
    changed = F.row_number().over(along) == 1
    changed = changed | ~F.col(weight).eqNullSafe(F.lag(weight).over(along))
    marked = weights.select(*keys, "symbol", order, changed.alias("_changed"))
    return marked.groupBy(*keys, order).agg(F.bool_or("_changed").alias("rebalance"))


def rebalance_every_bar(weights: DataFrame, keys: list[str], order: str) -> DataFrame:
    return weights.select(*keys, order).distinct().withColumn("rebalance", F.lit(True))


def rebalance_on_dates(weights: DataFrame, dates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rebalance exactly on the bars listed in ``dates``."""
    marks = dates.select(order).distinct().withColumn("_on", F.lit(True))
    bars = weights.select(*keys, order).distinct().join(marks, on=order, how="left")
    return bars.select(*keys, order, F.coalesce("_on", F.lit(False)).alias("rebalance"))


def exit_unnamed(weights: DataFrame, dates: DataFrame, keys: list[str], order: str, weight: str = "target_weight") -> DataFrame:
    """Weights on rebalance bars; a symbol that was held at the rebalance before and is not named now gets an
    explicit zero. Bars that are not rebalances are left as they are."""
    on = weights.join(dates.select(order).distinct(), on=order, how="left_semi")
    off = weights.join(dates.select(order).distinct(), on=order, how="left_anti")
    along = Window.partitionBy(*keys, "symbol").orderBy(order)
    held = F.coalesce(F.lag(weight).over(along) != 0, F.lit(False))
    put = on.withColumn(weight, F.when(F.col(weight).isNull() & held, F.lit(0.0)).otherwise(F.col(weight)))
    return put.select(*weights.columns).unionByName(off.select(*weights.columns))


def equal_weights(signals: DataFrame, n_symbols: Column | int) -> DataFrame:
    share = n_symbols if isinstance(n_symbols, Column) else F.lit(n_symbols)
    return signals.withColumn("target_weight", F.col("signal") / share)
