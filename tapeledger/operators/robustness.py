"""Robustness of a result: resampled returns, runs without one symbol, without their best stretches, and market beta.

Everything is a set of equality joins and map-side-combined sums; resamples are drawn by a hash of (seed, run, draw, block),
so a draw is the same on every cluster and SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.functions.numeric import ratio
from tapeledger.operators.ordered import with_position
from tapeledger.session import cut_lineage


def hashed_draw(n: Column, *parts: Column | str) -> Column:
    """A number from 0 to ``n`` - 1 by the first 12 hexadecimal digits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("bigint") % n


def return_blocks(returns: DataFrame, keys: list[str], time: str, value: str, block: int) -> DataFrame:
    """Blocks of ``block`` successive returns of each series: ``keys, block_no`` (from 0), count, sum and sum of squares.
    The last block of a series may be shorter."""
    placed = with_position(returns.select(*keys, time, value), keys, [time], F.lit(0), "_at")
    number = F.floor((F.col("_at") - 1) / block).cast("bigint").alias("block_no")
    return placed.groupBy(*keys, number).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))


def bootstrap_sharpe(returns: DataFrame, keys: list[str], time: str, value: str, block: int, draws: int, per_year: float, seed: int = 0) -> DataFrame:
    """Block bootstrap: ``keys, draw, sharpe`` for every resample of each series.

    A resample has as many blocks as the series, each picked by a hash. Only the three sums of a block are joined, not its
    returns; picks of one block in one resample are counted first. Sharpe is NULL without spread."""
    blocks = cut_lineage(return_blocks(returns, keys, time, value, block), "return-blocks")
    sizes = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_blocks"))
    slots = blocks.select(*keys, "block_no").join(sizes, on=keys).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = slots.select(*keys, "draw", hashed_draw(F.col("_blocks"), F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("draw").cast("string"), F.col("block_no").cast("string")).alias("block_no"))
    picked = picked.groupBy(*keys, "draw", "block_no").agg(F.count(F.lit(1)).alias("_times"))
    sums = picked.join(blocks, on=[*keys, "block_no"]).groupBy(*keys, "draw").agg(*[F.sum(F.col("_times") * F.col(c)).alias(c) for c in ("n", "s", "ss")])
    mean = F.col("s") / F.col("n")
    variance = F.greatest((F.col("ss") - F.col("s") * mean) / (F.col("n") - 1), F.lit(0.0))
    return sums.select(*keys, "draw", F.when(F.col("n") > 1, ratio(mean * F.sqrt(F.lit(per_year)), F.sqrt(variance))).alias("sharpe"))


def interval_estimates(samples: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean and the two percentiles of the resamples of each series (as many rows as there were draws)."""
    return samples.groupBy(*keys).agg(F.count(value).alias("n_draws"), F.avg(value).alias("mean"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))


def without_each(contributions: DataFrame, keys: list[str], member: str, time: str, value: str) -> DataFrame:
    """Returns of each series with one member left out: ``keys, left_out, time, value``, for every member it ever has.

    ``contributions(keys, member, time, value)`` add up to the series. The total of a period less the member's own part is
    its answer, so the work is one row per member and period."""
    whole = contributions.groupBy(*keys, time).agg(F.sum(value).alias("_total"))
    own = contributions.groupBy(*keys, member, time).agg(F.sum(value).alias("_own"))
    grid = whole.join(own.select(*keys, F.col(member).alias("left_out")).distinct(), on=keys)
    own = own.withColumnRenamed(member, "left_out")
    return grid.join(own, on=[*keys, "left_out", time], how="left").select(*keys, "left_out", time, (F.col("_total") - F.coalesce("_own", F.lit(0.0))).alias(value))


def return_summary(returns: DataFrame, keys: list[str], value: str, per_year: float) -> DataFrame:
    """``keys, n, total, sharpe`` of summed returns."""
    d = returns.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return d.select(*keys, "n", "total", ratio(F.col("_mean") * F.sqrt(F.lit(per_year)), F.col("_std")).alias("sharpe"))


def best_windows(returns: DataFrame, keys: list[str], time: str, value: str, width: int, most: int) -> DataFrame:
    """The best ``most`` windows of ``width`` successive returns that do not overlap, best first (ties to the earlier):
    ``keys, rank, first_position, last_position, total``.

    Greedy choice without a loop over returns: a window that beats every window it overlaps is chosen by any greedy order
    before them, so all such windows of all series are taken at once, those they overlap go, and the rest follow in
    the next round. Windows left never grow, and a round settles at least the best one of every series; once a series has
    ``most`` windows that beat everything left, it is done."""
    placed = with_position(returns.select(*keys, time, value), keys, [time], F.lit(0), "position")
    series = Window.partitionBy(*keys).orderBy("position")
    left = placed.withColumns({"total": F.sum(value).over(series.rowsBetween(0, width - 1)), "_n": F.count(F.lit(1)).over(series.rowsBetween(0, width - 1))})
    left = cut_lineage(left.where(F.col("_n") == width).select(*keys, "position", "total"), "windows")
    taken = None
    while True:
        order = F.struct("total", -F.col("position"))
        around = series.rangeBetween(-(width - 1), width - 1)
        marked = left.withColumn("_best", F.max(order).over(around) == order)
        near = F.max(F.col("_best").cast("int")).over(around) == 1
        marked = cut_lineage(marked.withColumn("_near", near), "window-round")
        taken = marked.where("_best").select(*keys, "position", "total") if taken is None else taken.unionByName(marked.where("_best").select(*keys, "position", "total"))
        taken = cut_lineage(taken, "windows-taken")
        left = marked.where("not _near").select(*keys, "position", "total")
        # a series needs no more rounds if enough taken windows beat all that is left of it
        ranked = taken.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "position"))).where(F.col("_rank") == most)
        edge = ranked.select(*keys, F.struct("total", -F.col("position")).alias("_edge"))
        left = cut_lineage(left.join(edge, on=keys, how="left").where(F.col("_edge").isNull() | (order > F.col("_edge"))).drop("_edge"), "windows-left")
        if left.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "position"))
    return taken.withColumn("rank", rank).where(F.col("rank") <= most).select(*keys, "rank", F.col("position").alias("first_position"), (F.col("position") + width - 1).alias("last_position"), "total")


def drop_best_windows(returns: DataFrame, keys: list[str], time: str, value: str, width: int, most: int, per_year: float) -> DataFrame:
    """``return_summary`` of each series without its best windows, and the number of returns taken out."""
    found = cut_lineage(best_windows(returns, keys, time, value, width, most), "best-windows")
    placed = with_position(returns.select(*keys, time, value), keys, [time], F.lit(0), "position")
    gone = found.select(*keys, F.explode(F.sequence("first_position", "last_position")).alias("position"))  # ``most`` times ``width`` rows
    kept = placed.join(gone, on=[*keys, "position"], how="left_anti")
    removed = gone.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_removed"))
    return return_summary(kept, keys, value, per_year).join(removed, on=keys, how="left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))


def market_beta(returns: DataFrame, market: DataFrame, keys: list[str], time: str, value: str, market_value: str) -> DataFrame:
    """``keys, n, beta, alpha, correlation`` of each series against the market's returns at the same times. Beta and
    correlation are NULL without spread."""
    both = returns.join(market.select(time, F.col(market_value).alias("_m")), on=time).where(F.col(value).isNotNull() & F.col("_m").isNotNull())
    d = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(value, "_m").alias("_c"), F.var_pop("_m").alias("_vm"), F.var_pop(value).alias("_v"), F.avg(value).alias("_a"), F.avg("_m").alias("_am"))
    beta = ratio(F.col("_c"), F.col("_vm"))
    return d.select(*keys, "n", beta.alias("beta"), (F.col("_a") - beta * F.col("_am")).alias("alpha"), ratio(F.col("_c"), F.sqrt(F.col("_vm") * F.col("_v"))).alias("correlation"))
