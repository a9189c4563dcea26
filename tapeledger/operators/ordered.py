"""Ordered operations on series of any length.

A plain window over a series key puts the whole series into one task. That is fine for bars, whose keys are
unique on a fixed grid (a ten-year series of hourly bars has 87,600 rows), but not for ticks, events or log
lines, where one key may hold a third of the table. The operators here cut every series into blocks, work on
blocks in parallel, and pass only one summary row per block along the series. Blocks are first those of the
calendar (or of the sequence number); one with more than ``ROWS_PER_BLOCK`` rows is cut further by the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.session import cut_lineage

#: Rows of one block, at most; blocks that a round cuts a larger one into, and rows sampled for that.
ROWS_PER_BLOCK, FAN_OUT, SAMPLED = 1_000_000, 64, 4096

_COMBINE = {
    "first": lambda before, here: F.coalesce(before, here),
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
}
_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "first": F.first}
_OVER_BLOCKS = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "first": lambda c: F.first(c, ignorenulls=True)}


def row_blocks(df: DataFrame, keys: list[str], order: list[str], block: Column, most: int | None = None) -> DataFrame:
    """``df`` with ``_block``, which rises along each series, such that no block of a key has more than ``most``
    rows (``ROWS_PER_BLOCK`` if not given): the number of the block, or an array of numbers if any had to be cut.

    Blocks that are too large get splitters: rows of a sample, picked by a hash of the whole ``order``, at even distances.
    Rows of one time are told apart by the further columns of ``order``; only rows that agree in all of them stay
    together. A poor sample costs another round. Without large blocks this is one count, combined before the shuffle."""
    most = most or ROWS_PER_BLOCK
    cut, on, at = df.withColumn("_block", F.array(block.cast("bigint"))), [*keys, "_block"], F.struct(*order)
    done = None
    while True:
        large = cut.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
        large = cut_lineage(large.withColumn("_parts", F.least(F.lit(FAN_OUT), F.ceil(2 * F.col("_rows") / most))), "large-blocks")
        if large.isEmpty():
            return df.withColumn("_block", block.cast("bigint")) if done is None else done.unionByName(cut)
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(17), *order), 11) / float(1 << 53)
        sample = cut.join(large, on=on).where(draw * F.col("_rows") < SAMPLED)
        picked = sample.groupBy(*on).agg(F.array_sort(F.collect_set(at)).alias("_sample"), F.first("_parts").alias("_parts"))
        place = lambda i: F.element_at("_sample", F.ceil(i * F.size("_sample") / F.col("_parts")).cast("int"))
        splitters = picked.where(F.size("_sample") > 1).select(*on, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_parts").cast("int") - 1), place)).alias("_splitters"))
        splitters = cut_lineage(splitters, "splitters")
        marked = cut.join(splitters, on=on, how="left")
        part = F.size(F.filter("_splitters", lambda s: s < at)).cast("bigint")
        whole = marked.where("_splitters is null").drop("_splitters")  # small enough, or all rows alike
        done = cut_lineage(whole if done is None else done.unionByName(whole), "whole-blocks")
        cut = marked.where("_splitters is not null").withColumn("_block", F.concat("_block", F.array(part))).drop("_splitters")
        cut = cut_lineage(cut, "cut-blocks")


def all_short(df: DataFrame, keys: list[str], most: int | None = None) -> bool:
    """Whether no series has more than ``most`` rows (``ROWS_PER_BLOCK`` if not given). Then a series is one block, and its
    rows are shuffled once: blocks of many short series would be as many as the rows, and each would carry a summary.
    Series are counted by a hash of their keys; two that share one are counted together, which can only cut finer."""
    counts = df.groupBy(F.xxhash64(F.lit(0), *keys).alias("_series")).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > (most or ROWS_PER_BLOCK)).isEmpty()


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], block: Column, columns: dict[str, str], ahead: bool = False, placed: str | None = None
) -> DataFrame:
    """Add the value each column had in the previous (``ahead``: next) row of the series, as
    ``{new_name: source}``. The neighbour of a block's edge row is taken from the edge of the nearest
    non-empty block. ``placed`` names a column that keeps the block, for a ``block`` known to hold no more rows than a task
    should: nothing is counted then, and a later step by that column needs no further shuffle."""
    pick = F.min_by if ahead else F.max_by
    step = F.lead if ahead else F.lag
    values = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    if not placed and all_short(df, keys):
        out = df.withColumn("_neighbour", step(values).over(Window.partitionBy(*keys).orderBy(*order)))
        return out.withColumns({new: F.col("_neighbour").getField(new) for new in columns}).drop("_neighbour")
    cut = df.withColumn("_block", block.cast("bigint")) if placed else row_blocks(df, keys, order, block)
    edges = cut.groupBy(*keys, "_block").agg(pick(values, F.struct(*order)).alias("_edge"))
    along = Window.partitionBy(*keys).orderBy("_block")
    carried = edges.select(*keys, "_block", step("_edge").over(along).alias("_carry"))
    inside = Window.partitionBy("_block", *keys).orderBy(*order)
    out = cut.join(carried, on=[*keys, "_block"], how="left").withColumn(
        "_neighbour", F.coalesce(step(values).over(inside), F.col("_carry"))
    )
    added = {new: F.col("_neighbour").getField(new) for new in columns}
    out = out.withColumns(added).drop("_carry", "_neighbour")
    return out.withColumnRenamed("_block", placed) if placed else out.drop("_block")


def with_running(
    df: DataFrame, keys: list[str], order: list[str], block: Column, aggregates: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Running aggregates from the start of the series to each row, as ``{name: (kind, column)}`` with kind
    ``sum``, ``count``, ``max``, ``min`` or ``first`` (of a column without NULL, such as a struct): totals of earlier blocks combined
    with the running value inside."""
    if all_short(df, keys):
        inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: _AGGREGATE[k](c).over(inside) for n, (k, c) in aggregates.items()})
    cut = row_blocks(df, keys, order, block)
    total = lambda k, c: F.min_by(c, F.struct(*order)) if k == "first" else _AGGREGATE[k](c)
    totals = cut.groupBy(*keys, "_block").agg(*[total(k, c).alias(f"_t_{n}") for n, (k, c) in aggregates.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_block", *[_OVER_BLOCKS[k](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (k, _) in aggregates.items()]
    )
    inside = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(before, on=[*keys, "_block"], how="left")
    added = {n: _COMBINE[k](F.col(f"_b_{n}"), _AGGREGATE[k](c).over(inside)) for n, (k, c) in aggregates.items()}
    return out.withColumns(added).drop("_block", *[f"_b_{n}" for n in aggregates])


def with_position(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "position") -> DataFrame:
    """1-based position of each row in its series; ``order`` must be unique within the series."""
    out = with_running(df, keys, order, block, {name: ("count", F.lit(1))})
    return out.withColumn(name, F.col(name).cast("bigint"))


def counts_before(points: DataFrame, queries: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """``(id_, n)``: for every query ``(keys, id_, upto, value)`` the number of ``points(keys, position, value)`` of its key
    with ``position < upto`` and a smaller value, summed over the queries of an id.

    Positions count from 0. The first ``upto`` positions are a handful of aligned stretches of 2^k positions; within each
    stretch the count is a running one along the values. Every point is in a stretch of each size, so the
    work is rows times the logarithm of their number and no pair of point and query is built."""
    top = points.agg(F.max("position")).first()[0]
    levels = max(1, ((top or 0) + 1).bit_length())
    each = lambda df: df.withColumn("_k", F.explode(F.array(*(F.lit(k) for k in range(levels)))))
    node = lambda c: F.expr(f"shiftright({c}, _k)")
    p = each(points).where(node("position") % 2 == 0).select(*keys, "_k", node("position").alias("_node"), "value", F.lit(1).alias("_side"), "position", F.lit(None).cast(queries.schema[id_].dataType).alias(id_))
    q = each(queries).where(node("upto") % 2 == 1).select(*keys, "_k", (node("upto") - 1).alias("_node"), "value", F.lit(0).alias("_side"), F.lit(-1).cast("bigint").alias("position"), id_)
    rows = p.unionByName(q)
    seen = with_running(rows, [*keys, "_k", "_node"], ["value", "_side", "position", id_], F.lit(0), {"_n": ("sum", F.col("_side"))})
    return seen.where("_side = 0").groupBy(id_).agg(F.sum("_n").cast("bigint").alias("n"))


def range_maxima(values: DataFrame, ranges: DataFrame, keys: list[str], id_: list[str]) -> DataFrame:
    """``id_, most``: the largest ``value`` of the places ``low`` to ``high`` of each range's key (no row for an empty range).

    ``values(keys, place, value)`` has places 1, 2, ... without gaps; ``ranges(id_, keys, low, high)``. A table of the maxima
    of 2^k places from every place on is doubled up to the longest range; two overlapping entries give any range, so ranges
    are looked up and never expanded."""
    asked = cut_lineage(ranges.where("low <= high").withColumn("_k", F.floor(F.log2(F.col("high") - F.col("low") + 1)).cast("int")), "asked-ranges")
    top = asked.agg(F.max("_k")).first()[0]
    level = values.select(*keys, "place", "value")
    tables = level.withColumn("_k", F.lit(0))
    for k in range(1, (top or 0) + 1):
        ahead = level.select(*keys, (F.col("place") - (1 << (k - 1))).alias("place"), F.col("value").alias("_ahead"))
        level = cut_lineage(level.join(ahead, on=[*keys, "place"]).select(*keys, "place", F.greatest("value", "_ahead").alias("value")), f"maxima-{k}")
        tables = tables.unionByName(level.withColumn("_k", F.lit(k)))
    ends = F.explode(F.array(F.col("low"), F.expr("high - shiftleft(1L, _k) + 1"))).alias("place")
    return asked.select(*id_, *[k for k in keys if k not in id_], "_k", ends).join(tables, on=[*keys, "_k", "place"]).groupBy(*id_).agg(F.max("value").alias("most"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, percents: list[int], accuracy: int = 10_000, most: int = ROWS_PER_BLOCK) -> DataFrame:
    """Exact percentiles with linear interpolation for groups of any size: ``keys, percent, n, value``.

    The built-in exact percentile keeps a group's distinct values in one task. Here a mergeable sketch gives a narrow
    bracket around each percentile, rows are counted per bracket, and only brackets that hold a wanted rank go on. One with
    more than ``most`` rows of different values is narrowed again, in as many rounds as it takes; what is left is ordered.
    The counts are exact, so a poor sketch costs a round, not correctness. ``df`` is read three times; store it first
    if it is expensive."""
    rows = df.select(*keys, value).where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    rank = (F.col("n") - 1) * F.col("percent") / F.lit(100.0)
    wanted = counts.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    wanted = wanted.withColumns({"_lo": F.floor(rank), "_hi": F.ceil(rank), "_frac": rank - F.floor(rank)})
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array("_lo", "_hi")))).withColumns({"_path": F.array().cast("array<bigint>"), "_local": F.col("_rank")})
    around = sorted({min(max(p / 100.0 + d / accuracy, 0.0), 1.0) for p in percents for d in (-2.0, 2.0)})
    rows, wanted = _narrow(rows.withColumn("_path", F.array().cast("array<bigint>")), wanted, keys, value, around, accuracy)
    found = None
    while True:
        large = (F.col("_in_bin") > most) & (F.element_at("_path", -1) % 2 == 0)
        part = _ranked(rows, wanted.where(~large), keys, value)
        found = part if found is None else found.unionByName(part)
        wanted = wanted.where(large)
        if wanted.isEmpty():
            break
        rows, wanted = _narrow(rows, wanted, keys, value, [i / FAN_OUT for i in range(1, FAN_OUT)], accuracy)
    low = F.max(F.when(F.col("_rank") == F.col("_lo"), F.col("_value")))
    high = F.max(F.when(F.col("_rank") == F.col("_hi"), F.col("_value")))
    found = found.groupBy(*keys, "percent", "n", "_frac").agg(low.alias("_low"), high.alias("_high"))
    return found.select(*keys, "percent", "n", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac")).alias("value"))


def _narrow(rows: DataFrame, wanted: DataFrame, keys: list[str], value: str, quantiles: list[float], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """One round: every bracket (``keys, _path``) that holds a wanted rank is cut at its quantiles; values equal to a cut
    are a bracket of their own, with an odd number. Gives the rows and ranks of the brackets that are still wanted."""
    on = [*keys, "_path"]
    rows = rows.join(wanted.select(*on).distinct(), on=on, how="left_semi")
    edges = rows.groupBy(*on).agg(F.array_distinct(F.percentile_approx(value, quantiles, accuracy)).alias("_edges"))
    bin_ = 2 * F.size(F.filter("_edges", lambda e: e < F.col(value))) + F.array_contains("_edges", F.col(value)).cast("int")
    placed = cut_lineage(rows.join(edges, on=on).select(*on, value, bin_.cast("bigint").alias("_bin")), "brackets")
    counts = placed.groupBy(*on, "_bin").agg(F.count(F.lit(1)).alias("_in_bin"))
    counts = counts.withColumn("_upto", F.sum("_in_bin").over(Window.partitionBy(*on).orderBy("_bin")))  # a few rows per bracket
    inside = (F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_in_bin"))
    ahead = wanted.drop("_in_bin").join(counts, on=on).where(inside).withColumn("_local", F.col("_local") - (F.col("_upto") - F.col("_in_bin")))
    ahead = cut_lineage(ahead.withColumn("_path", F.concat("_path", F.array("_bin"))).drop("_bin", "_upto"), "wanted-ranks")
    return placed.select(*keys, F.concat("_path", F.array("_bin")).alias("_path"), value), ahead


def _ranked(rows: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The values at the wanted ranks of brackets small enough to be ordered; equal values are counted first."""
    on = [*keys, "_path"]
    needed = rows.join(wanted.select(*on).distinct(), on=on, how="left_semi").groupBy(*on, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = needed.withColumn("_end", F.sum("_n").over(Window.partitionBy(*on).orderBy("_value")))
    return wanted.join(ordered, on=on).where((F.col("_local") < F.col("_end")) & (F.col("_local") >= F.col("_end") - F.col("_n"))).select(*keys, "percent", "n", "_frac", "_lo", "_hi", "_rank", "_value")
