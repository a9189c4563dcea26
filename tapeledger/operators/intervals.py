"""Gaps, islands, coverage, containment and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.functions.timegrid import DAY_US, HOUR_US, MINUTE_US, epoch_us, from_epoch_us, time_block
from tapeledger.operators.ordered import range_maxima, with_previous, with_running
from tapeledger.session import cut_lineage

MAX_FUNDING_GAP_US = 90 * MINUTE_US


def _gap_buckets(events: DataFrame, keys: list[str], time: str, max_gap_us: int) -> DataFrame:
    """First and last event per ``max_gap_us`` wide bucket. Events of one bucket can never be further apart than
    the limit, so islands and over-limit gaps depend on these edges alone: the map side reduces any number of
    events to one row per key and bucket before the shuffle."""
    us = epoch_us(time)
    return (
        events.where(F.col(time).isNotNull())
        .groupBy(*keys, time_block(time, max_gap_us).alias("_bucket"))
        .agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.count(F.lit(1)).alias("_n"))
    )


def coverage_islands(events: DataFrame, keys: list[str] = ["symbol"], time: str = "timestamp", max_gap_us: int = MAX_FUNDING_GAP_US) -> DataFrame:
    """Closed intervals covered by events; a new interval starts where the gap exceeds ``max_gap_us``."""
    along = Window.partitionBy(*keys).orderBy("_bucket")
    edges = _gap_buckets(events, keys, time, max_gap_us)
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(along) > max_gap_us, F.lit(True))
    edges = edges.withColumn("_opens", opens.cast("int"))
    edges = edges.withColumn("_island", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        edges.groupBy(*keys, "_island")
        .agg(F.min("_first").alias("_s"), F.max("_last").alias("_e"), F.sum("_n").cast("bigint").alias("n_events"))
        .select(*keys, from_epoch_us(F.col("_s")).alias("coverage_start"), from_epoch_us(F.col("_e")).alias("coverage_end"), "n_events")
    )


def gaps_over(events: DataFrame, keys: list[str] = ["symbol"], time: str = "timestamp", max_gap_us: int = MAX_FUNDING_GAP_US) -> DataFrame:
    """Every spacing between neighbouring events that exceeds the limit: keys, timestamp (later event), gap_us."""
    along = Window.partitionBy(*keys).orderBy("_bucket")
    edges = _gap_buckets(events, keys, time, max_gap_us).withColumn("gap_us", F.col("_first") - F.lag("_last").over(along))
    return edges.where(F.col("gap_us") > max_gap_us).select(*keys, from_epoch_us(F.col("_first")).alias(time), "gap_us")


def overlapping_records(coverage: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Coverage records that touch or overlap the record before them in start order."""
    along = Window.partitionBy(*keys).orderBy("coverage_start", "coverage_end")
    before = coverage.withColumn("_previous_end", F.lag("coverage_end").over(along))
    return before.where(F.col("coverage_start") <= F.col("_previous_end")).drop("_previous_end")


def _spread(intervals: DataFrame, start: str, end: str, width_us: int) -> DataFrame:
    """One row per block an interval touches, so interval joins become equality joins on the block."""
    return intervals.withColumn("_block", F.explode(F.sequence(time_block(start, width_us), time_block(end, width_us))))


def outside_intervals(
    events: DataFrame, intervals: DataFrame, keys: list[str] = ["symbol"], time: str = "timestamp",
    start: str = "coverage_start", end: str = "coverage_end", width_us: int = DAY_US,
) -> DataFrame:
    """Events that lie in none of the closed intervals of their key."""
    spread = _spread(intervals.select(*keys, start, end), start, end, width_us)
    placed = events.withColumn("_block", time_block(time, width_us))
    same = [placed[k] == spread[k] for k in [*keys, "_block"]]
    inside = (placed[time] >= spread[start]) & (placed[time] <= spread[end])
    return placed.join(spread, on=[*same, inside], how="left_anti").drop("_block")


def containing_interval(
    rows: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, carry: list[str], row_id: list[str],
    width_us: int = DAY_US,
) -> DataFrame:
    """Left join of each row to the closed intervals that contain it, with the number of hits per row
    (0, 1 or more). ``carry`` columns come from the first hit in start order."""
    spread = _spread(intervals.select(*keys, start, end, *carry), start, end, width_us)
    placed = rows.withColumn("_block", time_block(time, width_us)).alias("r")
    spread = spread.alias("i")
    same = [F.col(f"r.{k}") == F.col(f"i.{k}") for k in [*keys, "_block"]]
    inside = (F.col(f"r.{time}") >= F.col(f"i.{start}")) & (F.col(f"r.{time}") <= F.col(f"i.{end}"))
    hit = F.struct(*[F.col(f"i.{c}") for c in [start, end, *carry]])
    joined = placed.join(spread, on=[*same, inside], how="left").select(
        *[F.col(f"r.{c}").alias(c) for c in rows.columns], F.when(F.col(f"i.{start}").isNotNull(), hit).alias("_hit")
    )
    rest = [c for c in rows.columns if c not in row_id]
    out = joined.groupBy(*row_id).agg(*[F.first(c).alias(c) for c in rest], F.count("_hit").alias("n_hits"), F.min("_hit").alias("_hit"))
    return out.select(*rows.columns, "n_hits", *[F.col("_hit").getField(c).alias(f"interval_{c}") for c in [start, end, *carry]])


def overlap_join(
    left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, width_us: int = 30 * DAY_US,
    on: list[str] | None = None,
) -> DataFrame:
    """Pairs of closed intervals that intersect, each pair once: both sides are spread over time blocks, joined
    on the block, and a pair is kept only in the first block the two share."""
    keys = on or []
    a = _spread(left, left_start, left_end, width_us).alias("a")
    b = _spread(right, right_start, right_end, width_us).alias("b")
    first_shared = F.greatest(time_block(F.col(f"a.{left_start}"), width_us), time_block(F.col(f"b.{right_start}"), width_us))
    touch = (F.col(f"a.{left_start}") <= F.col(f"b.{right_end}")) & (F.col(f"a.{left_end}") >= F.col(f"b.{right_start}"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ["_block", *keys]]
    joined = a.join(b, on=[*same, touch, F.col("a._block") == first_shared], how="inner")
    return joined.select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c not in keys])


def single_cover(periods: DataFrame, coverage: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Number of coverage records that hold a whole period ``[period_start, period_end]`` each."""
    spread = _spread(coverage.select(*keys, "coverage_start", "coverage_end"), "coverage_start", "coverage_end", DAY_US).alias("c")
    placed = periods.withColumn("_block", time_block("period_start", DAY_US)).alias("p")
    same = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in [*keys, "_block"]]
    holds = (F.col("c.coverage_start") <= F.col("p.period_start")) & (F.col("p.period_end") <= F.col("c.coverage_end"))
    joined = placed.join(spread, on=[*same, holds], how="left")
    out = joined.groupBy(*[F.col(f"p.{c}") for c in periods.columns]).agg(F.count("c.coverage_start").alias("n_records"))
    return out


def event_spacings(events: DataFrame, keys: list[str] = ["symbol"], time: str = "timestamp", tie: str | None = None, block_us: int = HOUR_US) -> DataFrame:
    """Spacing of each event from the one before it (NULL for the first)."""
    order = [time] if tie is None else [time, tie]
    out = with_previous(events, keys, order, time_block(time, block_us), {"_before": time})
    return out.withColumn("gap_us", epoch_us(time) - epoch_us(F.col("_before"))).drop("_before")


def coverage_checks(events: DataFrame, coverage: DataFrame, keys: list[str] = ["symbol"], max_gap_us: int = MAX_FUNDING_GAP_US, tie: str | None = None) -> DataFrame:
    """Per coverage record: widest gap including both ends, the most frequent spacing of its events (smallest on
    ties), whether the limit holds, and whether the limit looks far too wide (usual spacing below half of it)."""
    carried = containing_records(events, coverage, keys)
    spaced = event_spacings(carried, [*keys, "coverage_start", "coverage_end"], tie=tie)
    record = [*keys, "coverage_start", "coverage_end"]
    by_gap = spaced.groupBy(*record, "gap_us").agg(
        F.count(F.lit(1)).alias("_n"), F.min(epoch_us("timestamp")).alias("_first"), F.max(epoch_us("timestamp")).alias("_last")
    )
    best = F.max_by("gap_us", F.when(F.col("gap_us").isNotNull(), F.struct("_n", -F.col("gap_us"))))
    per = by_gap.groupBy(*record).agg(
        F.sum("_n").cast("bigint").alias("n_events"), F.max("gap_us").alias("_inner"), best.alias("modal_gap_us"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"),
    )
    joined = coverage.select(*record).join(per, on=record, how="left")
    edges = F.greatest(
        F.coalesce(F.col("_inner"), F.lit(0)),
        F.coalesce(F.col("_first") - epoch_us("coverage_start"), epoch_us("coverage_end") - epoch_us("coverage_start")),
        F.coalesce(epoch_us("coverage_end") - F.col("_last"), F.lit(0)),
    )
    return joined.select(
        *record, F.coalesce("n_events", F.lit(0)).alias("n_events"), edges.alias("max_gap_us"), "modal_gap_us",
        (edges > max_gap_us).alias("gap_exceeded"),
        F.coalesce(F.col("modal_gap_us") < max_gap_us / 2, F.lit(False)).alias("tolerance_suspicious"),
    )


def containing_records(events: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of events to the coverage records that contain them, on (key, day) blocks."""
    spread = _spread(coverage.select(*keys, "coverage_start", "coverage_end"), "coverage_start", "coverage_end", DAY_US)
    placed = events.withColumn("_block", time_block("timestamp", DAY_US))
    joined = placed.join(spread, on=[*keys, "_block"], how="inner")
    return joined.where(F.col("timestamp").between(F.col("coverage_start"), F.col("coverage_end"))).drop("_block")


def stretch_gaps(events: DataFrame, stretches: DataFrame, id_: list[str], keys: list[str] = ["symbol"], width_us: int = HOUR_US, tie: str | None = None) -> DataFrame:
    """``id_, max_gap_us``: the widest spacing of neighbouring events that touches a stretch ``[stretch_start, stretch_end)``
    on the grid; NULL if no spacing does. ``stretches`` has ``id_`` (unique) and the keys.

    Periods of the grid keep the widest spacing before or after one of their events. A stretch asks for the maximum over the
    periods it spans (``range_maxima``), and, if none of its periods has an event, for the spacing it lies in."""
    spaced = event_spacings(events, keys, tie=tie)
    spaced = with_previous(spaced, keys, ["timestamp"] + ([tie] if tie else []), time_block("timestamp", HOUR_US), {"_after": "gap_us"}, ahead=True)
    period = time_block("timestamp", width_us)
    per = spaced.groupBy(*keys, period.alias("_period")).agg(F.max(F.greatest("gap_us", "_after")).alias("value"), F.max_by("_after", F.struct(epoch_us("timestamp"), *([tie] if tie else []))).alias("_tail"))
    per = cut_lineage(per.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_period"))), "gap-periods")
    first, last = time_block("stretch_start", width_us), F.floor((epoch_us("stretch_end") - 1) / F.lit(width_us)).cast("bigint")
    asked = cut_lineage(stretches.select(*id_, *[k for k in keys if k not in id_], F.explode(F.array(F.struct(F.lit(0).alias("end"), (first - 1).alias("at")), F.struct(F.lit(1).alias("end"), last.alias("at")))).alias("_e")).select("*", "_e.*").drop("_e"), "asked-stretches")
    # how many periods with events lie at or before each end of a stretch
    rows = per.select(*keys, F.col("_period").alias("at"), F.lit(0).alias("_side"), F.lit(1).alias("_one"), *[F.lit(None).cast(dict(asked.dtypes)[c]).alias(c) for c in [*[i for i in id_ if i not in keys], "end"]])
    points = asked.select(*keys, "at", F.lit(1).alias("_side"), F.lit(0).alias("_one"), *[c for c in id_ if c not in keys], "end")
    counted = with_running(rows.unionByName(points), keys, ["at", "_side", *[c for c in id_ if c not in keys], "end"], F.lit(0), {"_n": ("sum", F.col("_one"))}).where("_side = 1")
    ranks = counted.groupBy(*id_, *[k for k in keys if k not in id_]).agg((F.max(F.when(F.col("end") == 0, F.col("_n"))) + 1).alias("low"), F.max(F.when(F.col("end") == 1, F.col("_n"))).alias("high"))
    ranks = cut_lineage(ranks, "stretch-ranks")
    within = range_maxima(per.select(*keys, "place", "value"), ranks, keys, id_)
    around = ranks.where("low > high").withColumn("place", F.col("low") - 1).join(per.select(*keys, "place", "_tail"), on=[*keys, "place"]).select(*id_, F.col("_tail").alias("most"))
    return stretches.select(*id_).join(within.unionByName(around), on=id_, how="left").withColumnRenamed("most", "max_gap_us")


def covered_periods(coverage: DataFrame, stretches: DataFrame, id_: list[str], keys: list[str] = ["symbol"], width_us: int = HOUR_US) -> DataFrame:
    """``id_, n_periods, n_covered``: periods of the grid in each stretch ``[stretch_start, stretch_end)``, and those that a
    single coverage record holds whole.

    A record holds a run of whole periods; overlapping runs are merged, and the number of covered periods up to a place is
    a running sum along them. A stretch is the difference of two places: neither records nor stretches are expanded."""
    ends = lambda c: epoch_us(c) / F.lit(width_us)
    runs = coverage.select(*keys, F.ceil(ends("coverage_start")).alias("_a"), (F.floor(ends("coverage_end")) - 1).alias("_b")).where("_a <= _b")
    before = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    opened = runs.withColumn("_new", F.coalesce(F.col("_a") > F.max("_b").over(before), F.lit(True)).cast("int"))
    opened = opened.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, 0)))
    runs = opened.groupBy(*keys, "_island").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    first, last = time_block("stretch_start", width_us), F.floor((epoch_us("stretch_end") - 1) / F.lit(width_us)).cast("bigint")
    others = [c for c in id_ if c not in keys]
    none = [F.lit(None).cast(dict(stretches.dtypes)[c]).alias(c) for c in others]
    # a run adds (x - a + 1) from its start on, and that stops growing at its end
    marks = runs.select(*keys, F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(1).alias("open"), (1 - F.col("_a")).alias("base")), F.struct((F.col("_b") + 1).alias("at"), F.lit(-1).alias("open"), F.col("_b").alias("base")))).alias("m"))
    marks = marks.select(*keys, "m.at", F.lit(0).alias("_side"), "m.open", "m.base", *none, F.lit(0).alias("sign"))
    points = stretches.select(*keys, *others, F.explode(F.array(F.struct((first - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(last.alias("at"), F.lit(1).alias("sign")))).alias("p"))
    points = points.select(*keys, "p.at", F.lit(1).alias("_side"), F.lit(0).alias("open"), F.lit(0).cast("bigint").alias("base"), *others, "p.sign")
    seen = with_running(marks.unionByName(points), keys, ["at", "_side", "open", "base", *others, "sign"], F.lit(0), {"_open": ("sum", F.col("open")), "_base": ("sum", F.col("base"))}).where("_side = 1")
    upto = F.col("_base") + F.col("_open") * F.col("at")
    sums = seen.groupBy(*id_).agg(F.sum(F.col("sign") * upto).cast("bigint").alias("n_covered"))
    return stretches.select(*id_, (last - first + 1).alias("n_periods")).join(sums, on=id_, how="left")


# --- bars: keys are unique on the grid, so a series has at most span/width rows ----------------------------


def source_segments(bars: DataFrame, keys: list[str] = ["symbol"], labels: list[str] = ["source_venue", "native_or_proxy", "source_type", "dataset_id"]) -> DataFrame:
    """Runs of consecutive bars with the same source labels."""
    along = Window.partitionBy(*keys).orderBy("timestamp")
    label = F.struct(*labels)
    changed = F.coalesce(~label.eqNullSafe(F.lag(label).over(along)), F.lit(True)).cast("int")
    marked = bars.withColumn("_changed", changed)
    marked = marked.withColumn("segment", F.sum("_changed").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, F.col("segment").cast("bigint").alias("segment"), *labels).agg(
        F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"), F.count(F.lit(1)).alias("n_bars")
    )


def segments_disagreeing(bars: DataFrame, segments: DataFrame, labels: list[str], keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars that lie in no segment, in several, or in one whose labels differ from their own."""
    held = containing_interval(bars, segments.select(*keys, "start_timestamp", "end_timestamp", *labels), keys, "timestamp",
                               "start_timestamp", "end_timestamp", labels, [*keys, "timestamp"])
    same = F.struct(*labels).eqNullSafe(F.struct(*[F.col(f"interval_{c}").alias(c) for c in labels]))
    code = F.when(F.col("n_hits") == 0, "NOT_COVERED").when(F.col("n_hits") > 1, "COVERED_TWICE").when(~same, "LABELS_DIFFER")
    return held.withColumn("code", code).where(F.col("code").isNotNull()).select(*keys, "timestamp", "code")


def _on_grid(rows: DataFrame, keep: list[str], first_us: Column, last_us: Column, width_us: int) -> DataFrame:
    """Each row once per grid time from first to last, both included."""
    steps = rows.select(*keep, F.explode(F.sequence(first_us, last_us, F.lit(width_us))).alias("_us"))
    return steps.select(*keep, from_epoch_us(F.col("_us")).alias("timestamp"))


def grid_bounds(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("timestamp").alias("first_bar"), F.max("timestamp").alias("last_bar"))


def expected_grid(bounds: DataFrame, width_us: int) -> DataFrame:
    """Every grid time between the bounds; its length is span/width, whatever the number of bars."""
    return _on_grid(bounds.where("first_bar is not null"), [], epoch_us("first_bar"), epoch_us("last_bar"), width_us)


def grid_gaps(bars: DataFrame, width_us: int = HOUR_US) -> DataFrame:
    """Grid times at which no symbol at all has a bar."""
    present = bars.select("timestamp").distinct()
    return expected_grid(grid_bounds(bars), width_us).join(present, on="timestamp", how="left_anti")


def first_grid_gap(bars: DataFrame, width_us: int = HOUR_US) -> DataFrame:
    """The first missing grid time and the last bar before it; no row when the grid is whole."""
    missing = grid_gaps(bars, width_us).agg(F.min("timestamp").alias("first_missing"))
    before = bars.where(F.col("timestamp") < missing.select("first_missing").scalar()).agg(F.max("timestamp").alias("previous_bar"))
    return missing.withColumn("previous_bar", before.scalar()).where("first_missing is not null")


def missing_hours(available: DataFrame, start: Column, end: Column, width_us: int = HOUR_US) -> DataFrame:
    """Hours of ``[start, end)`` that are absent from ``available.timestamp``."""
    wanted = _on_grid(available.sparkSession.range(1), [], epoch_us(start), epoch_us(end) - F.lit(width_us), width_us)
    return wanted.join(available.select("timestamp"), on="timestamp", how="left_anti")


def grid_segments(bars: DataFrame, width_us: int = HOUR_US) -> DataFrame:
    """Maximal gap-free stretches of the market-wide grid (union of all symbols)."""
    present = bars.select("timestamp").distinct().withColumn("_all", F.lit(1))
    islands = coverage_islands(present, ["_all"], "timestamp", width_us)
    return islands.select(
        F.col("coverage_start").alias("segment_start"), F.col("coverage_end").alias("segment_end"), F.col("n_events").alias("n_bars")
    )


def reindex_with_null(bars: DataFrame, values: list[str], width_us: int = HOUR_US) -> DataFrame:
    """All symbols on the full grid, NULL where a symbol has no bar. Nothing is ever filled forward."""
    bounds = grid_bounds(bars)
    low, high = epoch_us(bounds.select("first_bar").scalar()), epoch_us(bounds.select("last_bar").scalar())
    grid = _on_grid(bars.select("symbol").distinct(), ["symbol"], low, high, width_us)
    return grid.join(bars.select("symbol", "timestamp", *values), on=["symbol", "timestamp"], how="left")


def pivot_wide(bars: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    """One column for each of the given symbols."""
    return bars.groupBy("timestamp").pivot("symbol", symbols).agg(F.first(value))


def splice(first: DataFrame, second: DataFrame, seam: Column, opt_in: bool = False, keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars of one source before the seam and of another from it on; the first bar after it is marked.
    Splicing is off unless asked for."""
    if not opt_in:
        raise ValueError("splicing two sources must be asked for with opt_in=True")
    after = second.where(F.col("timestamp") >= seam)
    heads = after.groupBy(*keys).agg(F.min("timestamp").alias("timestamp")).withColumn("seam_bar", F.lit(True))
    after = after.join(heads, on=[*keys, "timestamp"], how="left").withColumn("seam_bar", F.coalesce("seam_bar", F.lit(False)))
    return first.where(F.col("timestamp") < seam).withColumn("seam_bar", F.lit(False)).unionByName(after)


def splice_findings(first: DataFrame, second: DataFrame, seam: Column, keys: list[str] = ["symbol"]) -> DataFrame:
    """Rows that break the splice rule: the first source must end before the seam, the second start at or after it."""
    late = first.where(F.col("timestamp") >= seam).select(*keys, "timestamp", F.lit("FIRST_REACHES_SEAM").alias("code"))
    early = second.where(F.col("timestamp") < seam).select(*keys, "timestamp", F.lit("SECOND_STARTS_EARLY").alias("code"))
    return late.unionByName(early)


def key_set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found on one side only; no rows means the two key sets are equal."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, on=keys, how="full_outer")
    side = F.when(F.col("_b").isNull(), "LEFT_ONLY").when(F.col("_a").isNull(), "RIGHT_ONLY")
    return both.withColumn("side", side).where(F.col("side").isNotNull()).select(*keys, "side")
