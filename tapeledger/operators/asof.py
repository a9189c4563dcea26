"""As-of join: the last quote at or before an event, if it is recent enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.functions.timegrid import HOUR_US, MINUTE_US, epoch_us, time_block
from tapeledger.operators.ordered import row_blocks

PRICE_TOLERANCE_US = 2 * MINUTE_US


def asof_price(
    events: DataFrame, quotes: DataFrame, keys: list[str] = ["symbol"], time: str = "timestamp", price: str = "oracle_px",
    tolerance_us: int = PRICE_TOLERANCE_US, sequence: str | None = None, block_us: int = HOUR_US,
) -> DataFrame:
    """Add ``oracle_price`` and ``quote_time`` of the last quote with quote time <= event time and a gap of at
    most ``tolerance_us``; otherwise NULL. Where several quotes carry one time, the first counts for an event at
    that very time and the last for later events (``sequence`` tells them apart).

    Both sides are laid on one time line per key, cut into blocks of time and, where many rows fall into one, of rows.
    A window never holds more than one block; the last quote before a block is handed on as one row per
    block. Nothing is paired, each side is read and shuffled once."""
    order = F.col(sequence) if sequence else F.lit(0)
    instants = quotes.groupBy(*keys, F.col(time).alias("_qt")).agg(
        F.min_by(price, order).alias("_first_px"), F.max_by(price, order).alias("_last_px")
    )
    quote = F.struct("_qt", "_first_px", "_last_px")
    quote_type, event_type = instants.select(quote.alias("q")).schema["q"].dataType, _struct_of(events)
    rows = instants.select(*keys, F.col("_qt").alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), quote.alias("_q"), F.lit(None).cast(event_type).alias("_event")).unionByName(
        events.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.xxhash64(*[c for c, t in events.dtypes if "map<" not in t]).alias("_tie"), F.lit(None).cast(quote_type).alias("_q"), F.struct(*events.columns).alias("_event")))
    rows = row_blocks(rows, keys, ["_at", "_side", "_tie"], time_block("_at", block_us))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_block").agg(F.max("_q").alias("_q")).select(*keys, "_block", F.last("_q", ignorenulls=True).over(earlier).alias("_carry"))
    seen = Window.partitionBy(*keys, "_block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, on=[*keys, "_block"], how="left").withColumn("_q", F.coalesce(F.last("_q", ignorenulls=True).over(seen), F.col("_carry"))).where(F.col("_side") == 1)
    near = epoch_us("_at") - epoch_us(F.col("_q._qt")) <= tolerance_us
    px = F.when(F.col("_q._qt") == F.col("_at"), F.col("_q._first_px")).otherwise(F.col("_q._last_px"))
    return rows.select("_event.*", F.when(near, px).alias("oracle_price"), F.when(near, F.col("_q._qt")).alias("quote_time"))


def _struct_of(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def incremental_asof(
    events: DataFrame, quotes: DataFrame, carry: DataFrame | None, keys: list[str] = ["symbol"], tolerance_us: int = PRICE_TOLERANCE_US,
    sequence: str | None = None, lateness_us: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One increment of the join: ``(priced events, new carry, late events)``.

    The mark of a key is the time of the newest quote of the increments before. An event may come up to ``lateness_us``
    behind the mark. ``carry`` holds the quotes (keys, timestamp, oracle_px) that such an event can still need: those
    no older than lateness and tolerance together, and the newest. So increments in any order within the lateness give
    what one run over all of them gives. Events further behind come out as late, without a price that could be wrong."""
    columns = [*keys, "timestamp", "oracle_px"] + ([sequence] if sequence else [])
    known, late = quotes.select(*columns), events.limit(0)
    if carry is not None:
        marks = carry.groupBy(*keys).agg(F.max("timestamp").alias("_mark"))
        behind = F.coalesce(epoch_us("_mark") - epoch_us("timestamp") > lateness_us, F.lit(False))
        placed = events.join(marks, on=keys, how="left").withColumn("_late", behind)
        late, events = (placed.where(c).select(*events.columns) for c in ("_late", "not _late"))
        known = known.unionByName(carry.select(*columns))
    priced = asof_price(events, known, keys=keys, tolerance_us=tolerance_us, sequence=sequence)
    newest = known.groupBy(*keys).agg(F.max("timestamp").alias("_mark"))
    kept = known.join(newest, on=keys).where(epoch_us("_mark") - epoch_us("timestamp") <= lateness_us + tolerance_us)
    return priced, kept.select(*columns), late


def new_dates(requested: DataFrame, high_water_mark: str | None) -> DataFrame:
    """Dates after the mark. Earlier ones are a no-op, also when they were never processed."""
    return requested if high_water_mark is None else requested.where(F.col("date") > F.lit(high_water_mark).cast("date"))


def alignment_counts(events: DataFrame, prices: DataFrame, keys: list[str] = ["symbol", "timestamp"]) -> DataFrame:
    """How many events have a price in the extracted table."""
    joined = events.select(*keys).join(prices.select(*keys, "oracle_price"), on=keys, how="left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_events"), F.count("oracle_price").alias("n_priced"),
        (F.count(F.lit(1)) - F.count("oracle_price")).alias("n_unpriced"),
    )
