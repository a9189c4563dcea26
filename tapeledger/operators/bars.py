"""Bars: ticks to bars, roll-ups with a completeness rule, listing ranges, quarantine and universe membership.

Every aggregate here combines on the map side, so a symbol that holds a third of all ticks costs each reducer
one row per map task and bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.timegrid import FREQUENCY_US, HOUR_US, bucket_start, epoch_us, moment

BAR_VALUES = ["open", "high", "low", "close", "volume", "trade_count", "native_traded"]
BAR_COLUMNS = ["timestamp", "symbol", *BAR_VALUES, "source_venue", "native_or_proxy", "source_type", "dataset_id"]


def native_traded(volume: Column, trade_count: Column) -> Column:
    """A bar is a placeholder only when it has neither volume nor trades."""
    return ~((volume == 0) & (trade_count == 0))


def ticks_to_bars(
    ticks: DataFrame, width_us: int = HOUR_US, keys: tuple[str, ...] = ("symbol",), price: str = "px", size: str = "sz",
    time: str = "timestamp", trade_id: str = "trade_id",
) -> DataFrame:
    """Left-labelled OHLCV bars. Ticks of equal time are ordered by trade id, so open and close are well defined."""
    slim = ticks.select(*keys, price, size, bucket_start(time, width_us).alias("_bar"), moment(ticks, time, trade_id).alias("_at"))
    bars = slim.groupBy(*keys, "_bar").agg(
        F.min_by(price, "_at").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "_at").alias("close"),
        F.sum(size).alias("volume"),
        F.count(size).alias("trade_count"),
    )
    return bars.withColumnRenamed("_bar", "timestamp").withColumn("native_traded", native_traded(F.col("volume"), F.col("trade_count")))


def roll_up(
    bars: DataFrame, to_us: int, from_us: int = HOUR_US, keys: tuple[str, ...] = ("symbol",), start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Coarser bars from finer ones. A bucket is kept only when every one of its bars is present and, if a
    window is given, when the whole bucket lies inside ``[start, end)``. Presence is kept in bit masks of 62 slots
    each, so repeated rows cannot stand in for a missing slot."""
    slots = to_us // from_us
    if slots * from_us != to_us:
        raise ValueError("the target width must be a whole multiple of the source width")
    lanes = [min(62, slots - first) for first in range(0, slots, 62)]
    offset = F.pmod(epoch_us("timestamp"), F.lit(to_us))
    placed = bars.withColumns({"_bucket": bucket_start("timestamp", to_us), "_slot": (offset / from_us).cast("int")})
    placed = placed.where(F.pmod(epoch_us("timestamp"), F.lit(from_us)) == 0)
    rolled = placed.groupBy(*keys, "_bucket").agg(
        F.min_by("open", "timestamp").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "timestamp").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").cast("bigint").alias("trade_count"),
        F.bool_or("native_traded").alias("native_traded"),
        *(F.bit_or(F.expr(f"case when _slot div 62 = {i} then shiftleft(1L, _slot % 62) else 0L end")).alias(f"_seen{i}") for i in range(len(lanes))),
    )
    whole = reduce(lambda a, b: a & b, [F.col(f"_seen{i}") == F.lit((1 << n) - 1) for i, n in enumerate(lanes)])
    rolled = rolled.where(whole).drop(*(f"_seen{i}" for i in range(len(lanes)))).withColumnRenamed("_bucket", "timestamp")
    if start is not None:
        rolled = rolled.where(F.col("timestamp") >= start)
    if end is not None:
        rolled = rolled.where(epoch_us("timestamp") + F.lit(to_us) <= epoch_us(end))
    return rolled


def native_with_rolled_prefix(native: DataFrame, rolled: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Native coarse bars; rolled bars fill only the stretch before a symbol's native bars begin."""
    begins = native.groupBy(*keys).agg(F.min("timestamp").alias("_begins"))
    prefix = rolled.join(begins, on=list(keys), how="left").where(F.col("_begins").isNull() | (F.col("timestamp") < F.col("_begins")))
    return native.withColumn("is_aggregated", F.lit(False)).unionByName(
        prefix.drop("_begins").withColumn("is_aggregated", F.lit(True)), allowMissingColumns=True
    )


def listing_range(bars: DataFrame, delisted: DataFrame | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """First and last traded bar per symbol; the last one is only known as an end for delisted symbols."""
    traded = F.when(F.col("native_traded"), F.col("timestamp"))
    out = bars.groupBy(*keys).agg(F.min(traded).alias("first_native_bar"), F.max(traded).alias("_last"))
    if delisted is None:
        return out.withColumnRenamed("_last", "last_native_bar")
    marks = delisted.select(*keys, "is_delisted")
    out = out.join(marks, on=list(keys), how="left").withColumn("is_delisted", F.coalesce("is_delisted", F.lit(False)))
    return out.withColumn("last_native_bar", F.when(F.col("is_delisted"), F.col("_last"))).drop("_last")


def drop_leading_placeholders(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), cutoff: DataFrame | None = None) -> DataFrame:
    """Drop the untraded run before a symbol's first traded bar; later untraded bars stay, and a symbol that
    never traded is dropped whole. ``cutoff`` (keys, first_native_bar) may come from a coarser series."""
    first = cutoff if cutoff is not None else listing_range(bars, keys=keys)
    first = first.select(*keys, "first_native_bar")
    kept = bars.join(first, on=list(keys), how="inner").where(F.col("timestamp") >= F.col("first_native_bar"))
    return kept.drop("first_native_bar").select(*bars.columns)


def closed_bars(bars: DataFrame, now: Column, width_us: int = HOUR_US) -> DataFrame:
    """Bars whose full interval has passed at ``now``."""
    return bars.where(epoch_us("timestamp") + F.lit(width_us) <= epoch_us(now))


def fills_to_trades(fills: DataFrame, trade_id: str = "trade_id") -> tuple[DataFrame, DataFrame]:
    """A trade is reported once by each side. Returns (trades, findings): one row per trade id that has exactly
    two fills of equal size, and one finding for every other id."""
    rest = [c for c in fills.columns if c not in (trade_id, "side")]
    grouped = fills.groupBy(trade_id).agg(
        F.count(F.lit(1)).alias("n_fills"),
        F.min("sz").alias("_min_sz"),
        F.max("sz").alias("_max_sz"),
        F.min_by(F.struct(*rest), F.struct("side", *rest)).alias("_one"),
    )
    code = F.when(F.col("n_fills") != 2, "INCOMPLETE_PAIR").when(F.col("_min_sz") != F.col("_max_sz"), "UNEQUAL_SIZE")
    grouped = grouped.withColumn("code", code)
    trades = grouped.where(F.col("code").isNull()).select(trade_id, "_one.*")
    findings = grouped.where(F.col("code").isNotNull()).select(trade_id, "code", "n_fills")
    return trades, findings


def dedupe_by_key(df: DataFrame, key: list[str], values: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Collapse rows that repeat exactly; a key whose rows differ is a conflict and is reported, not merged.
    Returns (rows, conflicts). A transaction hash alone spans many trades and is refused as a key."""
    if list(key) == ["hash"]:
        raise ValueError("a transaction hash alone does not identify a trade; use a compound key")
    values = values if values is not None else [c for c in df.columns if c not in key]
    record = F.struct(*values)
    grouped = df.groupBy(*key).agg(
        F.min(record).alias("_low"), F.max(record).alias("_high"), F.count(F.lit(1)).alias("n_rows")
    )
    same = F.col("_low").eqNullSafe(F.col("_high"))
    return grouped.where(same).select(*key, "_low.*"), grouped.where(~same).select(*key, "n_rows")


def with_priority(preferred: DataFrame, filler: DataFrame, keys: list[str]) -> DataFrame:
    """All preferred rows, plus filler rows for keys the preferred side lacks."""
    return preferred.unionByName(filler.join(preferred.select(*keys), on=keys, how="left_anti"))


def members_as_of(universe: DataFrame, as_of: Column) -> DataFrame:
    """Symbols listed at ``as_of``; both ends of the listing range belong to it."""
    ended = F.when(F.col("is_delisted"), F.col("last_native_bar"))
    return universe.where((F.col("first_native_bar") <= as_of) & (ended.isNull() | (as_of <= ended)))


def classify_missing_windows(windows: DataFrame, universe: DataFrame) -> DataFrame:
    """Why a (symbol, window_start, window_end, beyond_retention) request came back empty."""
    dim = universe.select("symbol", "first_native_bar", "last_native_bar", "is_delisted")
    reason = (
        F.when(F.col("window_end") <= F.col("first_native_bar"), "NOT_YET_LISTED")
        .when(F.col("is_delisted") & (F.col("window_start") >= F.col("last_native_bar")), "DELISTED")
        .when(F.col("beyond_retention"), "BEYOND_RETENTION")
        .otherwise("VENUE_GAP")
    )
    return windows.join(dim, on="symbol", how="left").withColumn("classification", reason).select(*windows.columns, "classification")


def rename_candidates(universe: DataFrame, known_pairs: DataFrame) -> DataFrame:
    """Known (old_symbol, new_symbol) pairs that are both present while the old one is delisted. Advice only."""
    old = universe.where("is_delisted").select(F.col("symbol").alias("old_symbol"))
    new = universe.select(F.col("symbol").alias("new_symbol"))
    return known_pairs.join(old, on="old_symbol", how="left_semi").join(new, on="new_symbol", how="left_semi")


def stamp_attribution(bars: DataFrame, venue: str, native_or_proxy: str, source_type: str, frequency: str) -> DataFrame:
    """Add the source columns and the dataset id ``venue.ohlcv.frequency.symbol``."""
    if frequency not in FREQUENCY_US:
        raise ValueError(f"unknown frequency {frequency!r}")
    return bars.withColumns(
        {
            "source_venue": F.lit(venue),
            "native_or_proxy": F.lit(native_or_proxy),
            "source_type": F.lit(source_type),
            "dataset_id": F.concat_ws(".", F.lit(venue.lower()), F.lit("ohlcv"), F.lit(frequency), F.col("symbol")),
        }
    )


def prefix_multiplier(symbol: Column) -> Column:
    """Names that start with ``k`` quote a thousand units; informative only, the symbol map decides."""
    return F.when(symbol.startswith("k"), F.lit(1000)).otherwise(F.lit(1))
