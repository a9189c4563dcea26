"""Two venues bar by bar: unit normalisation, overlap statistics, lagged correlation and signal agreement.

Inputs are bars, unique per (symbol, hour) and venue, so per-symbol windows and exact percentiles hold at most
one value per grid step (87,600 for ten years of hours)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.functions.numeric import ratio
from tapeledger.operators.ordered import exact_percentiles
from tapeledger.session import cut_lineage
from tapeledger.functions.timegrid import DAY_US, epoch_us

FIELDS = ["open", "high", "low", "close"]
PERCENTS = [1, 5, 25, 50, 75, 95, 99]
LARGE_DIFFERENCE = 0.05
RATIO_BOUNDS = (0.5, 2.0)
LAGS = [-2, -1, 0, 1, 2]


def map_symbols(bars: DataFrame, mapping: DataFrame) -> DataFrame:
    """Left join to the symbol map; a symbol without an entry keeps NULLs and is never guessed."""
    return bars.join(mapping, on="symbol", how="left")


def normalise_units(bars: DataFrame, multiplier: Column) -> DataFrame:
    """Price per single unit: divide the four prices by the venue's own multiplier."""
    return bars.withColumns({c: F.col(c) / multiplier for c in FIELDS})


def overlap(a: DataFrame, b: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars both venues have, as ``a_*`` and ``b_*`` columns."""
    names = [*FIELDS, "volume"]
    left = a.select(*keys, "timestamp", *[F.col(c).alias(f"a_{c}") for c in names])
    right = b.select(*keys, "timestamp", *[F.col(c).alias(f"b_{c}") for c in names])
    return left.join(right, on=[*keys, "timestamp"], how="inner")


def with_returns(pairs: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Simple returns of both closes over neighbouring kept rows; NULL on the first row of a symbol."""
    along = Window.partitionBy(*keys).orderBy("timestamp")
    return pairs.withColumns({f"{v}_ret": ratio(F.col(f"{v}_close"), F.lag(f"{v}_close").over(along)) - 1 for v in ("a", "b")})


def simple_returns(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy("timestamp")
    out = bars.select(*keys, "timestamp", (ratio(F.col("close"), F.lag("close").over(along)) - 1).alias("ret"))
    return out.where(F.col("ret").isNotNull())


def log_returns(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy("timestamp")
    log = F.when(F.col("close") > 0, F.ln("close"))  # a bar without a positive close has no return, and none has the bar after it
    out = bars.select(*keys, "timestamp", (log - F.lag(log).over(along)).alias("ret"))
    return out.where(F.col("ret").isNotNull())


def return_statistics(pairs: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Correlation, mean absolute difference, volatilities and their ratio per symbol; NULL below two returns."""
    r = with_returns(pairs, keys)
    enough = F.count("a_ret") >= 2
    out = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_overlapping_bars"), F.count("a_ret").alias("n_returns"),
        F.when(enough, F.corr("a_ret", "b_ret")).alias("return_correlation"),
        F.avg(F.abs(F.col("b_ret") - F.col("a_ret"))).alias("mean_abs_return_diff"),
        F.when(enough, F.stddev_samp("a_ret")).alias("a_volatility"),
        F.when(enough, F.stddev_samp("b_ret")).alias("b_volatility"),
    )
    return out.withColumn("volatility_ratio", ratio(F.col("b_volatility"), F.col("a_volatility")))


def _percentile_rows(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    found = values.groupBy(*keys).agg(F.percentile(value, [p / 100.0 for p in PERCENTS]).alias("_p"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in PERCENTS]).alias("percent"), F.col("_p").alias("value"))
    return found.where(F.col("_p").isNotNull()).select(*keys, F.inline(pairs).alias("percent", "value"))


def return_diff_percentiles(pairs: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    diffs = with_returns(pairs, keys).select(*keys, F.abs(F.col("b_ret") - F.col("a_ret")).alias("_d")).where("_d is not null")
    return _percentile_rows(diffs, keys, "_d")


def field_differences(pairs: DataFrame, keys: list[str] = ["symbol"], reference: str = "a") -> DataFrame:
    """Relative difference |b-a|/|reference| per price field, long form."""
    wide = pairs.select(*keys, "timestamp", *[ratio(F.abs(F.col(f"b_{c}") - F.col(f"a_{c}")), F.abs(F.col(f"{reference}_{c}"))).alias(c) for c in FIELDS])
    return wide.unpivot([*keys, "timestamp"], FIELDS, "field", "relative_diff")


def field_difference_percentiles(pairs: DataFrame, keys: list[str] = ["symbol"], reference: str = "a") -> DataFrame:
    return _percentile_rows(field_differences(pairs, keys, reference), [*keys, "field"], "relative_diff")


def large_differences(pairs: DataFrame, keys: list[str] = ["symbol"], limit: float = LARGE_DIFFERENCE) -> DataFrame:
    return field_differences(pairs, keys).where(F.col("relative_diff") > limit)


def unit_ratio_check(pairs: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Median close ratio b/a per symbol; it must lie strictly inside the bounds. A ratio on a bound is the mark
    of a wrong power-of-ten multiplier."""
    low, high = RATIO_BOUNDS
    out = pairs.groupBy(*keys).agg(F.percentile(ratio(F.col("b_close"), F.col("a_close")), 0.5).alias("median_ratio")).where("median_ratio is not null")
    return out.withColumn("within_bounds", (F.col("median_ratio") > low) & (F.col("median_ratio") < high))


def around_listing(pairs: DataFrame, listing: DataFrame, days: int = 3, keys: list[str] = ["symbol"]) -> DataFrame:
    """Rows within ``days`` of a symbol's listing time (both ends included)."""
    joined = pairs.join(listing.select(*keys, "listing_timestamp"), on=keys)
    near = F.abs(epoch_us("timestamp") - epoch_us("listing_timestamp")) <= days * DAY_US
    return joined.where(near).select(*pairs.columns)


def high_volatility(pairs: DataFrame, keys: list[str] = ["symbol"], rows: int = 20, quantile: float = 0.9) -> DataFrame:
    """Rows in the top decile of the rolling volatility of venue a. Returns taken later over the kept rows span
    the rows left out; that is intended."""
    frame = Window.partitionBy(*keys).orderBy("timestamp").rowsBetween(1 - rows, 0)
    r = with_returns(pairs, keys)
    r = r.withColumn("_vol", F.when(F.count("a_ret").over(frame) == rows, F.stddev_samp("a_ret").over(frame)))
    cut = F.percentile("_vol", quantile).over(Window.partitionBy(*keys))
    return r.withColumn("_cut", cut).where(F.col("_vol") >= F.col("_cut")).select(*pairs.columns)


def lagged_correlation(a: DataFrame, b: DataFrame, keys: list[str] = ["symbol"], lags: list[int] = LAGS) -> DataFrame:
    """Correlation of a's log return at t with b's at t-lag over aligned rows (positive lag: b leads)."""
    ra = log_returns(a, keys).withColumnRenamed("ret", "ra")
    rb = log_returns(b, keys).withColumnRenamed("ret", "rb")
    along = Window.partitionBy(*keys).orderBy("timestamp")
    aligned = ra.join(rb, on=[*keys, "timestamp"])
    shifted = [F.lag("rb", l).over(along) if l >= 0 else F.lead("rb", -l).over(along) for l in lags]
    aligned = aligned.select(*keys, "ra", *[s.alias(f"_b{i}") for i, s in enumerate(shifted)])
    rhos = [F.when(F.count(F.when(F.col(f"_b{i}").isNotNull(), F.col("ra"))) > 1, F.corr("ra", f"_b{i}")) for i in range(len(lags))]
    wide = aligned.groupBy(*keys).agg(*[r.alias(f"_r{i}") for i, r in enumerate(rhos)])
    entries = F.array(*[F.struct(F.lit(l).alias("lag"), F.col(f"_r{i}").alias("rho")) for i, l in enumerate(lags)])
    return wide.select(*keys, F.inline(entries).alias("lag", "rho"))


def alignment_test(rho: DataFrame, keys: list[str] = ["symbol"], least: float = 0.99) -> DataFrame:
    """Lag of the highest correlation (the first one on ties) and whether both alignment rules hold."""
    best = F.max_by("lag", F.struct(F.col("rho"), -F.col("lag")))
    at_zero = F.max(F.when(F.col("lag") == 0, F.col("rho")))
    out = rho.groupBy(*keys).agg(best.alias("argmax_lag"), at_zero.alias("rho_0"))
    return out.withColumns({"passes_argmax": F.col("argmax_lag") == 0, "passes_rho0": F.col("rho_0") >= least})


def signal_differences(a: DataFrame, b: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars on which two signals differ, with close, average and relative margin on both sides."""
    names = ["close", "sma", "signal"]
    left = a.select(*keys, "timestamp", *[F.col(c).alias(f"a_{c}") for c in names])
    right = b.select(*keys, "timestamp", *[F.col(c).alias(f"b_{c}") for c in names])
    both = left.join(right, on=[*keys, "timestamp"]).where(F.col("a_signal") != F.col("b_signal"))
    margin = {f"{v}_margin": ratio(F.abs(F.col(f"{v}_close") - F.col(f"{v}_sma")), F.col(f"{v}_sma")) for v in "ab"}
    return both.withColumns(margin)


def signal_agreement(a: DataFrame, b: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Agreement rate, differing bars, entries and exits of two 0/1 signals on the same index."""
    both = a.select(*keys, "timestamp", F.col("signal").cast("int").alias("sa")).join(
        b.select(*keys, "timestamp", F.col("signal").cast("int").alias("sb")), on=[*keys, "timestamp"]
    )
    along = Window.partitionBy(*keys).orderBy("timestamp")
    both = both.withColumns({"da": F.col("sa") - F.lag("sa").over(along), "db": F.col("sb") - F.lag("sb").over(along)})
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.avg((F.col("sa") == F.col("sb")).cast("double")).alias("agreement_rate"),
        F.count_if(F.col("sa") != F.col("sb")).alias("n_differing"),
        F.count_if(F.col("da") == 1).alias("a_entries"), F.count_if(F.col("da") == -1).alias("a_exits"),
        F.count_if(F.col("db") == 1).alias("b_entries"), F.count_if(F.col("db") == -1).alias("b_exits"),
    )


def repeated_closes(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars whose close equals the close before it."""
    along = Window.partitionBy(*keys).orderBy("timestamp")
    marked = bars.withColumn("_same", F.col("close") == F.lag("close").over(along))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"), F.count_if("_same").alias("n_repeated"))


def overlap_differences(reconstructed: DataFrame, official: DataFrame, keys: list[str] = ["symbol"], percents: list[int] = PERCENTS) -> DataFrame:
    """Percentiles of the relative difference of each price field on bars of both sides: ``keys, field, percent, n, value``.
    Bars whose official price is zero give no difference. Exact for groups of any size."""
    fields = ["open", "high", "low", "close"]
    both = reconstructed.select(*keys, "timestamp", *[F.col(f).alias(f"_r_{f}") for f in fields]).join(official.select(*keys, "timestamp", *[F.col(f).alias(f"_o_{f}") for f in fields]), on=[*keys, "timestamp"])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), ratio(F.abs(F.col(f"_r_{f}") - F.col(f"_o_{f}")), F.abs(F.col(f"_o_{f}"))).alias("_d")) for f in fields]))
    rows = both.select(*keys, each.alias("e")).select(*keys, "e.field", "e._d").where("_d is not null")
    return exact_percentiles(cut_lineage(rows, "field-differences"), [*keys, "field"], "_d", percents)


def overlap_report(reconstructed: DataFrame, official: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars on both sides, on one side only, and volume-ratio percentiles (a ratio near two means that both sides
    of each trade were counted). Official bars without volume give no ratio."""
    rec = reconstructed.select(*keys, "timestamp", F.col("volume").alias("_rv"), F.lit(True).alias("_r"))
    off = official.select(*keys, "timestamp", F.col("volume").alias("_ov"), F.lit(True).alias("_o"))
    both = rec.join(off, on=[*keys, "timestamp"], how="full_outer")
    here, there = F.col("_r").isNotNull(), F.col("_o").isNotNull()
    volumes = F.when(here & there, ratio(F.col("_rv"), F.col("_ov")))
    out = both.groupBy(*keys).agg(
        F.count_if(here & there).alias("n_overlapping_bars"), F.count_if(~here & there).alias("missing_in_reconstruction"),
        F.count_if(here & ~there).alias("missing_in_official"), F.percentile(volumes, [p / 100.0 for p in PERCENTS]).alias("_p"),
    )
    named = [F.element_at("_p", i + 1).alias(f"volume_ratio_p{p}") for i, p in enumerate(PERCENTS)]
    return out.select(*keys, "n_overlapping_bars", "missing_in_reconstruction", "missing_in_official", *named)
