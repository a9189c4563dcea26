"""Data-quality findings. Every check returns rows ``severity, code, symbol, timestamp, n`` instead of raising;
``fail_on`` turns errors into an exception where a caller wants that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeledger.functions.numeric import finite, finite_positive
from tapeledger.functions.timegrid import epoch_us
from tapeledger.operators.bars import BAR_COLUMNS, native_traded
from tapeledger.operators.intervals import MAX_FUNDING_GAP_US, gaps_over, outside_intervals, overlapping_records
from tapeledger.operators.ordered import with_previous

# Fixed values of the data model.
SOURCE_TYPES = ["hyperliquid_candle", "hyperliquid_node_trades", "hyperliquid_node_fills", "binance_um_kline"]
RESERVED_SOURCE_TYPES = ["external_proxy"]
QUOTE_SOURCES = ["l2_book", "mid_px", "asset_ctxs_mid_px"]
IMPLAUSIBLE_RATE = 0.01

BAR_TYPES = {
    "symbol": T.StringType(), "open": T.DoubleType(), "high": T.DoubleType(), "low": T.DoubleType(), "close": T.DoubleType(),
    "volume": T.DoubleType(), "trade_count": T.LongType(), "native_traded": T.BooleanType(), "source_venue": T.StringType(),
    "native_or_proxy": T.StringType(), "source_type": T.StringType(), "dataset_id": T.StringType(),
}
FUNDING_COLUMNS = ["timestamp", "symbol", "funding_rate", "premium", "notional_price"]
FUNDING_TYPES = {
    "symbol": T.StringType(), "funding_rate": T.DoubleType(), "premium": T.DoubleType(), "notional_price": T.DoubleType(),
}


class FindingsError(ValueError):
    """Raised by ``fail_on`` when error findings exist."""


def fail_on(findings: DataFrame, severity: str = "error") -> None:
    bad = findings.where(F.col("severity") == severity)
    first = bad.limit(5).collect()
    if first:
        raise FindingsError(f"{bad.count()} findings: " + "; ".join(f"{r['code']} {r['symbol']} {r['timestamp']}" for r in first))


def schema_problems(schema: T.StructType, columns: list[str], types: dict[str, T.DataType], zoned_time: bool = True) -> list[str]:
    """Differences between a schema and the fixed column prefix; needs no job. Further trailing columns are allowed."""
    problems = []
    names = schema.fieldNames()
    if names[: len(columns)] != columns:
        problems.append(f"COLUMN_ORDER expected {columns}, got {names}")
    for name, expected in types.items():
        if name in names and schema[name].dataType != expected:
            problems.append(f"COLUMN_TYPE {name} is {schema[name].dataType.simpleString()}")
    if "timestamp" in names:
        allowed = (T.TimestampType,) if zoned_time else (T.TimestampType, T.TimestampNTZType)
        if not isinstance(schema["timestamp"].dataType, allowed):
            problems.append("NAIVE_TIMESTAMP")
    return problems


def assert_bar_schema(df: DataFrame, zoned_time: bool = True) -> DataFrame:
    problems = schema_problems(df.schema, BAR_COLUMNS, BAR_TYPES, zoned_time)
    if problems:
        raise FindingsError("; ".join(problems))
    return df


def assert_funding_schema(df: DataFrame, zoned_time: bool = True) -> DataFrame:
    problems = schema_problems(df.schema, FUNDING_COLUMNS, FUNDING_TYPES, zoned_time)
    if problems:
        raise FindingsError("; ".join(problems))
    return df


def source_type_findings(bars: DataFrame) -> DataFrame:
    """Rows whose source type is reserved, derived from quotes, or unknown."""
    code = (
        F.when(F.col("source_type").isin(RESERVED_SOURCE_TYPES), "RESERVED_SOURCE_TYPE")
        .when(F.col("source_type").isin(QUOTE_SOURCES), "QUOTE_DERIVED")
        .when(F.col("source_type").isNull() | ~F.col("source_type").isin(SOURCE_TYPES), "BAD_SOURCE_TYPE")
    )
    return bars.withColumn("code", code).where(F.col("code").isNotNull())


def ohlc_violation_codes() -> Column:
    """Array with one entry per broken rule of a bar; empty for a sound bar."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    v, n = F.col("volume"), F.col("trade_count")
    checks = [F.when(~finite_positive(F.col(x)), F.lit(f"MALFORMED_OHLC:{x}")) for x in ("open", "high", "low", "close")]
    checks += [
        F.when(finite(h) & finite(o) & finite(c) & (h < F.greatest(o, c)), "MALFORMED_OHLC:high_below_body"),
        F.when(finite(l) & finite(o) & finite(c) & (l > F.least(o, c)), "MALFORMED_OHLC:low_above_body"),
        F.when(finite(h) & finite(l) & (h < l), "MALFORMED_OHLC:high_below_low"),
        F.when(~finite(v) | (v < 0), "NEGATIVE_OR_NONFINITE_VOLUME"),
        F.when(n < 0, "NEGATIVE_TRADE_COUNT"),
    ]
    return F.array_compact(F.array(*checks))


def _finding(df: DataFrame, severity: str, code: Column | str, symbol: Column, timestamp: Column, n: Column) -> DataFrame:
    return df.select(
        F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), symbol.alias("symbol"),
        timestamp.cast("timestamp_ntz").alias("timestamp"), n.cast("bigint").alias("n"),
    )


def _no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def _duplicate_keys(df: DataFrame) -> DataFrame:
    dup = df.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _finding(dup, "error", "DUPLICATE_KEY", F.col("symbol"), F.col("timestamp"), F.col("n"))


def _out_of_order(df: DataFrame, sequence: str, block_rows: int) -> DataFrame:
    """First row per symbol whose time is before the row read just before it. Spark rows have no order of their
    own, so the reading order is a column."""
    block = F.floor(F.col(sequence) / block_rows)
    slim = df.select("symbol", "timestamp", sequence)
    seen = with_previous(slim, ["symbol"], [sequence], block, {"_before": "timestamp"}).where(F.col("timestamp") < F.col("_before"))
    first = seen.groupBy("symbol").agg(F.min_by("timestamp", sequence).alias("timestamp"))
    return _finding(first, "error", "NON_MONOTONIC_TIMESTAMP", F.col("symbol"), F.col("timestamp"), F.lit(1))


def _leading_placeholders(bars: DataFrame, sequence: str) -> DataFrame:
    """Untraded run at the start of a symbol, in reading order."""
    traded = native_traded(F.col("volume"), F.col("trade_count"))
    per = bars.groupBy("symbol").agg(
        F.min_by(traded, sequence).alias("_starts_traded"), F.min_by("timestamp", sequence).alias("_begins"),
        F.min(F.when(traded, F.col(sequence))).alias("_first_traded"),
    ).where(~F.col("_starts_traded"))
    run = bars.join(per, on="symbol").where(F.col("_first_traded").isNull() | (F.col(sequence) < F.col("_first_traded")))
    run = run.groupBy("symbol", "_begins").agg(F.count(F.lit(1)).alias("n"))
    return _finding(run, "warning", "BACKFILL_PREFIX_PRESENT", F.col("symbol"), F.col("_begins"), F.col("n"))


def validate_bars(bars: DataFrame, sequence: str, block_rows: int = 1_000_000) -> DataFrame:
    """All bar findings. ``sequence`` is the reading order; ``n`` counts the rows a finding stands for."""
    per_row = bars.select(
        "symbol", "timestamp",
        F.explode(F.concat(ohlc_violation_codes(), F.array_compact(F.array(
            F.when(F.col("source_type").isNull() | ~F.col("source_type").isin(SOURCE_TYPES), F.lit("BAD_SOURCE_TYPE")))))).alias("_c"),
    )
    code = F.substring_index("_c", ":", 1)
    rows = per_row.groupBy("symbol", "timestamp", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    spot = bars.where(F.contains("symbol", F.lit("/")) | F.startswith("symbol", F.lit("@"))).select("symbol").distinct()
    parts = [
        _finding(rows, "error", F.col("code"), F.col("symbol"), F.col("timestamp"), F.col("n")),
        _duplicate_keys(bars),
        _finding(spot, "error", "SPOT_STYLE_SYMBOL", F.col("symbol"), _no_time(), F.lit(1)),
        _out_of_order(bars, sequence, block_rows),
        _leading_placeholders(bars, sequence),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_funding(funding: DataFrame, sequence: str, coverage: DataFrame | None = None, max_gap_us: int = MAX_FUNDING_GAP_US, block_rows: int = 1_000_000) -> DataFrame:
    """All funding findings; the coverage checks run only for symbols that declare coverage."""
    rate = F.col("funding_rate")
    bad = funding.where(~finite(rate))
    steep = funding.where(finite(rate) & (F.abs(rate) >= IMPLAUSIBLE_RATE))
    parts = [
        _duplicate_keys(funding),
        _out_of_order(funding, sequence, block_rows),
        _finding(bad, "error", "NON_FINITE_RATE", F.col("symbol"), F.col("timestamp"), F.lit(1)),
        _finding(steep, "warning", "IMPLAUSIBLE_RATE", F.col("symbol"), F.col("timestamp"), F.lit(1)),
        _finding(gaps_over(funding, ["symbol"], "timestamp", max_gap_us), "error", "FUNDING_GAP_EXCEEDED", F.col("symbol"), F.col("timestamp"), F.lit(1)),
    ]
    if coverage is not None:
        spans = funding.groupBy("symbol").agg(F.min("timestamp").alias("_s"), F.max("timestamp").alias("_e"))
        claimed = coverage.groupBy("symbol").agg(F.min("coverage_start").alias("_cs"), F.max("coverage_end").alias("_ce"))
        wide = claimed.join(spans, on="symbol").where((F.col("_cs") < F.col("_s")) | (F.col("_ce") > F.col("_e")))
        declared = coverage.select("symbol").distinct()
        outside = outside_intervals(funding.join(declared, on="symbol", how="left_semi"), coverage)
        parts += [
            _finding(overlapping_records(coverage), "error", "COVERAGE_NOT_DISJOINT", F.col("symbol"), F.col("coverage_start"), F.lit(1)),
            _finding(wide, "error", "FALSE_COVERAGE", F.col("symbol"), F.col("_cs"), F.lit(1)),
            _finding(outside, "error", "EVENT_OUTSIDE_COVERAGE", F.col("symbol"), F.col("timestamp"), F.lit(1)),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_universe(universe: DataFrame) -> DataFrame:
    """Repeated names, and a survivorship flag that is anything but false."""
    dup = universe.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unsafe = universe.where(F.col("survivorship_safe").isNull() | F.col("survivorship_safe"))
    return _finding(dup, "error", "DUPLICATE_SYMBOL_NAME", F.col("symbol"), _no_time(), F.col("n")).unionByName(
        _finding(unsafe, "error", "SURVIVORSHIP_SAFE_NOT_FALSE", F.col("symbol"), _no_time(), F.lit(1))
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.sum("n").cast("bigint").alias("n"))


def report_status(findings: DataFrame) -> DataFrame:
    """One row: failed when there is an error, warnings when there are only warnings, ok when there is nothing."""
    errors = F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n"))), F.lit(0))
    warnings = F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("n"))), F.lit(0))
    status = F.when(errors > 0, "failed").when(warnings > 0, "warnings").otherwise("ok")
    return findings.agg(status.alias("status"), errors.cast("bigint").alias("n_errors"), warnings.cast("bigint").alias("n_warnings"))


def symbol_map_findings(mapping: DataFrame) -> DataFrame:
    """Broken rules of the symbol map, one row per symbol and code."""
    has = lambda c: F.col(c).isNotNull()
    filled = lambda c: F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))
    mapped, unmatched = F.col("status") == "mapped", F.col("status") == "unmatched"
    codes = F.array_compact(F.array(
        F.when(~F.col("status").isin("mapped", "unmatched"), "BAD_STATUS"),
        F.when(mapped & ~has("venue_symbol"), "MAPPED_WITHOUT_SYMBOL"),
        F.when(mapped & ~(has("own_unit_multiplier") & has("venue_unit_multiplier")), "MISSING_MULTIPLIER"),
        F.when(mapped & ((F.col("own_unit_multiplier") < 1) | (F.col("venue_unit_multiplier") < 1)), "NON_POSITIVE_MULTIPLIER"),
        F.when(mapped & ~filled("verified_by"), "UNVERIFIED_MAPPING"),
        F.when(unmatched & has("venue_symbol"), "UNMATCHED_WITH_SYMBOL"),
        F.when(unmatched & (has("own_unit_multiplier") | has("venue_unit_multiplier")), "UNMATCHED_WITH_MULTIPLIER"),
        F.when(unmatched & has("verified_by"), "UNMATCHED_WITH_CITATION"),
        F.when(unmatched & ~filled("reason"), "UNMATCHED_WITHOUT_REASON"),
    ))
    repeated = mapping.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol", F.lit("DUPLICATE_SYMBOL").alias("code"))
    return mapping.select("symbol", F.explode(codes).alias("code")).unionByName(repeated)


def price_violations(used: DataFrame, price: str = "px") -> DataFrame:
    """Prices a ledger needs but cannot use: never seen, or seen and not a positive finite number."""
    p = F.col(price)
    code = F.when(p.isNull() | F.isnan(p), "MISSING_PRICE").when(~finite_positive(p), "INVALID_PRICE")
    return used.withColumn("code", code).where(F.col("code").isNotNull())


def time_order_violations(df: DataFrame, keys: list[str], width_us: int, block: Column) -> DataFrame:
    """Neighbouring rows that are not exactly one grid step apart."""
    seen = with_previous(df, keys, ["timestamp"], block, {"previous": "timestamp"})
    step = epoch_us("timestamp") - epoch_us(F.col("previous"))
    return seen.where(F.col("previous").isNotNull() & (step != width_us)).select(*keys, "previous", "timestamp", step.alias("step_us"))
