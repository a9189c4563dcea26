"""Queries on ticks, bars, grids and universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions.timegrid import DAY_US, HOUR_US, epoch_us, time_block
from tapeledger.operators import bars as B
from tapeledger.operators import compare, intervals, quality, signals
from tapeledger.plans import views as V
from tapeledger.plans.registry import query
from tapeledger.sources.bar_store import scan_bars, scan_funding

_BAR_OUT = "open, high, low, close, volume, trade_count, native_traded"


@query("bars_scan_range", """SELECT symbol, timestamp, open, high, low, close, volume, trade_count, native_traded, 'tape' AS source_venue, 'native' AS native_or_proxy,
  'hyperliquid_candle' AS source_type, 'tape.ohlcv.1h.' || symbol AS dataset_id FROM bars_1h
  WHERE symbol IN ('click', 'view', 'purchase', 'error') AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-20' ORDER BY symbol, timestamp""", ("bars_1h",))
def bars_scan_range(spark, sf):
    """Half-open time range and symbol list; the time filter reaches the tick scan because buckets are whole hours."""
    bars = B.stamp_attribution(V.bars_1h(spark, sf), "tape", "native", "hyperliquid_candle", "1h")
    return scan_bars(bars, ["click", "view", "purchase", "error"], "2024-01-03", "2024-01-20")


@query("funding_scan_range", """SELECT symbol, timestamp, trade_id, round(funding_rate, 12) AS funding_rate FROM funding_events
  WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-20'""", ("funding_events",))
def funding_scan_range(spark, sf):
    return scan_funding(V.funding_events(spark, sf), None, "2024-01-03", "2024-01-20").select("symbol", "timestamp", "trade_id", F.round("funding_rate", 12).alias("funding_rate"))


@query("ticks_to_bars", "SELECT * FROM bars_1h", ("bars_1h",))
def ticks_to_bars(spark, sf):
    return V.bars_1h(spark, sf)


_ROLL = """SELECT symbol, {bucket} AS timestamp, first(open ORDER BY b.timestamp) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY b.timestamp) AS close,
  sum(volume) AS volume, sum(trade_count)::BIGINT AS trade_count, bool_or(native_traded) AS native_traded FROM bars_1h b
  GROUP BY symbol, {bucket} HAVING count(DISTINCT b.timestamp) = {n}"""
_ROLL_4H = _ROLL.format(bucket="time_bucket(INTERVAL 4 HOUR, b.timestamp, TIMESTAMP '1970-01-01')", n=4)
_ROLL_1D = _ROLL.format(bucket="date_trunc('day', b.timestamp)", n=24)


@query("ohlcv_rollup_4h", _ROLL_4H, ("bars_1h",))
def ohlcv_rollup_4h(spark, sf):
    return B.roll_up(V.bars_1h(spark, sf), 4 * HOUR_US)


@query("ohlcv_rollup_1d", _ROLL_1D, ("bars_1h",))
def ohlcv_rollup_1d(spark, sf):
    return B.roll_up(V.bars_1h(spark, sf), DAY_US)


@query("rollup_fallback", f"""WITH rolled AS ({_ROLL_4H}), native AS (SELECT * FROM rolled WHERE timestamp >= TIMESTAMP '2024-01-15'),
  begins AS (SELECT symbol, min(timestamp) AS b FROM native GROUP BY symbol)
  SELECT symbol, timestamp, {_BAR_OUT}, false AS is_aggregated FROM native UNION ALL
  SELECT r.symbol, r.timestamp, {_BAR_OUT}, true FROM rolled r LEFT JOIN begins USING (symbol) WHERE b IS NULL OR r.timestamp < b""", ("bars_1h",))
def rollup_fallback(spark, sf):
    rolled = B.roll_up(V.bars_1h(spark, sf), 4 * HOUR_US)
    return B.native_with_rolled_prefix(rolled.where(F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp_ntz")), rolled)


@query("fills_to_trades", """SELECT trade_id, symbol, timestamp, px, sz FROM ticks WHERE trade_id IN (
  SELECT trade_id FROM (SELECT trade_id FROM ticks UNION ALL SELECT trade_id FROM ticks WHERE sz > 0) GROUP BY trade_id HAVING count(*) = 2)""", ("ticks",))
def fills_to_trades(spark, sf):
    """Every trade with size has a maker and a taker fill; trades of size zero have one side only and are reported, not kept."""
    t = V.ticks(spark, sf).select("trade_id", "symbol", "timestamp", "px", "sz")
    sides = F.when(F.col("sz") > 0, F.array(F.lit("maker"), F.lit("taker"))).otherwise(F.array(F.lit("maker")))
    trades, _ = B.fills_to_trades(t.withColumn("side", F.explode(sides)))
    return trades


@query("fills_findings", "SELECT trade_id, 'INCOMPLETE_PAIR' AS code, 1::BIGINT AS n_fills FROM ticks WHERE NOT sz > 0", ("ticks",))
def fills_findings(spark, sf):
    t = V.ticks(spark, sf).select("trade_id", "symbol", "timestamp", "px", "sz")
    sides = F.when(F.col("sz") > 0, F.array(F.lit("maker"), F.lit("taker"))).otherwise(F.array(F.lit("maker")))
    _, findings = B.fills_to_trades(t.withColumn("side", F.explode(sides)))
    return findings


_KEYED = "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem"


@query("dedupe_identical", f"""SELECT l_orderkey, l_linenumber, any_value(l_returnflag) AS l_returnflag, any_value(l_linestatus) AS l_linestatus FROM ({_KEYED})
  GROUP BY ALL HAVING count(DISTINCT (l_returnflag, l_linestatus)) = 1""".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber"))
def dedupe_identical(spark, sf):
    rows, _ = B.dedupe_by_key(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_linenumber"])
    return rows


@query("dedupe_conflicts", f"""SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM ({_KEYED}) GROUP BY l_orderkey, l_linenumber
  HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1""")
def dedupe_conflicts(spark, sf):
    _, conflicts = B.dedupe_by_key(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_linenumber"])
    return conflicts


_QUIET = "SELECT symbol, timestamp, open, high, low, close, CASE WHEN hour(timestamp) < 6 OR timestamp < TIMESTAMP '2024-01-02' THEN 0.0::DOUBLE ELSE volume END AS volume, CASE WHEN hour(timestamp) < 6 OR timestamp < TIMESTAMP '2024-01-02' THEN 0 ELSE trade_count END AS trade_count FROM bars_1h"


def _quiet_bars(spark, sf):
    """Bars with untraded placeholders: the whole first day and the first six hours of every other day."""
    b = V.bars_1h(spark, sf)
    quiet = (F.hour("timestamp") < 6) | (F.col("timestamp") < F.lit("2024-01-02").cast("timestamp_ntz"))
    b = b.withColumns({"volume": F.when(quiet, 0.0).otherwise(F.col("volume")), "trade_count": F.when(quiet, 0).otherwise(F.col("trade_count"))})
    return b.withColumn("native_traded", B.native_traded(F.col("volume"), F.col("trade_count")))


@query("leading_run_quarantine", f"""WITH q AS (SELECT *, NOT (volume = 0 AND trade_count = 0) AS native_traded FROM ({_QUIET})),
  f AS (SELECT symbol, min(timestamp) AS first_bar FROM q WHERE native_traded GROUP BY symbol)
  SELECT q.* FROM q JOIN f USING (symbol) WHERE q.timestamp >= first_bar""", ("bars_1h",))
def leading_run_quarantine(spark, sf):
    return B.drop_leading_placeholders(_quiet_bars(spark, sf))


@query("closed_bars_only", "SELECT * FROM bars_1h WHERE timestamp + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25 12:30:00'", ("bars_1h",))
def closed_bars_only(spark, sf):
    return B.closed_bars(V.bars_1h(spark, sf), F.lit("2024-01-25 12:30:00").cast("timestamp_ntz"))


_UNIVERSE = f"""SELECT symbol, min(CASE WHEN NOT (volume = 0 AND trade_count = 0) THEN timestamp END) AS first_native_bar,
  CASE WHEN symbol IN ('error', 'view') THEN max(CASE WHEN NOT (volume = 0 AND trade_count = 0) THEN timestamp END) END AS last_native_bar,
  symbol IN ('error', 'view') AS is_delisted FROM ({_QUIET}) GROUP BY symbol"""


def _universe(spark, sf):
    q = _quiet_bars(spark, sf)
    marks = q.select("symbol").distinct().withColumn("is_delisted", F.col("symbol").isin("error", "view"))
    return B.listing_range(q, marks)


@query("listing_range", _UNIVERSE, ("bars_1h",))
def listing_range(spark, sf):
    return _universe(spark, sf)


@query("universe_asof", f"""SELECT symbol, day, first_native_bar FROM (SELECT *, unnest([TIMESTAMP '2024-01-01 12:00:00', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-30 23:00:00']) AS day FROM ({_UNIVERSE}))
  WHERE first_native_bar <= day AND (last_native_bar IS NULL OR day <= last_native_bar)""", ("bars_1h",))
def universe_asof(spark, sf):
    """Membership at three dates at once."""
    dates = F.array(*[F.lit(d).cast("timestamp_ntz") for d in ("2024-01-01 12:00:00", "2024-01-20", "2024-01-30 23:00:00")])
    return B.members_as_of(_universe(spark, sf).withColumn("day", F.explode(dates)), F.col("day")).select("symbol", "day", "first_native_bar")


@query("missing_window_class", f"""WITH u AS ({_UNIVERSE}), w AS (SELECT symbol, date_trunc('day', timestamp) AS window_start, date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end,
  date_trunc('day', timestamp) < TIMESTAMP '2024-01-10' AS beyond_retention FROM bars_1h GROUP BY ALL)
  SELECT w.*, CASE WHEN window_end <= first_native_bar THEN 'NOT_YET_LISTED' WHEN is_delisted AND window_start >= last_native_bar THEN 'DELISTED'
  WHEN beyond_retention THEN 'BEYOND_RETENTION' ELSE 'VENUE_GAP' END AS classification FROM w LEFT JOIN u USING (symbol)""", ("bars_1h",))
def missing_window_class(spark, sf):
    """Every symbol and day, as if its fetch had come back empty."""
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    w = V.bars_1h(spark, sf).select("symbol", day.alias("window_start")).distinct()
    w = w.withColumns({"window_end": F.col("window_start") + F.expr("INTERVAL 1 DAY"), "beyond_retention": F.col("window_start") < F.lit("2024-01-10").cast("timestamp_ntz")})
    return B.classify_missing_windows(w, _universe(spark, sf))


@query("rename_candidates", f"""WITH u AS ({_UNIVERSE}), p(old_symbol, new_symbol) AS (VALUES ('error', 'click'), ('view', 'absent'), ('click', 'view'), ('view', 'purchase'))
  SELECT p.* FROM p JOIN u o ON o.symbol = old_symbol AND o.is_delisted JOIN u n ON n.symbol = new_symbol""", ("bars_1h",))
def rename_candidates(spark, sf):
    pairs = spark.createDataFrame([("error", "click"), ("view", "absent"), ("click", "view"), ("view", "purchase")], "old_symbol string, new_symbol string")
    return B.rename_candidates(_universe(spark, sf), pairs)


_EXPECTED = "SELECT unnest(generate_series((SELECT min(timestamp) FROM {src}), (SELECT max(timestamp) FROM {src}), INTERVAL 1 HOUR)) AS timestamp"


@query("grid_gaps", f"{_EXPECTED.format(src='bars_1h')} EXCEPT SELECT timestamp FROM bars_1h", ("bars_1h",))
def grid_gaps(spark, sf):
    return intervals.grid_gaps(V.bars_1h(spark, sf))


@query("first_grid_gap", f"""WITH p AS (SELECT DISTINCT timestamp FROM bars_1h), m AS (SELECT min(timestamp) AS first_missing FROM ({_EXPECTED.format(src='p')} EXCEPT SELECT timestamp FROM p))
  SELECT first_missing, (SELECT max(timestamp) FROM p WHERE timestamp < first_missing) AS previous_bar FROM m WHERE first_missing IS NOT NULL""", ("bars_1h",))
def first_grid_gap(spark, sf):
    return intervals.first_grid_gap(V.bars_1h(spark, sf))


@query("hourly_coverage", """SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-03', INTERVAL 1 HOUR)) AS timestamp EXCEPT
  (SELECT timestamp FROM bars_1h UNION SELECT TIMESTAMP '2024-02-03')""", ("bars_1h",))
def hourly_coverage(spark, sf):
    return intervals.missing_hours(V.bars_1h(spark, sf), F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-03").cast("timestamp_ntz"))


@query("grid_segments", """SELECT min(timestamp) AS segment_start, max(timestamp) AS segment_end, count(*) AS n_bars FROM (
  SELECT timestamp, timestamp - to_hours(row_number() OVER (ORDER BY timestamp)) AS g FROM (SELECT DISTINCT timestamp FROM bars_1h)) GROUP BY g""", ("bars_1h",))
def grid_segments(spark, sf):
    return intervals.grid_segments(V.bars_1h(spark, sf))


@query("reindex_null", f"""SELECT s.symbol, g.timestamp, open, close FROM (SELECT DISTINCT symbol FROM bars_1h) s CROSS JOIN ({_EXPECTED.format(src='bars_1h')}) g
  LEFT JOIN bars_1h b ON b.symbol = s.symbol AND b.timestamp = g.timestamp""", ("bars_1h",))
def reindex_null(spark, sf):
    return intervals.reindex_with_null(V.bars_1h(spark, sf), ["open", "close"])


_SYMBOLS = ["click", "error", "purchase", "signup", "view"]


@query("pivot_close", "SELECT timestamp, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {s}" for s in _SYMBOLS) + " FROM bars_1h GROUP BY timestamp", ("bars_1h",))
def pivot_close(spark, sf):
    return intervals.pivot_wide(V.bars_1h(spark, sf), "close", _SYMBOLS)


_LABELLED = """SELECT *, CASE WHEN trade_count > 2 THEN 'A' ELSE 'B' END AS source_venue, CASE WHEN trade_count > 2 THEN 'native' ELSE 'proxy' END AS native_or_proxy,
  CASE WHEN trade_count > 2 THEN 'hyperliquid_candle' ELSE 'binance_um_kline' END AS source_type, CASE WHEN trade_count > 2 THEN 'a.' ELSE 'b.' END || symbol AS dataset_id FROM bars_1h"""
_SEGMENTS = """SELECT symbol, segment, source_venue, native_or_proxy, source_type, dataset_id, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS n_bars FROM (
  SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY timestamp)::BIGINT AS segment FROM (SELECT *, CASE WHEN source_venue = lag(source_venue) OVER (PARTITION BY symbol ORDER BY timestamp) THEN 0 ELSE 1 END AS c
  FROM (""" + _LABELLED + "))) GROUP BY ALL"
_LABELS = ["source_venue", "native_or_proxy", "source_type", "dataset_id"]


def labelled_bars(spark, sf):
    """Bars whose source depends on how busy the hour was."""
    busy = F.col("trade_count") > 2
    return V.bars_1h(spark, sf).withColumns({
        "source_venue": F.when(busy, "A").otherwise("B"), "native_or_proxy": F.when(busy, "native").otherwise("proxy"),
        "source_type": F.when(busy, "hyperliquid_candle").otherwise("binance_um_kline"), "dataset_id": F.concat(F.when(busy, "a.").otherwise("b."), "symbol")})


@query("source_segments", _SEGMENTS, ("bars_1h",))
def source_segments(spark, sf):
    return intervals.source_segments(labelled_bars(spark, sf))


@query("segments_agree", """SELECT symbol, b.timestamp, 'LABELS_DIFFER' AS code FROM bars_1h b WHERE trade_count > 2 AND high > 95""", ("bars_1h",))
def segments_agree(spark, sf):
    """Bars whose own label was altered after the segments were built."""
    bars = labelled_bars(spark, sf)
    altered = bars.withColumn("source_venue", F.when((F.col("trade_count") > 2) & (F.col("high") > 95), "X").otherwise(F.col("source_venue")))
    return intervals.segments_disagreeing(altered, intervals.source_segments(bars), _LABELS)


@query("spliced_series", """WITH s AS (SELECT symbol, timestamp, close, venue, false AS seam FROM bars_1h_venue WHERE venue = 'B' AND timestamp < TIMESTAMP '2024-01-12 05:00:00' UNION ALL
  SELECT symbol, timestamp, close, venue, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) = 1 FROM bars_1h_venue WHERE venue = 'A' AND timestamp >= TIMESTAMP '2024-01-12 05:00:00')
  SELECT symbol, timestamp, close, venue, seam AS seam_bar FROM s""", ("bars_1h_venue",))
def spliced_series(spark, sf):
    b = V.bars_1h_venue(spark, sf).select("symbol", "timestamp", "close", "venue")
    return intervals.splice(b.where("venue = 'B'"), b.where("venue = 'A'"), F.lit("2024-01-12 05:00:00").cast("timestamp_ntz"), opt_in=True)


@query("index_equality", """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.timestamp, b.timestamp) AS timestamp, CASE WHEN b.symbol IS NULL THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END AS side
  FROM (SELECT * FROM bars_1h_venue WHERE venue = 'A') a FULL JOIN (SELECT * FROM bars_1h_venue WHERE venue = 'B') b ON a.symbol = b.symbol AND a.timestamp = b.timestamp
  WHERE a.symbol IS NULL OR b.symbol IS NULL""", ("bars_1h_venue",))
def index_equality(spark, sf):
    b = V.bars_1h_venue(spark, sf)
    return intervals.key_set_difference(b.where("venue = 'A'"), b.where("venue = 'B'"), ["symbol", "timestamp"])


@query("priority_merge", f"""SELECT symbol, timestamp, {_BAR_OUT} FROM bars_1h_venue WHERE venue = 'A' UNION ALL SELECT symbol, timestamp, {_BAR_OUT} FROM bars_1h_venue b WHERE venue = 'B' AND NOT EXISTS (
  SELECT 1 FROM bars_1h_venue a WHERE a.venue = 'A' AND a.symbol = b.symbol AND a.timestamp = b.timestamp)""", ("bars_1h_venue",))
def priority_merge(spark, sf):
    b = V.bars_1h_venue(spark, sf)
    return B.with_priority(b.where("venue = 'A'").drop("venue"), b.where("venue = 'B'").drop("venue"), ["symbol", "timestamp"])


_W = "WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)"


@query("returns_simple", f"SELECT symbol, timestamp, round(ret, 9) AS ret FROM (SELECT symbol, timestamp, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars_1h {_W}) WHERE ret IS NOT NULL", ("bars_1h",))
def returns_simple(spark, sf):
    priced = V.bars_1h(spark, sf)
    return compare.simple_returns(priced).select("symbol", "timestamp", F.round("ret", 9).alias("ret"))


@query("returns_log", f"SELECT symbol, timestamp, round(ret, 9) AS ret FROM (SELECT symbol, timestamp, l - lag(l) OVER w AS ret FROM (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS l FROM bars_1h) {_W}) WHERE ret IS NOT NULL", ("bars_1h",))
def returns_log(spark, sf):
    return compare.log_returns(V.bars_1h(spark, sf)).select("symbol", "timestamp", F.round("ret", 9).alias("ret"))


@query("sma_signal", f"""SELECT symbol, timestamp, close, round(sma, 9) AS sma, (close > sma)::DOUBLE AS signal FROM (SELECT *, avg(close) OVER f AS sma, count(*) OVER f AS n FROM bars_1h
  WINDOW f AS (PARTITION BY symbol ORDER BY timestamp ROWS 19 PRECEDING)) WHERE n = 20""", ("bars_1h",))
def sma_signal(spark, sf):
    return signals.sma_signal(V.bars_1h(spark, sf), 20).select("symbol", "timestamp", "close", F.round("sma", 9).alias("sma"), "signal")


@query("repeated_close", f"SELECT symbol, count(*) AS n_bars, count(*) FILTER (WHERE same) AS n_repeated FROM (SELECT symbol, close = lag(close) OVER w AS same FROM bars_1h {_W}) GROUP BY symbol", ("bars_1h",))
def repeated_close(spark, sf):
    return compare.repeated_closes(V.bars_1h(spark, sf))


# Every fifth day lacks its fourth hour, for all symbols.
_HOLED = "SELECT * FROM bars_1h WHERE NOT (hour(timestamp) = 3 AND dayofmonth(timestamp) % 5 = 0)"


def _holed(spark, sf):
    return V.bars_1h(spark, sf).where("not (hour(timestamp) = 3 and day(timestamp) % 5 = 0)")


@query("grid_gaps_found", f"WITH p AS ({_HOLED}) {_EXPECTED.format(src='p')} EXCEPT SELECT timestamp FROM p", ("bars_1h",))
def grid_gaps_found(spark, sf):
    return intervals.grid_gaps(_holed(spark, sf))


@query("first_grid_gap_found", f"""WITH p AS ({_HOLED}), m AS (SELECT min(timestamp) AS first_missing FROM ({_EXPECTED.format(src='p')} EXCEPT SELECT timestamp FROM p))
  SELECT first_missing, (SELECT max(timestamp) FROM p WHERE timestamp < first_missing) AS previous_bar FROM m WHERE first_missing IS NOT NULL""", ("bars_1h",))
def first_grid_gap_found(spark, sf):
    return intervals.first_grid_gap(_holed(spark, sf))


@query("time_order_violations", f"""SELECT symbol, previous, timestamp, epoch_us(timestamp) - epoch_us(previous) AS step_us FROM (SELECT symbol, timestamp, lag(timestamp) OVER w AS previous FROM ({_HOLED}) {_W})
  WHERE previous IS NOT NULL AND timestamp <> previous + INTERVAL 1 HOUR""", ("bars_1h",))
def time_order_violations(spark, sf):
    return quality.time_order_violations(_holed(spark, sf), ["symbol"], HOUR_US, time_block("timestamp", DAY_US))


@query("rebalance_every_bar", "SELECT DISTINCT symbol, timestamp, true AS rebalance FROM bars_1h", ("bars_1h",))
def rebalance_every_bar(spark, sf):
    return signals.rebalance_every_bar(V.bars_1h(spark, sf), ["symbol"], "timestamp")


@query("prefix_multiplier", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE 1 END AS unit_multiplier FROM customer")
def prefix_multiplier(spark, sf):
    """Every third customer's name is written with the prefix."""
    c = V.table(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "k").otherwise(""), F.lit("S"), F.col("c_custkey").cast("string")).alias("symbol"))
    return c.select("c_custkey", B.prefix_multiplier(F.col("symbol")).alias("unit_multiplier"))


@query("universe_findings", """WITH u AS (SELECT 'S' || (s_suppkey % 97) AS symbol, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 11 = 0 END AS safe FROM supplier)
  SELECT 'error' AS severity, 'DUPLICATE_SYMBOL_NAME' AS code, symbol, count(*) AS n FROM u GROUP BY symbol HAVING count(*) > 1
  UNION ALL SELECT 'error', 'SURVIVORSHIP_SAFE_NOT_FALSE', symbol, 1 FROM u WHERE coalesce(safe, true)""")
def universe_findings(spark, sf):
    u = V.table(spark, sf, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 97).cast("string")).alias("symbol"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 11 == 0).alias("survivorship_safe"))
    return quality.validate_universe(u).select("severity", "code", "symbol", F.col("n").cast("bigint").alias("n"))
