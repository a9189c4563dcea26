"""Queries on data quality, coverage, funding and as-of prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions import digest as digests
from tapeledger.functions.digest import digest_tree, table_digest
from tapeledger.functions.timegrid import DAY_US, MINUTE_US
from tapeledger.operators import asof, intervals, quality
from tapeledger.operators.ordered import exact_percentiles
from tapeledger.plans import views as V
from tapeledger.plans.market_queries import labelled_bars
from tapeledger.plans.registry import query
from tapeledger.session import cut_lineage

# Bars with defects put in by rules on their own values, so that every check has something to find.
_BAD_SQL = """SELECT CASE WHEN open < 2 THEN '@' || symbol ELSE symbol END AS symbol, timestamp, CASE WHEN high > 99 THEN NULL ELSE open END AS open,
  CASE WHEN close > 95 THEN low - 1 ELSE high END AS high, CASE WHEN open > 97 THEN high + 1 ELSE low END AS low, close,
  CASE WHEN trade_count = 7 THEN -volume WHEN timestamp < TIMESTAMP '2024-01-01 09:00:00' THEN 0.0::DOUBLE ELSE volume END AS volume,
  CASE WHEN trade_count = 8 THEN -1 WHEN timestamp < TIMESTAMP '2024-01-01 09:00:00' THEN 0 ELSE trade_count END AS trade_count,
  CASE WHEN close < 3 THEN 'external_proxy' ELSE 'hyperliquid_candle' END AS source_type,
  epoch(timestamp)::BIGINT + CASE WHEN close BETWEEN 40 AND 42 THEN -7000 ELSE 0 END AS seq, copy FROM (
  SELECT *, unnest(CASE WHEN close BETWEEN 60 AND 62 THEN [1, 2] ELSE [1] END) AS copy FROM bars_1h)"""


def defective_bars(spark, sf):
    """The bars as a stored table; validation reads them once per kind of check."""
    return cut_lineage(_defective_bars(spark, sf), "defective")


def _defective_bars(spark, sf):
    b = V.bars_1h(spark, sf)
    early = F.col("timestamp") < F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")
    copies = F.explode(F.when(F.col("close").between(60, 62), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    b = b.withColumn("copy", copies)
    return b.select(
        F.when(F.col("open") < 2, F.concat(F.lit("@"), "symbol")).otherwise(F.col("symbol")).alias("symbol"), "timestamp",
        F.when(F.col("high") > 99, F.lit(None)).otherwise(F.col("open")).alias("open"),
        F.when(F.col("close") > 95, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(F.col("open") > 97, F.col("high") + 1).otherwise(F.col("low")).alias("low"), "close",
        F.when(F.col("trade_count") == 7, -F.col("volume")).when(early, 0.0).otherwise(F.col("volume")).alias("volume"),
        F.when(F.col("trade_count") == 8, -1).when(early, 0).otherwise(F.col("trade_count")).alias("trade_count"),
        F.when(F.col("close") < 3, "external_proxy").otherwise("hyperliquid_candle").alias("source_type"),
        ((F.unix_seconds(F.col("timestamp").cast("timestamp")) + F.when(F.col("close").between(40, 42), -7000).otherwise(0)) * 10 + F.col("copy")).alias("seq"),
    )


_ROW_CHECKS = """(CASE WHEN NOT coalesce(open > 0, false) THEN 1 ELSE 0 END + CASE WHEN NOT coalesce(high > 0, false) THEN 1 ELSE 0 END + CASE WHEN NOT coalesce(low > 0, false) THEN 1 ELSE 0 END
  + CASE WHEN NOT coalesce(close > 0, false) THEN 1 ELSE 0 END + CASE WHEN open IS NOT NULL AND high < greatest(open, close) THEN 1 ELSE 0 END
  + CASE WHEN open IS NOT NULL AND low > least(open, close) THEN 1 ELSE 0 END + CASE WHEN high < low THEN 1 ELSE 0 END)"""
_BAR_FINDINGS = f"""WITH bad AS (SELECT * REPLACE (seq * 10 + copy AS seq) FROM ({_BAD_SQL})),
  ordered AS (SELECT *, lag(timestamp) OVER (PARTITION BY symbol ORDER BY seq) AS before, NOT (volume = 0 AND trade_count = 0) AS traded FROM bad),
  starts AS (SELECT symbol, first(traded ORDER BY seq) AS starts_traded, first(timestamp ORDER BY seq) AS begins, min(seq) FILTER (WHERE traded) AS first_traded FROM ordered GROUP BY symbol),
  findings AS (
  SELECT 'error' AS severity, 'MALFORMED_OHLC' AS code, symbol, timestamp, sum({_ROW_CHECKS}) AS n FROM bad GROUP BY symbol, timestamp HAVING sum({_ROW_CHECKS}) > 0
  UNION ALL SELECT 'error', 'NEGATIVE_OR_NONFINITE_VOLUME', symbol, timestamp, count(*) FROM bad WHERE volume < 0 GROUP BY symbol, timestamp
  UNION ALL SELECT 'error', 'NEGATIVE_TRADE_COUNT', symbol, timestamp, count(*) FROM bad WHERE trade_count < 0 GROUP BY symbol, timestamp
  UNION ALL SELECT 'error', 'BAD_SOURCE_TYPE', symbol, timestamp, count(*) FROM bad WHERE source_type = 'external_proxy' GROUP BY symbol, timestamp
  UNION ALL SELECT 'error', 'DUPLICATE_KEY', symbol, timestamp, count(*) FROM bad GROUP BY symbol, timestamp HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'error', 'SPOT_STYLE_SYMBOL', symbol, NULL::TIMESTAMP, 1 FROM bad WHERE symbol LIKE '@%' OR contains(symbol, '/')
  UNION ALL SELECT 'error', 'NON_MONOTONIC_TIMESTAMP', symbol, first(timestamp ORDER BY seq), 1 FROM ordered WHERE timestamp < before GROUP BY symbol
  UNION ALL SELECT 'warning', 'BACKFILL_PREFIX_PRESENT', s.symbol, begins, count(*) FROM starts s JOIN ordered o ON o.symbol = s.symbol
    WHERE NOT starts_traded AND (first_traded IS NULL OR seq < first_traded) GROUP BY s.symbol, begins)"""


@query("validation_findings", f"{_BAR_FINDINGS} SELECT severity, code, symbol, timestamp, n::BIGINT AS n FROM findings", ("bars_1h",))
def validation_findings(spark, sf):
    return quality.validate_bars(defective_bars(spark, sf), "seq")


@query("validation_status", f"""{_BAR_FINDINGS} SELECT CASE WHEN sum(n) FILTER (WHERE severity = 'error') > 0 THEN 'failed' WHEN count(*) > 0 THEN 'warnings' ELSE 'ok' END AS status,
  coalesce(sum(n) FILTER (WHERE severity = 'error'), 0)::BIGINT AS n_errors, coalesce(sum(n) FILTER (WHERE severity = 'warning'), 0)::BIGINT AS n_warnings FROM findings""", ("bars_1h",))
def validation_status(spark, sf):
    return quality.report_status(quality.validate_bars(defective_bars(spark, sf), "seq"))


@query("finding_counts", f"{_BAR_FINDINGS} SELECT severity, code, sum(n)::BIGINT AS n FROM findings GROUP BY severity, code", ("bars_1h",))
def finding_counts(spark, sf):
    return quality.finding_counts(quality.validate_bars(defective_bars(spark, sf), "seq"))


@query("ohlc_violations", f"""SELECT symbol, seq * 10 + copy AS seq, {_ROW_CHECKS} + CASE WHEN volume < 0 THEN 1 ELSE 0 END + CASE WHEN trade_count < 0 THEN 1 ELSE 0 END AS n_violations
  FROM ({_BAD_SQL}) WHERE {_ROW_CHECKS} + CASE WHEN volume < 0 THEN 1 ELSE 0 END + CASE WHEN trade_count < 0 THEN 1 ELSE 0 END > 0""", ("bars_1h",))
def ohlc_violations(spark, sf):
    n = F.size(quality.ohlc_violation_codes())
    return defective_bars(spark, sf).select("symbol", "seq", n.alias("n_violations")).where("n_violations > 0")


@query("schema_assert_bars", """SELECT symbol, timestamp, source_type, CASE WHEN source_type = 'external_proxy' THEN 'RESERVED_SOURCE_TYPE' WHEN source_type = 'mid_px' THEN 'QUOTE_DERIVED' ELSE 'BAD_SOURCE_TYPE' END AS code
  FROM (SELECT symbol, timestamp, CASE WHEN close < 5 THEN 'external_proxy' WHEN close < 10 THEN 'mid_px' WHEN close > 95 THEN 'other' ELSE 'hyperliquid_candle' END AS source_type FROM bars_1h) WHERE source_type <> 'hyperliquid_candle'""", ("bars_1h",))
def schema_assert_bars(spark, sf):
    """The column prefix is checked without a job; refused source types come back as rows."""
    c = F.col("close")
    bars = labelled_bars(spark, sf).withColumn("source_type", F.when(c < 5, "external_proxy").when(c < 10, "mid_px").when(c > 95, "other").otherwise("hyperliquid_candle"))
    bars = quality.assert_bar_schema(bars.select(*quality.BAR_COLUMNS), zoned_time=False)
    return quality.source_type_findings(bars).select("symbol", "timestamp", "source_type", "code")


@query("provenance_flags", """SELECT symbol, count(*) AS n_datasets, bool_and(venue IS NOT NULL) AS provenance_complete, bool_or(proxy) AS uses_proxy_data FROM (
  SELECT DISTINCT symbol, CASE WHEN trade_count > 2 THEN 'A' WHEN trade_count = 1 THEN NULL ELSE 'B' END AS venue, trade_count <= 2 AS proxy FROM bars_1h) GROUP BY symbol""", ("bars_1h",))
def provenance_flags(spark, sf):
    from tapeledger.operators.experiments import provenance_flags as flags

    d = labelled_bars(spark, sf).select("symbol", F.when(F.col("trade_count") != 1, F.col("source_venue")).alias("source_venue"), "native_or_proxy").distinct()
    return flags(d.withColumns({"field_type": F.lit("ohlcv"), "span_start": F.lit("2024-01-01")}), ["symbol"])


# --- funding -------------------------------------------------------------------------------------------------

# Coverage with defects: records that end early, start late or reach past the events.
_CLAIMED_SQL = """SELECT symbol, CASE WHEN n_events % 5 = 0 THEN coverage_start - INTERVAL 3 HOUR ELSE coverage_start END AS coverage_start,
  CASE WHEN n_events % 3 = 0 AND coverage_end - coverage_start > INTERVAL 1 HOUR THEN coverage_end - INTERVAL 30 MINUTE ELSE coverage_end END AS coverage_end FROM coverage"""


def claimed_coverage(spark, sf):
    return cut_lineage(_claimed_coverage(spark, sf), "claimed")


def _claimed_coverage(spark, sf):
    c = intervals.coverage_islands(V.ticks(spark, sf))
    shorter = (F.col("n_events") % 3 == 0) & (F.unix_micros(F.col("coverage_end").cast("timestamp")) - F.unix_micros(F.col("coverage_start").cast("timestamp")) > 3_600_000_000)
    return c.select(
        "symbol", F.when(F.col("n_events") % 5 == 0, F.col("coverage_start") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("coverage_start")).alias("coverage_start"),
        F.when(shorter, F.col("coverage_end") - F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("coverage_end")).alias("coverage_end"),
    )


@query("funding_coverage", "SELECT symbol, coverage_start, coverage_end, n_events FROM coverage", ("coverage",))
def funding_coverage(spark, sf):
    return intervals.coverage_islands(V.funding_events(spark, sf))


@query("events_outside_coverage", f"""WITH c AS ({_CLAIMED_SQL}) SELECT symbol, timestamp, trade_id FROM ticks t WHERE NOT EXISTS (
  SELECT 1 FROM c WHERE c.symbol = t.symbol AND t.timestamp BETWEEN coverage_start AND coverage_end)""", ("coverage",))
def events_outside_coverage(spark, sf):
    return intervals.outside_intervals(V.ticks(spark, sf).select("symbol", "timestamp", "trade_id"), claimed_coverage(spark, sf))


@query("funding_findings", f"""WITH c AS ({_CLAIMED_SQL}), e AS (SELECT symbol, timestamp, trade_id, (px - 50) / 4000 AS rate, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp, trade_id) AS before FROM ticks),
  spans AS (SELECT symbol, min(timestamp) AS s, max(timestamp) AS e FROM ticks GROUP BY symbol), claims AS (SELECT symbol, min(coverage_start) AS cs, max(coverage_end) AS ce FROM c GROUP BY symbol)
  SELECT 'error' AS severity, 'DUPLICATE_KEY' AS code, symbol, timestamp, count(*)::BIGINT AS n FROM e GROUP BY symbol, timestamp HAVING count(*) > 1
  UNION ALL SELECT 'warning', 'IMPLAUSIBLE_RATE', symbol, timestamp, 1 FROM e WHERE abs(rate) >= 0.01
  UNION ALL SELECT 'error', 'FUNDING_GAP_EXCEEDED', symbol, timestamp, 1 FROM e WHERE timestamp - before > INTERVAL 90 MINUTE
  UNION ALL SELECT 'error', 'COVERAGE_NOT_DISJOINT', symbol, coverage_start, 1 FROM (SELECT *, lag(coverage_end) OVER (PARTITION BY symbol ORDER BY coverage_start, coverage_end) AS p FROM c) WHERE coverage_start <= p
  UNION ALL SELECT 'error', 'FALSE_COVERAGE', symbol, cs, 1 FROM spans JOIN claims USING (symbol) WHERE cs < s OR ce > e
  UNION ALL SELECT 'error', 'EVENT_OUTSIDE_COVERAGE', symbol, timestamp, 1 FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.symbol = e.symbol AND e.timestamp BETWEEN coverage_start AND coverage_end)""", ("coverage",))
def funding_findings(spark, sf):
    f = V.ticks(spark, sf).select("symbol", "timestamp", "trade_id", ((F.col("px") - 50) / 4000).alias("funding_rate"))
    return quality.validate_funding(f, "trade_id", claimed_coverage(spark, sf))


_GAPS = """WITH c AS (""" + _CLAIMED_SQL + """), i AS (SELECT c.symbol, coverage_start, coverage_end, timestamp, timestamp - lag(timestamp) OVER (PARTITION BY c.symbol, coverage_start, coverage_end ORDER BY timestamp, trade_id) AS gap
  FROM c JOIN ticks t ON t.symbol = c.symbol AND t.timestamp BETWEEN coverage_start AND coverage_end),
  m AS (SELECT symbol, coverage_start, coverage_end, first(gap ORDER BY n DESC, gap) AS modal FROM (SELECT symbol, coverage_start, coverage_end, gap, count(*) AS n FROM i WHERE gap IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  s AS (SELECT symbol, coverage_start, coverage_end, count(*) AS n_events, max(gap) AS inner_gap, min(timestamp) AS first_t, max(timestamp) AS last_t FROM i GROUP BY ALL)"""
_US = "epoch_us({b}) - epoch_us({a})"


@query("funding_gap_checks", _GAPS + """ SELECT *, max_gap_us > 5400000000 AS gap_exceeded, coalesce(modal_gap_us < 2700000000, false) AS tolerance_suspicious FROM (
  SELECT c.symbol, c.coverage_start, c.coverage_end, coalesce(n_events, 0) AS n_events,
  greatest(coalesce((extract(epoch FROM inner_gap) * 1000000)::BIGINT, 0), coalesce(epoch_us(first_t) - epoch_us(c.coverage_start), epoch_us(c.coverage_end) - epoch_us(c.coverage_start)), coalesce(epoch_us(c.coverage_end) - epoch_us(last_t), 0)) AS max_gap_us,
  (extract(epoch FROM modal) * 1000000)::BIGINT AS modal_gap_us FROM c LEFT JOIN s USING (symbol, coverage_start, coverage_end) LEFT JOIN m USING (symbol, coverage_start, coverage_end))""", ("coverage",))
def funding_gap_checks(spark, sf):
    return intervals.coverage_checks(V.ticks(spark, sf).select("symbol", "timestamp", "trade_id"), claimed_coverage(spark, sf), tie="trade_id")


@query("period_coverage", f"""WITH c AS ({_CLAIMED_SQL}) SELECT b.symbol, b.timestamp AS period_start, b.timestamp + INTERVAL 1 HOUR AS period_end, count(c.symbol) AS n_records
  FROM bars_1h b LEFT JOIN c ON c.symbol = b.symbol AND coverage_start <= b.timestamp AND b.timestamp + INTERVAL 1 HOUR <= coverage_end GROUP BY b.symbol, b.timestamp""", ("coverage", "bars_1h"))
def period_coverage(spark, sf):
    p = V.bars_1h(spark, sf).select("symbol", F.col("timestamp").alias("period_start"), (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("period_end"))
    return intervals.single_cover(p, claimed_coverage(spark, sf))


# --- as-of prices ----------------------------------------------------------------------------------------------

_ASOF = """SELECT e.symbol, e.timestamp, e.trade_id, CASE WHEN e.timestamp - q.timestamp <= INTERVAL {m} MINUTE THEN q.px END AS oracle_price,
  CASE WHEN e.timestamp - q.timestamp <= INTERVAL {m} MINUTE THEN q.timestamp END AS quote_time
  FROM (SELECT * FROM ticks WHERE venue = 'B') e ASOF LEFT JOIN (SELECT * FROM ticks WHERE venue = 'A') q ON e.symbol = q.symbol AND e.timestamp >= q.timestamp"""


def _sides(spark, sf):
    t = V.ticks(spark, sf)
    events = t.where("venue = 'B'").select("symbol", "timestamp", "trade_id")
    return events, t.where("venue = 'A'").select("symbol", "timestamp", F.col("px").alias("oracle_px"), F.col("trade_id").alias("quote_id"))


@query("asof_oracle_price", _ASOF.format(m=30), ("ticks",))
def asof_oracle_price(spark, sf):
    """Tolerance of half an hour, so that the sparse sample has priced and unpriced events."""
    events, quotes = _sides(spark, sf)
    return asof.asof_price(events, quotes, tolerance_us=30 * MINUTE_US, sequence="quote_id")


@query("asof_oracle_price_2min", _ASOF.format(m=2), ("ticks",))
def asof_oracle_price_2min(spark, sf):
    events, quotes = _sides(spark, sf)
    return asof.asof_price(events, quotes, sequence="quote_id")


_INCREMENT = "CASE WHEN timestamp < TIMESTAMP '2024-01-10' THEN 0 WHEN timestamp < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END"


@query("asof_incremental_equals_full", _ASOF.format(m=30), ("ticks",))
def asof_incremental_equals_full(spark, sf):
    """Three increments that hand on the quotes an event may still need; every ninth event comes an increment after its
    quotes, behind the newest quote. The result is that of one run."""
    parts, _ = _increments(spark, sf, lateness_us=12 * DAY_US)
    return parts


@query("asof_incremental_late", f"""SELECT symbol, timestamp, trade_id FROM (SELECT *, {_INCREMENT} AS i FROM ticks WHERE venue = 'B') e WHERE trade_id % 9 = 0 AND i < 2
  AND timestamp + INTERVAL 6 DAY < (SELECT max(timestamp) FROM ticks q WHERE q.venue = 'A' AND q.symbol = e.symbol AND {_INCREMENT.replace('timestamp', 'q.timestamp')} <= e.i)""", ("ticks",))
def asof_incremental_late(spark, sf):
    """The events that come more than six days behind the newest quote of their symbol."""
    _, late = _increments(spark, sf, lateness_us=6 * DAY_US)
    return late


def _increments(spark, sf, lateness_us):
    events, quotes = _sides(spark, sf)
    number = F.when(F.col("timestamp") < F.lit("2024-01-10").cast("timestamp_ntz"), 0).when(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz"), 1).otherwise(2)
    comes = F.when(F.col("trade_id") % 9 == 0, F.least(number + 1, F.lit(2))).otherwise(number)
    priced, late, carry = None, None, None
    for i in range(3):
        done, carry, behind = asof.incremental_asof(events.where(comes == i), quotes.where(number == i), carry, tolerance_us=30 * MINUTE_US, sequence="quote_id", lateness_us=lateness_us)
        carry = cut_lineage(carry, "asof-carry")
        priced, late = (done, behind) if priced is None else (priced.unionByName(done), late.unionByName(behind))
    return priced, late


_PERCENTS = [1, 5, 25, 50, 75, 95, 99]


@query("alignment_report", "WITH p AS (" + _ASOF.format(m=30) + "), o AS (SELECT (epoch_us(timestamp) - epoch_us(quote_time)) / 1e6::DOUBLE AS s FROM p WHERE quote_time IS NOT NULL) SELECT "
       + ", ".join(f"round((SELECT quantile_cont(s, {p / 100}::DOUBLE) FROM o), 6) AS offset_p{p}" for p in _PERCENTS)
       + ", round((SELECT max(s) FROM o), 6) AS max_offset, count(*) AS n_events, count(oracle_price) AS n_priced, count(*) - count(oracle_price) AS n_unpriced FROM p", ("ticks",))
def alignment_report(spark, sf):
    """Priced and unpriced events and the exact distribution of the offsets. The offsets are one group of any size,
    so the percentiles are found without gathering it."""
    events, quotes = _sides(spark, sf)
    priced = cut_lineage(asof.asof_price(events, quotes, tolerance_us=30 * MINUTE_US, sequence="quote_id"), "priced")
    seconds = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("quote_time").cast("timestamp"))) / 1e6
    offsets = priced.where("quote_time is not null").select(seconds.alias("s"))
    found = exact_percentiles(offsets, [], "s", [*_PERCENTS, 100])
    named = [F.round(F.max(F.when(F.col("percent") == p, F.col("value"))), 6).alias(f"offset_p{p}" if p < 100 else "max_offset") for p in [*_PERCENTS, 100]]
    counts = asof.alignment_counts(events, priced.select("symbol", "timestamp", "trade_id", "oracle_price"), ["symbol", "timestamp", "trade_id"])
    packed = counts.select(F.struct("*").alias("c")).scalar()
    return found.agg(*named).withColumn("_c", packed).select("*", "_c.*").drop("_c")


# --- digests -----------------------------------------------------------------------------------------------------

_LANE = "sum(('0x' || substr(h, {p}, 15))::BIGINT::HUGEINT)"
_DIGEST = """SELECT {g}, count(*) AS n_rows, sha256(concat_ws(':', count(*)::VARCHAR, """ + ", ".join(_LANE.format(p=1 + 15 * i) + "::VARCHAR" for i in range(4)) + """)) AS digest
  FROM (SELECT {g}, sha256(concat_ws(chr(31), {cols})) AS h FROM ({src})) GROUP BY {g}"""


@query("table_digest", _DIGEST.format(g="symbol, day", cols="close_c::VARCHAR, epoch_s::VARCHAR, open_c::VARCHAR, trade_count::VARCHAR",
       src="SELECT symbol, date_trunc('day', timestamp)::DATE AS day, (close * 100)::BIGINT AS close_c, epoch(timestamp)::BIGINT AS epoch_s, (open * 100)::BIGINT AS open_c, trade_count FROM bars_1h"), ("bars_1h",))
def table_digest_by_day(spark, sf):
    """Digest per symbol and day; prices as whole cents, so that both engines write the same text."""
    b = V.bars_1h(spark, sf).select(
        "symbol", F.to_date("timestamp").alias("day"), F.round(F.col("close") * 100).cast("bigint").alias("close_c"), F.round(F.col("open") * 100).cast("bigint").alias("open_c"),
        F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("epoch_s"), "trade_count")
    return table_digest(b, ["close_c", "open_c", "epoch_s", "trade_count"], ["symbol", "day"])


_VERSIONS = """bb AS (SELECT symbol, timestamp::DATE AS day, hour(timestamp)::INT AS hour, close FROM bars_1h), nn AS (SELECT symbol, day, hour, CASE WHEN day = DATE '2024-01-07' AND symbol = 'click' AND hour >= 12 THEN close + 1 ELSE close END AS close FROM bb WHERE NOT (symbol = 'view' AND day = DATE '2024-01-09')
  UNION ALL SELECT symbol, DATE '2025-01-01', hour, close FROM bb WHERE symbol = 'error' AND day = DATE '2024-01-02')"""


@query("digest_diff", f"""WITH {_VERSIONS}, o AS (SELECT DISTINCT symbol, day, hour // 6 AS block FROM bb), n AS (SELECT DISTINCT symbol, day, hour // 6 AS block FROM nn)
  SELECT symbol, day, block, CASE WHEN o.symbol IS NOT NULL AND n.symbol IS NOT NULL THEN 'changed' WHEN o.symbol IS NULL THEN 'added' ELSE 'removed' END AS change FROM o FULL JOIN n USING (symbol, day, block)
  WHERE o.symbol IS NULL OR n.symbol IS NULL OR EXISTS (SELECT 1 FROM bb JOIN nn USING (symbol, day, hour) WHERE bb.symbol = o.symbol AND bb.day = o.day AND bb.hour // 6 = o.block AND bb.close <> nn.close)""".replace(
    "SELECT symbol, day, block, CASE", "SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.day, n.day) AS day, coalesce(o.block, n.block) AS block, CASE").replace("FULL JOIN n USING (symbol, day, block)", "FULL JOIN n ON n.symbol = o.symbol AND n.day = o.day AND n.block = o.block"), ("bars_1h",))
def digest_diff(spark, sf):
    """Two versions of the bars: a changed half day, a day that is gone and a day that is new, found from the top of a tree of
    digests (dataset, symbol, day, quarter of a day)."""
    b = V.bars_1h(spark, sf).select("symbol", F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour"), "close").withColumn("block", F.floor(F.col("hour") / 6).cast("int"))
    b = cut_lineage(b, "version")
    day = lambda t: F.lit(t).cast("date")
    moved = (F.col("day") == day("2024-01-07")) & (F.col("symbol") == "click") & (F.col("hour") >= 12)
    n = b.withColumn("close", F.when(moved, F.col("close") + 1).otherwise(F.col("close"))).where((F.col("symbol") != "view") | (F.col("day") != day("2024-01-09")))
    n = n.unionByName(b.where((F.col("symbol") == "error") & (F.col("day") == day("2024-01-02"))).withColumn("day", day("2025-01-01")))
    levels = ["symbol", "day", "block"]
    trees = [[cut_lineage(t, "digests") for t in digest_tree(v, ["hour", "close"], levels)] for v in (b, n)]
    return digests.digest_diff(*trees, levels)


@query("snapshot_manifest", _DIGEST.format(g="symbol", cols="px_c::VARCHAR, trade_id::VARCHAR", src="SELECT symbol, (px * 100)::BIGINT AS px_c, trade_id FROM ticks WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"), ("ticks",))
def snapshot_manifest(spark, sf):
    """Row count and digest per symbol of a closed time slice, as a sealed snapshot lists them."""
    from tapeledger.sources.snapshots import closed_slice, manifest

    t = closed_slice(V.ticks(spark, sf), "2024-01-05", "2024-01-25")
    return manifest(t.select("symbol", F.round(F.col("px") * 100).cast("bigint").alias("px_c"), "trade_id"), ["px_c", "trade_id"], ["symbol"])
