"""Queries that compare two venues, and the accreting archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.operators import accrete, compare, quality, signals
from tapeledger.operators.bars import BAR_VALUES
from tapeledger.plans import views as V
from tapeledger.plans.registry import query

_R = 9


def _rounded(df, names, digits=_R):
    return df.withColumns({c: F.round(c, digits) for c in names})


def pairs(spark, sf):
    return compare.overlap(V.venue_bars(spark, sf, "A"), V.venue_bars(spark, sf, "B"))


_STATS = """SELECT symbol, count(*) AS n_overlapping_bars, count(a_ret) AS n_returns, round(CASE WHEN count(a_ret) >= 2 THEN corr(a_ret, b_ret) END, 9) AS return_correlation,
  round(avg(abs(b_ret - a_ret)), 9) AS mean_abs_return_diff, round(stddev_samp(a_ret), 9) AS a_volatility, round(stddev_samp(b_ret), 9) AS b_volatility,
  round(stddev_samp(b_ret) / nullif(stddev_samp(a_ret), 0), 9) AS volatility_ratio FROM {src} GROUP BY symbol"""
_STAT_COLS = ["return_correlation", "mean_abs_return_diff", "a_volatility", "b_volatility", "volatility_ratio"]
_RETURNS = """SELECT *, a_close / nullif(lag(a_close) OVER w, 0) - 1 AS a_ret, b_close / nullif(lag(b_close) OVER w, 0) - 1 AS b_ret FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)"""


@query("crossvenue_stats", _STATS.format(src="returns_ab"), ("returns_ab",))
def crossvenue_stats(spark, sf):
    return _rounded(compare.return_statistics(pairs(spark, sf)), _STAT_COLS)


_PCT = [1, 5, 25, 50, 75, 95, 99]
_PCT_LIST = "unnest([" + ", ".join(map(str, _PCT)) + "]) AS percent, unnest(quantile_cont({x}, [" + ", ".join(f"{p / 100}::DOUBLE" for p in _PCT) + "])) AS value"


@query("return_diff_percentiles", "SELECT symbol, percent, round(value, 9) AS value FROM (SELECT symbol, " + _PCT_LIST.format(x="abs(b_ret - a_ret)") + " FROM returns_ab WHERE a_ret IS NOT NULL GROUP BY symbol)", ("returns_ab",))
def return_diff_percentiles(spark, sf):
    return _rounded(compare.return_diff_percentiles(pairs(spark, sf)), ["value"])


_DIFFS = " UNION ALL ".join(f"SELECT symbol, timestamp, '{c}' AS field, abs(b_{c} - a_{c}) / nullif(abs(a_{c}), 0) AS relative_diff FROM overlap_ab" for c in ("open", "high", "low", "close"))


@query("ohlc_rel_diff", f"SELECT symbol, field, percent, round(value, 9) AS value FROM (SELECT symbol, field, {_PCT_LIST.format(x='relative_diff')} FROM ({_DIFFS}) GROUP BY symbol, field)", ("overlap_ab",))
def ohlc_rel_diff(spark, sf):
    return _rounded(compare.field_difference_percentiles(pairs(spark, sf)), ["value"])


@query("large_discrepancies", f"SELECT symbol, timestamp, field, round(relative_diff, 9) AS relative_diff FROM ({_DIFFS}) WHERE relative_diff > 0.05", ("overlap_ab",))
def large_discrepancies(spark, sf):
    return _rounded(compare.large_differences(pairs(spark, sf)), ["relative_diff"])


@query("first_discrepancies", f"SELECT symbol, timestamp, field, round(relative_diff, 9) AS relative_diff FROM ({_DIFFS}) WHERE relative_diff > 0.05 ORDER BY timestamp, symbol, field LIMIT 10", ("overlap_ab",))
def first_discrepancies(spark, sf):
    """The ten earliest large differences, as the report lists them."""
    return _rounded(compare.large_differences(pairs(spark, sf)).orderBy("timestamp", "symbol", "field").limit(10), ["relative_diff"])


@query("unit_ratio_check", """SELECT symbol, round(m, 9) AS median_ratio, m > 0.5 AND m < 2.0 AS within_bounds FROM (SELECT symbol, quantile_cont(b_close / nullif(a_close, 0), 0.5::DOUBLE) AS m FROM overlap_ab GROUP BY symbol)""", ("overlap_ab",))
def unit_ratio_check(spark, sf):
    return _rounded(compare.unit_ratio_check(pairs(spark, sf)), ["median_ratio"])


_LISTED = "SELECT symbol, min(timestamp) + INTERVAL 10 DAY AS l FROM bars_1h_venue GROUP BY symbol"


@query("crossvenue_around_listing", f"WITH near AS (SELECT o.* FROM overlap_ab o JOIN ({_LISTED}) l ON l.symbol = o.symbol WHERE o.timestamp BETWEEN l - INTERVAL 3 DAY AND l + INTERVAL 3 DAY), r AS ("
       + _RETURNS.format(src="near") + ") " + _STATS.format(src="r"), ("overlap_ab",))
def crossvenue_around_listing(spark, sf):
    listing = V.bars_1h_venue(spark, sf).groupBy("symbol").agg((F.min("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("listing_timestamp"))
    return _rounded(compare.return_statistics(compare.around_listing(pairs(spark, sf), listing)), _STAT_COLS)


@query("crossvenue_high_vol", """WITH v AS (SELECT *, CASE WHEN count(a_ret) OVER f = 20 THEN stddev_samp(a_ret) OVER f END AS vol FROM returns_ab WINDOW f AS (PARTITION BY symbol ORDER BY timestamp ROWS 19 PRECEDING)),
  c AS (SELECT symbol, quantile_cont(vol, 0.9::DOUBLE) AS cut FROM v GROUP BY symbol), k AS (SELECT v.* EXCLUDE (a_ret, b_ret, vol) FROM v JOIN c USING (symbol) WHERE vol >= cut), r AS ("""
       + _RETURNS.format(src="k") + ") " + _STATS.format(src="r"), ("returns_ab",))
def crossvenue_high_vol(spark, sf):
    return _rounded(compare.return_statistics(compare.high_volatility(pairs(spark, sf))), _STAT_COLS)


_LAGGED = """WITH la AS (SELECT symbol, timestamp, l - lag(l) OVER w AS ra FROM (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS l FROM bars_1h_venue WHERE venue = 'A') WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
  lb AS (SELECT symbol, timestamp, l - lag(l) OVER w AS rb FROM (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS l FROM bars_1h_venue WHERE venue = 'B') WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
  al AS (SELECT la.symbol, la.timestamp, ra, rb FROM la JOIN lb ON la.symbol = lb.symbol AND la.timestamp = lb.timestamp WHERE ra IS NOT NULL AND rb IS NOT NULL),
  sh AS (SELECT symbol, ra, lag(rb, 2) OVER w AS p2, lag(rb, 1) OVER w AS p1, rb AS z, lead(rb, 1) OVER w AS m1, lead(rb, 2) OVER w AS m2 FROM al WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
  rho AS (SELECT symbol, -2 AS lag, corr(ra, m2) AS rho FROM sh GROUP BY symbol UNION ALL SELECT symbol, -1, corr(ra, m1) FROM sh GROUP BY symbol UNION ALL SELECT symbol, 0, corr(ra, z) FROM sh GROUP BY symbol
  UNION ALL SELECT symbol, 1, corr(ra, p1) FROM sh GROUP BY symbol UNION ALL SELECT symbol, 2, corr(ra, p2) FROM sh GROUP BY symbol)"""


def _rho(spark, sf):
    return compare.lagged_correlation(V.venue_bars(spark, sf, "A"), V.venue_bars(spark, sf, "B"))


@query("lagged_corr", _LAGGED + " SELECT symbol, lag, round(rho, 9) AS rho FROM rho", ("bars_1h_venue",))
def lagged_corr(spark, sf):
    return _rounded(_rho(spark, sf), ["rho"])


@query("alignment_test", _LAGGED + """ SELECT symbol, first(lag ORDER BY rho DESC, lag) AS argmax_lag, round(max(rho) FILTER (WHERE lag = 0), 9) AS rho_0, first(lag ORDER BY rho DESC, lag) = 0 AS passes_argmax,
  max(rho) FILTER (WHERE lag = 0) >= 0.99 AS passes_rho0 FROM rho GROUP BY symbol""", ("bars_1h_venue",))
def alignment_test(spark, sf):
    return _rounded(compare.alignment_test(_rho(spark, sf)), ["rho_0"])


_SIG = """SELECT venue, symbol, timestamp, close, sma, CASE WHEN close > sma THEN 1 ELSE 0 END AS signal FROM (SELECT *, avg(close) OVER f AS sma, count(*) OVER f AS n FROM bars_1h_venue
  WINDOW f AS (PARTITION BY venue, symbol ORDER BY timestamp ROWS 9 PRECEDING)) WHERE n = 10"""
_BOTH_SIG = f"""WITH s AS ({_SIG}), j AS (SELECT a.symbol, a.timestamp, a.close AS a_close, a.sma AS a_sma, a.signal AS sa, b.close AS b_close, b.sma AS b_sma, b.signal AS sb
  FROM s a JOIN s b ON a.symbol = b.symbol AND a.timestamp = b.timestamp WHERE a.venue = 'A' AND b.venue = 'B')"""


def _signals(spark, sf):
    return [signals.sma_signal(V.venue_bars(spark, sf, v), 10) for v in "AB"]


@query("signal_agreement", _BOTH_SIG + """ SELECT symbol, count(*) AS n_bars, round(avg((sa = sb)::INT), 9) AS agreement_rate, count(*) FILTER (WHERE sa <> sb) AS n_differing,
  count(*) FILTER (WHERE da = 1) AS a_entries, count(*) FILTER (WHERE da = -1) AS a_exits, count(*) FILTER (WHERE db = 1) AS b_entries, count(*) FILTER (WHERE db = -1) AS b_exits
  FROM (SELECT *, sa - lag(sa) OVER w AS da, sb - lag(sb) OVER w AS db FROM j WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) GROUP BY symbol""", ("bars_1h_venue",))
def signal_agreement(spark, sf):
    return _rounded(compare.signal_agreement(*_signals(spark, sf)), ["agreement_rate"])


@query("signal_differences", _BOTH_SIG + """ SELECT symbol, timestamp, sa AS a_signal, sb AS b_signal, round(abs(a_close - a_sma) / a_sma, 8) AS a_margin, round(abs(b_close - b_sma) / b_sma, 8) AS b_margin FROM j WHERE sa <> sb""", ("bars_1h_venue",))
def signal_differences(spark, sf):
    d = compare.signal_differences(*_signals(spark, sf))
    return _rounded(d.select("symbol", "timestamp", F.col("a_signal").cast("int").alias("a_signal"), F.col("b_signal").cast("int").alias("b_signal"), "a_margin", "b_margin"), ["a_margin", "b_margin"], 8)


@query("overlap_report", """SELECT coalesce(a.symbol, b.symbol) AS symbol, count(*) FILTER (WHERE a.symbol IS NOT NULL AND b.symbol IS NOT NULL) AS n_overlapping_bars, count(*) FILTER (WHERE a.symbol IS NULL) AS missing_in_reconstruction,
  count(*) FILTER (WHERE b.symbol IS NULL) AS missing_in_official, """ + ", ".join(f"round(quantile_cont(a.volume / nullif(b.volume, 0), {p / 100}::DOUBLE), 9) AS volume_ratio_p{p}" for p in _PCT) + """
  FROM (SELECT * FROM bars_1h_venue WHERE venue = 'A') a FULL JOIN (SELECT * FROM bars_1h_venue WHERE venue = 'B') b ON a.symbol = b.symbol AND a.timestamp = b.timestamp GROUP BY 1""", ("bars_1h_venue",))
def overlap_report(spark, sf):
    return _rounded(compare.overlap_report(V.venue_bars(spark, sf, "A"), V.venue_bars(spark, sf, "B")), [f"volume_ratio_p{p}" for p in _PCT])


# --- symbol map ----------------------------------------------------------------------------------------------------

_MAP = """SELECT p_brand AS symbol, CASE WHEN b % 6 <> 0 THEN max(p_type) END AS venue_symbol, CASE WHEN b % 6 <> 0 AND b % 10 <> 3 THEN CASE WHEN b % 4 = 1 THEN 1000 ELSE b % 7 END END AS own_unit_multiplier,
  CASE WHEN b % 6 <> 0 THEN 1 WHEN b % 12 = 0 THEN 1 END AS venue_unit_multiplier, CASE WHEN b % 5 <> 2 AND b % 6 <> 0 THEN 'doc' END AS verified_by,
  CASE WHEN b % 6 <> 0 THEN 'mapped' ELSE 'unmatched' END AS status, CASE WHEN b % 18 = 0 THEN 'not listed' END AS reason
  FROM (SELECT *, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS b FROM part) GROUP BY p_brand, b"""


def symbol_map(spark, sf):
    """A map from brands, with gaps that break each of its rules."""
    p = V.table(spark, sf, "part").withColumn("b", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"))
    b, mapped = F.col("b"), F.col("b") % 6 != 0
    return p.groupBy("p_brand", "b").agg(F.max("p_type").alias("_t")).select(
        F.col("p_brand").alias("symbol"), F.when(mapped, F.col("_t")).alias("venue_symbol"),
        F.when(mapped & (b % 10 != 3), F.when(b % 4 == 1, 1000).otherwise(b % 7)).alias("own_unit_multiplier"), F.when(mapped | (b % 12 == 0), 1).alias("venue_unit_multiplier"),
        F.when((b % 5 != 2) & mapped, "doc").alias("verified_by"), F.when(mapped, "mapped").otherwise("unmatched").alias("status"), F.when(b % 18 == 0, "not listed").alias("reason"))


@query("symbol_map_findings", f"""WITH m AS ({_MAP}) SELECT symbol, unnest(list_filter([CASE WHEN status = 'mapped' AND (own_unit_multiplier IS NULL OR venue_unit_multiplier IS NULL) THEN 'MISSING_MULTIPLIER' END,
  CASE WHEN status = 'mapped' AND (own_unit_multiplier < 1 OR venue_unit_multiplier < 1) THEN 'NON_POSITIVE_MULTIPLIER' END, CASE WHEN status = 'mapped' AND verified_by IS NULL THEN 'UNVERIFIED_MAPPING' END,
  CASE WHEN status = 'unmatched' AND venue_unit_multiplier IS NOT NULL THEN 'UNMATCHED_WITH_MULTIPLIER' END, CASE WHEN status = 'unmatched' AND reason IS NULL THEN 'UNMATCHED_WITHOUT_REASON' END], lambda x: x IS NOT NULL)) AS code FROM m""")
def symbol_map_findings(spark, sf):
    return quality.symbol_map_findings(symbol_map(spark, sf))


@query("symbol_map_lookup", f"""WITH m AS ({_MAP}), p AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'Brand#x' ELSE p_brand END AS symbol FROM part)
  SELECT p.p_partkey, p.symbol, m.venue_symbol, m.status FROM p LEFT JOIN m ON p.symbol = m.symbol""")
def symbol_map_lookup(spark, sf):
    """Every part looked up; brands the map does not know stay without a venue symbol."""
    p = V.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 45, "Brand#x").otherwise(F.col("p_brand")).alias("symbol"))
    return compare.map_symbols(p, symbol_map(spark, sf)).select("p_partkey", "symbol", "venue_symbol", "status")


@query("unit_normalised_prices", """SELECT symbol, timestamp, """ + ", ".join(f"round({c} / CASE WHEN symbol LIKE 'v%' THEN 1000 ELSE 1 END, 9) AS {c}" for c in ("open", "high", "low", "close")) + " FROM bars_1h", ("bars_1h",))
def unit_normalised_prices(spark, sf):
    mapping = V.bars_1h(spark, sf).select("symbol").distinct().withColumn("own_unit_multiplier", F.when(F.startswith("symbol", F.lit("v")), 1000).otherwise(1))
    b = compare.normalise_units(compare.map_symbols(V.bars_1h(spark, sf), mapping), F.col("own_unit_multiplier"))
    return _rounded(b.select("symbol", "timestamp", *compare.FIELDS), compare.FIELDS)


# --- archive ---------------------------------------------------------------------------------------------------------

# Stored and fetched bars: the archive ends on the 20th; the fetch starts on the 10th and disagrees here and there.
_STORED = "SELECT * FROM bars_1h WHERE timestamp < TIMESTAMP '2024-01-20'"
_FETCHED = """SELECT symbol, timestamp, open, high, low, CASE WHEN close BETWEEN 30 AND 35 THEN close + 1 ELSE close END AS close, CASE WHEN close BETWEEN 50 AND 52 THEN 0.0::DOUBLE ELSE volume END AS volume,
  CASE WHEN close BETWEEN 50 AND 52 THEN 0 ELSE trade_count END AS trade_count, close NOT BETWEEN 50 AND 52 AND native_traded AS native_traded FROM bars_1h WHERE timestamp >= TIMESTAMP '2024-01-10'"""
_DIFFER = " OR ".join(f"s.{c} IS DISTINCT FROM f.{c}" for c in BAR_VALUES)


def stored_bars(spark, sf):
    return V.bars_1h(spark, sf).where(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz"))


def fetched_bars(spark, sf):
    b = V.bars_1h(spark, sf).where(F.col("timestamp") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    gone = F.col("close").between(50, 52)
    return b.select(
        "symbol", "timestamp", "open", "high", "low", F.when(F.col("close").between(30, 35), F.col("close") + 1).otherwise(F.col("close")).alias("close"), F.when(gone, 0.0).otherwise(F.col("volume")).alias("volume"),
        F.when(gone, 0).otherwise(F.col("trade_count")).cast("bigint").alias("trade_count"), (~gone & F.col("native_traded")).alias("native_traded"))


_UNION = f"WITH s AS ({_STORED}), f AS ({_FETCHED}), u AS (SELECT * FROM s UNION ALL SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol = f.symbol AND s.timestamp = f.timestamp))"


@query("accrete_union", _UNION.replace("SELECT f.* FROM f", "SELECT f.symbol, f.timestamp, f.open, f.high, f.low, f.close, f.volume, f.trade_count, f.native_traded FROM f") + " SELECT * FROM u", ("bars_1h",))
def accrete_union(spark, sf):
    return accrete.accrete(stored_bars(spark, sf), fetched_bars(spark, sf))


@query("accrete_conflicts", f"WITH s AS ({_STORED}), f AS ({_FETCHED}) SELECT s.symbol, s.timestamp, s.close AS old_close, f.close AS new_close FROM s JOIN f ON s.symbol = f.symbol AND s.timestamp = f.timestamp WHERE {_DIFFER}", ("bars_1h",))
def accrete_conflicts(spark, sf):
    c = accrete.conflicts(stored_bars(spark, sf), fetched_bars(spark, sf))
    return c.select("symbol", "timestamp", F.col("old.close").alias("old_close"), F.col("new.close").alias("new_close"))


@query("accrete_guard", _UNION + """ SELECT a.symbol, stored_rows, stored_start, union_rows, union_start, union_rows < stored_rows OR union_start > stored_start AS regression
  FROM (SELECT symbol, count(*) AS stored_rows, min(timestamp) AS stored_start FROM s GROUP BY symbol) a JOIN (SELECT symbol, count(*) AS union_rows, min(timestamp) AS union_start FROM u GROUP BY symbol) b USING (symbol)""", ("bars_1h",))
def accrete_guard(spark, sf):
    s = stored_bars(spark, sf)
    return accrete.regression_guard(s, accrete.accrete(s, fetched_bars(spark, sf)))


@query("refresh_noop", _UNION + """ SELECT symbol, (SELECT count(*) FROM u WHERE u.symbol = k.symbol) AS n_rows, (SELECT count(*) FROM u WHERE u.symbol = k.symbol) <> (SELECT count(*) FROM s WHERE s.symbol = k.symbol) AS needs_write
  FROM (SELECT DISTINCT symbol FROM u) k""", ("bars_1h",))
def refresh_noop(spark, sf):
    """Symbols whose stored rows change by the refresh; accretion only ever adds rows."""
    s = stored_bars(spark, sf)
    return accrete.changed_symbols(s, accrete.accrete(s, fetched_bars(spark, sf)), s.columns)


@query("refresh_window", f"WITH s AS ({_STORED}) SELECT symbol, max(timestamp) AS last_bar, max(timestamp) - INTERVAL 3 HOUR AS fetch_start FROM s GROUP BY symbol", ("bars_1h",))
def refresh_window(spark, sf):
    return accrete.refresh_window(stored_bars(spark, sf))


_ACTIONS = f"""WITH s AS ({_STORED}), f AS (SELECT * FROM ({_FETCHED}) WHERE timestamp + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-18 12:00:00'),
  a AS (SELECT s.symbol, s.timestamp, s.close AS old_close, f.close AS new_close, CASE WHEN f.symbol IS NULL OR NOT ({_DIFFER}) THEN 'KEEP' WHEN NOT (s.volume = 0 AND s.trade_count = 0) AND f.volume = 0 AND f.trade_count = 0 THEN 'REFUSE' ELSE 'REPLACE' END AS action
  FROM s LEFT JOIN f ON s.symbol = f.symbol AND s.timestamp = f.timestamp)"""


@query("reconcile_actions", _ACTIONS + " SELECT symbol, timestamp, action FROM a", ("bars_1h",))
def reconcile_actions(spark, sf):
    now = F.lit("2024-01-18 12:00:00").cast("timestamp_ntz")
    return accrete.reconcile_actions(stored_bars(spark, sf), fetched_bars(spark, sf), now).select("symbol", "timestamp", "action")


@query("reconciled_bars", _ACTIONS + " SELECT symbol, timestamp, CASE WHEN action = 'REPLACE' THEN new_close ELSE old_close END AS close FROM a", ("bars_1h",))
def reconciled_bars(spark, sf):
    now = F.lit("2024-01-18 12:00:00").cast("timestamp_ntz")
    s = stored_bars(spark, sf)
    return accrete.apply_reconciliation(s, accrete.reconcile_actions(s, fetched_bars(spark, sf), now)).select("symbol", "timestamp", "close")


@query("ingest_summary", _UNION + """, o AS (SELECT symbol, count(*) AS n_rows, min(timestamp) AS s, max(timestamp) AS e, (SELECT count(*) FROM s JOIN f ON s.symbol = f.symbol AND s.timestamp = f.timestamp WHERE s.symbol = u.symbol AND (""" + _DIFFER + """)) AS conflicts FROM u GROUP BY symbol)
  SELECT symbol, count(*) FILTER (WHERE n_rows >= 600) AS n_ok, count(*) FILTER (WHERE n_rows < 600) AS n_failed, sum(n_rows)::BIGINT AS n_rows, sum(conflicts)::BIGINT AS conflicts, min(s) AS start_timestamp, max(e) AS end_timestamp FROM o GROUP BY ROLLUP (symbol)""", ("bars_1h",))
def ingest_summary(spark, sf):
    s, f = stored_bars(spark, sf), fetched_bars(spark, sf)
    per = accrete.accrete(s, f).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"))
    clashes = accrete.conflicts(s, f).groupBy("symbol").agg(F.count(F.lit(1)).alias("conflicts"))
    outcomes = per.join(clashes, on="symbol", how="left").withColumns({"conflicts": F.coalesce("conflicts", F.lit(0)), "ok": F.col("n_rows") >= 600})
    return accrete.ingest_summary(outcomes)


@query("overlap_field_percentiles", " UNION ALL ".join(f"""SELECT symbol, '{f}' AS field, p AS percent, count(*) AS n, round(quantile_cont(d, p / 100.0::DOUBLE), 9) AS value FROM (SELECT symbol, abs(a_{f} - b_{f}) / abs(b_{f}) AS d FROM overlap_ab WHERE b_{f} <> 0), (SELECT unnest({_PCT}) AS p) GROUP BY symbol, p"""
       for f in ("open", "high", "low", "close")).replace("quantile_cont(d, p / 100.0::DOUBLE)", "(list_sort(list(d))[1 + floor((count(*) - 1) * p / 100.0)::INT] + (list_sort(list(d))[1 + ceil((count(*) - 1) * p / 100.0)::INT] - list_sort(list(d))[1 + floor((count(*) - 1) * p / 100.0)::INT]) * ((count(*) - 1) * p / 100.0 - floor((count(*) - 1) * p / 100.0)))"), ("overlap_ab",))
def overlap_field_percentiles(spark, sf):
    """Relative differences of every price field, by symbol."""
    d = compare.overlap_differences(V.venue_bars(spark, sf, "A"), V.venue_bars(spark, sf, "B"), percents=list(_PCT))
    return d.withColumn("value", F.round("value", 9))
