"""Bars, intervals, as-of prices, quality and the accreting archive on small hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapeledger.functions.digest import table_digest
from tapeledger.functions.timegrid import DAY_US, HOUR_US
from tapeledger.operators import accrete as A
from tapeledger.operators import asof, bars, compare, intervals, quality, signals

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, trade_count bigint, native_traded boolean"


def h(n, minutes=0):
    return T0 + dt.timedelta(hours=n, minutes=minutes)


def bar(n, close=100.0, volume=10.0, count=5, symbol="X"):
    return (symbol, h(n), close, close + 1, close - 1, close, volume, count, not (volume == 0 and count == 0))


def make(spark, *items):
    return spark.createDataFrame(list(items), BAR)


# --- bars ----------------------------------------------------------------------------------------------------


def test_ticks_of_equal_time_are_ordered_by_id(spark):
    t = spark.createDataFrame([("X", h(0), 2, 11.0, 1.0), ("X", h(0), 1, 10.0, 1.0), ("X", h(0, 59), 4, 12.0, 0.0), ("X", h(0, 59), 3, 13.0, 2.0)], "symbol string, timestamp timestamp_ntz, trade_id bigint, px double, sz double")
    b = bars.ticks_to_bars(t).first()
    assert (b.open, b.high, b.low, b.close, b.volume, b.trade_count) == (10.0, 13.0, 10.0, 12.0, 4.0, 4)
    named = t.withColumn("trade_id", F.concat(F.lit("t"), F.col("trade_id").cast("string")))
    assert bars.ticks_to_bars(named).first().open == 10.0


def test_partial_bucket_is_never_emitted(spark):
    whole, hole = [bar(i, 100.0 + i) for i in range(8)], [bar(i) for i in range(8) if i != 5]
    got = rows(bars.roll_up(make(spark, *whole), 4 * HOUR_US), "timestamp")
    assert [(g[1], g[2], g[5], g[6], g[7]) for g in got] == [(h(0), 100.0, 103.0, 40.0, 20), (h(4), 104.0, 107.0, 40.0, 20)]
    assert [r.timestamp for r in bars.roll_up(make(spark, *hole), 4 * HOUR_US).collect()] == [h(0)]
    twice = hole + [bar(4)]  # a repeated bar does not stand in for the missing one
    assert bars.roll_up(make(spark, *twice), 4 * HOUR_US).count() == 1


def test_buckets_belong_to_the_epoch_grid_and_lie_inside_the_window(spark):
    b = make(spark, *[bar(i) for i in range(12)])
    got = bars.roll_up(b, 4 * HOUR_US, start=F.lit(h(1)).cast("timestamp_ntz"), end=F.lit(h(11)).cast("timestamp_ntz"))
    assert [r.timestamp for r in got.collect()] == [h(4)]


def test_leading_placeholders_go_interior_ones_stay(spark):
    b = make(spark, bar(0, volume=0.0, count=0), bar(1), bar(2, volume=0.0, count=0), bar(3), *[bar(i, volume=0.0, count=0, symbol="never") for i in range(3)])
    assert [r[1] for r in rows(bars.drop_leading_placeholders(b), "timestamp")] == [h(1), h(2), h(3)]


def test_fills(spark):
    f = spark.createDataFrame([(1, "a", 5.0, 1.0), (1, "b", 5.0, 1.0), (2, "a", 5.0, 1.0), (3, "a", 5.0, 1.0), (3, "b", 6.0, 1.0)], "trade_id bigint, side string, sz double, px double")
    trades, findings = bars.fills_to_trades(f)
    assert [t.trade_id for t in trades.collect()] == [1]
    assert rows(findings.select("trade_id", "code"), "trade_id") == [(2, "INCOMPLETE_PAIR"), (3, "UNEQUAL_SIZE")]


def test_dedupe_refuses_a_hash_alone(spark):
    d = spark.createDataFrame([("h", 1, 5.0), ("h", 1, 5.0), ("h", 2, 5.0), ("h", 2, 6.0)], "hash string, tid bigint, px double")
    with pytest.raises(ValueError):
        bars.dedupe_by_key(d, ["hash"])
    kept, clash = bars.dedupe_by_key(d, ["hash", "tid"])
    assert rows(kept) == [("h", 1, 5.0)] and rows(clash) == [("h", 2, 2)]


def test_membership_includes_both_ends(spark):
    u = spark.createDataFrame([("A", h(0), h(5), True), ("B", h(0), None, False), ("C", None, None, False)], "symbol string, first_native_bar timestamp_ntz, last_native_bar timestamp_ntz, is_delisted boolean")
    at = lambda n: sorted(r.symbol for r in bars.members_as_of(u, F.lit(h(n)).cast("timestamp_ntz")).collect())
    assert at(0) == ["A", "B"] and at(5) == ["A", "B"] and at(6) == ["B"]


# --- intervals -----------------------------------------------------------------------------------------------------


def events(spark, *minutes, symbol="X"):
    return spark.createDataFrame([(symbol, T0 + dt.timedelta(minutes=m)) for m in minutes], "symbol string, timestamp timestamp_ntz")


@pytest.mark.parametrize("gap,parts", [(89, 1), (90, 1), (91, 2)])
def test_ninety_minutes_exactly_do_not_split(spark, gap, parts):
    for start in (0, 17, 89):
        e = events(spark, start, start + gap, start + gap + 10)
        assert intervals.coverage_islands(e).count() == parts
        assert intervals.gaps_over(e).count() == parts - 1


def test_islands_against_a_plain_walk(spark):
    import random

    rnd = random.Random(3)
    minutes = sorted(rnd.sample(range(20000), 300))
    want, start, last = [], minutes[0], minutes[0]
    for m in minutes[1:]:
        if m - last > 90:
            want.append((start, last))
            start = m
        last = m
    want.append((start, last))
    got = [((r.coverage_start - T0).total_seconds() / 60, (r.coverage_end - T0).total_seconds() / 60) for r in intervals.coverage_islands(events(spark, *minutes)).orderBy("coverage_start").collect()]
    assert got == want


def test_closed_ends_and_touching_records(spark):
    c = spark.createDataFrame([("X", h(0), h(2)), ("X", h(2), h(50)), ("Y", h(0), h(1))], "symbol string, coverage_start timestamp_ntz, coverage_end timestamp_ntz")
    assert intervals.overlapping_records(c).count() == 1
    e = events(spark, 0, 120, 50 * 60, 50 * 60 + 1)
    assert [r.timestamp for r in intervals.outside_intervals(e, c).collect()] == [h(50, 1)]
    p = spark.createDataFrame([("X", h(0), h(2)), ("X", h(1), h(3)), ("X", h(3), h(50))], "symbol string, period_start timestamp_ntz, period_end timestamp_ntz")
    assert [r.n_records for r in intervals.single_cover(p, c).orderBy("period_start").collect()] == [1, 0, 1]


def test_overlap_pairs_come_once_across_many_blocks(spark):
    a = spark.createDataFrame([(1, T0, T0 + dt.timedelta(days=400)), (2, T0 + dt.timedelta(days=500), T0 + dt.timedelta(days=501))], "id int, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([("p", T0 + dt.timedelta(days=10), T0 + dt.timedelta(days=390)), ("q", T0 + dt.timedelta(days=400), T0 + dt.timedelta(days=500))], "w string, ws timestamp_ntz, we timestamp_ntz")
    assert rows(intervals.overlap_join(a, b, "s", "e", "ws", "we").select("id", "w"), "id", "w") == [(1, "p"), (1, "q"), (2, "q")]


def test_grid(spark):
    b = make(spark, *[bar(i) for i in (0, 1, 4, 5)], bar(2, symbol="Y"))
    assert [r.timestamp for r in intervals.grid_gaps(b).collect()] == [h(3)]
    assert tuple(intervals.first_grid_gap(b).first()) == (h(3), h(2))
    assert [(r.segment_start, r.segment_end, r.n_bars) for r in intervals.grid_segments(b).orderBy("segment_start").collect()] == [(h(0), h(2), 3), (h(4), h(5), 2)]
    filled = intervals.reindex_with_null(b, ["close"])
    assert filled.count() == 12 and filled.where("close is null").count() == 7
    assert [r.timestamp for r in intervals.missing_hours(b, F.lit(h(0)).cast("timestamp_ntz"), F.lit(h(6)).cast("timestamp_ntz")).collect()] == [h(3)]


def test_splice_is_off_by_default(spark):
    b, seam = make(spark, bar(0), bar(1), bar(2)), F.lit(h(1)).cast("timestamp_ntz")
    with pytest.raises(ValueError):
        intervals.splice(b, b, seam)
    assert [(r.timestamp, r.seam_bar) for r in intervals.splice(b, b, seam, opt_in=True).orderBy("timestamp").collect()] == [(h(0), False), (h(1), True), (h(2), False)]
    assert intervals.splice_findings(b, b, seam).count() == 3


def test_segments_covered_twice(spark):
    labels = ["source"]
    b = spark.createDataFrame([("X", h(0), "a"), ("X", h(1), "b"), ("X", h(30), "b")], "symbol string, timestamp timestamp_ntz, source string")
    s = spark.createDataFrame([("X", h(0), h(1), "a"), ("X", h(1), h(2), "b")], "symbol string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, source string")
    assert rows(intervals.segments_disagreeing(b, s, labels).select("timestamp", "code"), "timestamp") == [(h(1), "COVERED_TWICE"), (h(30), "NOT_COVERED")]


# --- as-of -------------------------------------------------------------------------------------------------------------


def quotes(spark, *items):
    return spark.createDataFrame([("X", T0 + dt.timedelta(minutes=m), px, i) for i, (m, px) in enumerate(items)], "symbol string, timestamp timestamp_ntz, oracle_px double, qid bigint")


@pytest.mark.parametrize("minute,price", [(0, 1.0), (2, 1.0), (3, None), (-1, None)])
def test_two_minute_tolerance(spark, minute, price):
    got = asof.asof_price(events(spark, minute), quotes(spark, (0, 1.0)))
    assert got.first().oracle_price == price


def test_equal_times_take_the_first_later_ones_the_last(spark):
    q = quotes(spark, (60, 5.0), (60, 6.0), (60, 7.0))
    got = {r.timestamp: r.oracle_price for r in asof.asof_price(events(spark, 60, 61), q, sequence="qid").collect()}
    assert got == {h(1): 5.0, h(1, 1): 7.0}


def test_price_is_carried_over_block_and_batch_borders(spark):
    q, e = quotes(spark, (59, 1.0), (24 * 60 - 1, 2.0)), events(spark, 60, 24 * 60)
    assert [r.oracle_price for r in asof.asof_price(e, q).orderBy("timestamp").collect()] == [1.0, 2.0]
    first, carry = asof.incremental_asof(e.limit(0), q, None)
    second, _ = asof.incremental_asof(events(spark, 24 * 60), q.limit(0), carry)
    assert second.first().oracle_price == 2.0 and first.count() == 0


def test_dates_at_or_below_the_mark_are_a_no_op(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, i),) for i in (1, 2, 3)], "date date")
    assert [r.date.day for r in asof.new_dates(d, "2024-01-02").collect()] == [3] and asof.new_dates(d, None).count() == 3


# --- quality --------------------------------------------------------------------------------------------------------------


def test_every_kind_of_bar_finding(spark):
    ok = ("X", h(0), 10.0, 11.0, 9.0, 10.0, 1.0, 1, "hyperliquid_candle", 1)
    bad = [
        ok, ok[:9] + (2,), ("X", h(1), float("nan"), 11.0, 9.0, 10.0, 1.0, 1, "hyperliquid_candle", 3), ("X", h(2), 10.0, float("inf"), 9.0, 10.0, 1.0, 1, "hyperliquid_candle", 4),
        ("X", h(3), 10.0, 9.5, 9.0, 10.0, -1.0, 1, "hyperliquid_candle", 6), ("X", h(4), 10.0, 11.0, 10.5, 10.0, 1.0, -1, "external_proxy", 5), ("A/B", h(0), 10.0, 11.0, 9.0, 10.0, 0.0, 0, "hyperliquid_candle", 7)]
    d = spark.createDataFrame(bad, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, trade_count bigint, source_type string, seq bigint")
    got = {(r.code, r.symbol, r.timestamp): r.n for r in quality.validate_bars(d, "seq").collect()}
    assert got == {
        ("DUPLICATE_KEY", "X", h(0)): 2, ("MALFORMED_OHLC", "X", h(1)): 1, ("MALFORMED_OHLC", "X", h(2)): 1, ("MALFORMED_OHLC", "X", h(3)): 1, ("MALFORMED_OHLC", "X", h(4)): 1,
        ("NEGATIVE_OR_NONFINITE_VOLUME", "X", h(3)): 1, ("NEGATIVE_TRADE_COUNT", "X", h(4)): 1, ("BAD_SOURCE_TYPE", "X", h(4)): 1, ("NON_MONOTONIC_TIMESTAMP", "X", h(3)): 1,
        ("SPOT_STYLE_SYMBOL", "A/B", None): 1, ("BACKFILL_PREFIX_PRESENT", "A/B", h(0)): 1}
    with pytest.raises(quality.FindingsError):
        quality.fail_on(quality.validate_bars(d, "seq"))


def test_schema_rules(spark):
    b = make(spark, bar(0))
    with pytest.raises(quality.FindingsError):
        quality.assert_bar_schema(b)
    stamped = bars.stamp_attribution(b, "tape", "native", "hyperliquid_candle", "1h").select(*bars.BAR_COLUMNS)
    with pytest.raises(quality.FindingsError, match="NAIVE"):
        quality.assert_bar_schema(stamped)
    zoned = stamped.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert quality.assert_bar_schema(zoned.withColumn("extra", F.lit(1))) is not None
    with pytest.raises(quality.FindingsError, match="COLUMN_TYPE"):
        quality.assert_bar_schema(zoned.withColumn("trade_count", F.lit(1.0)))


def test_funding_rates(spark):
    f = spark.createDataFrame([("X", h(0), 0.01, 1), ("X", h(1), float("nan"), 2), ("X", h(2), 0.0099, 3), ("X", h(4), 0.0, 4)], "symbol string, timestamp timestamp_ntz, funding_rate double, seq bigint")
    assert rows(quality.validate_funding(f, "seq").select("code", "timestamp"), "code") == [("FUNDING_GAP_EXCEEDED", h(4)), ("IMPLAUSIBLE_RATE", h(0)), ("NON_FINITE_RATE", h(1))]


# --- venues and archive -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("factor,inside", [(1.0, True), (0.5, False), (2.0, False), (1.99, True), (1000.0, False)])
def test_unit_ratio_bounds_are_strict(spark, factor, inside):
    p = compare.overlap(make(spark, bar(0), bar(1)), make(spark, bar(0, 100.0 * factor), bar(1, 100.0 * factor)))
    assert compare.unit_ratio_check(p).first().within_bounds is inside


def test_shifted_series_is_found(spark):
    import random

    rnd = random.Random(1)
    closes = [100 * (1 + rnd.uniform(-0.1, 0.1)) for _ in range(60)]
    a, b = make(spark, *[bar(i, closes[i]) for i in range(60)]), make(spark, *[bar(i, closes[min(i + 1, 59)]) for i in range(60)])
    same = compare.alignment_test(compare.lagged_correlation(a, a)).first()
    moved = compare.alignment_test(compare.lagged_correlation(a, b)).first()
    assert same.passes_argmax and same.passes_rho0 and moved.argmax_lag == 1 and not moved.passes_argmax


def test_stored_rows_win_and_conflicts_are_counted(spark):
    stored, fetched = make(spark, bar(0), bar(1)), make(spark, bar(1, 105.0), bar(2))
    got = A.accrete(stored, fetched)
    assert [(r.timestamp, r.close) for r in got.orderBy("timestamp").collect()] == [(h(0), 100.0), (h(1), 100.0), (h(2), 100.0)]
    assert A.conflicts(stored, fetched).count() == 1 and A.conflicts(stored, stored).count() == 0
    nan = make(spark, bar(0, float("nan")))
    assert A.conflicts(nan, nan).count() == 0
    assert A.regression_guard(stored, got).first().regression is False and A.regression_guard(stored, fetched).first().regression is True


def test_reconciliation(spark):
    now = F.lit(h(4)).cast("timestamp_ntz")
    stored = make(spark, bar(0), bar(1), bar(2), bar(3))
    fresh = make(spark, bar(0, 101.0), bar(1, 100.0, 0.0, 0), bar(2), bar(3, 99.0))
    acts = A.reconcile_actions(stored, fresh, now)
    assert rows(acts.select("timestamp", "action"), "timestamp") == [(h(0), "REPLACE"), (h(1), "REFUSE"), (h(2), "KEEP"), (h(3), "REPLACE")]
    assert [r.close for r in A.apply_reconciliation(stored, acts).orderBy("timestamp").collect()] == [101.0, 100.0, 100.0, 99.0]
    early = A.reconcile_actions(stored, fresh, F.lit(h(3, 59)).cast("timestamp_ntz"))
    assert early.where("timestamp = timestamp_ntz'2024-01-01 03:00:00'").first().action == "KEEP"
    assert [r.action for r in A.reconcile_actions(stored, fresh, now, trailing_only=True).orderBy("timestamp").collect()] == ["KEEP", "KEEP", "KEEP", "REPLACE"]


def test_digest_ignores_order_and_sees_changes(spark):
    b = make(spark, *[bar(i) for i in range(50)])
    one = lambda d: table_digest(d, d.columns, ["symbol"]).first().digest
    assert one(b) == one(b.orderBy(F.desc("timestamp")).repartition(7)) and one(b) != one(b.where("trade_count > 0 and timestamp > timestamp_ntz'2024-01-01'"))
    twice = b.unionByName(b.limit(1))
    assert one(b) != one(twice)
    assert A.changed_symbols(b, b, b.columns).first().needs_write is False


def test_exit_unnamed_and_rebalance_on_change(spark):
    w = spark.createDataFrame([("r", "A", 0, 1.0), ("r", "B", 0, None), ("r", "A", 1, None), ("r", "B", 1, 1.0), ("r", "A", 2, None), ("r", "B", 2, 1.0)], "run_id string, symbol string, bar int, target_weight double")
    got = {(r.symbol, r.bar): r.target_weight for r in signals.exit_unnamed(w, w, ["run_id"], "bar").collect()}
    assert got[("A", 1)] == 0.0 and got[("A", 2)] is None and got[("B", 0)] is None
    assert [r.rebalance for r in signals.rebalance_on_change(w, ["run_id"], "bar").orderBy("bar").collect()] == [True, True, False]


def test_sma_needs_a_full_window(spark):
    b = make(spark, *[bar(i, 100.0 + i) for i in range(5)])
    got = signals.sma_signal(b, 3)
    assert [(r.timestamp, r.sma, r.signal) for r in got.orderBy("timestamp").collect()] == [(h(2), 101.0, 1.0), (h(3), 102.0, 1.0), (h(4), 103.0, 1.0)]
    flat = signals.sma_signal(make(spark, *[bar(i) for i in range(3)]), 3).first()
    assert flat.signal == 0.0  # equal is not above
    assert signals.after_warm_up(b, 3).count() == 3


def test_period_of_funding_events(spark):
    from tapeledger.operators.ledger import funding_by_bar

    e = spark.createDataFrame([("X", h(1), 0.1, 2.0), ("X", h(1, 59), 0.1, None), ("X", h(2), 0.1, 1.0)], "symbol string, timestamp timestamp_ntz, funding_rate double, notional_price double")
    got = {r.bar: (r.n_events, r.n_unpriced) for r in funding_by_bar(e, F.lit(h(0)).cast("timestamp_ntz"), HOUR_US).collect()}
    assert got == {1: (2, 1), 2: (1, 0)} and DAY_US == 24 * HOUR_US


def test_coverage_and_gaps_of_held_stretches(spark):
    """Against counting period by period: overlapping records, stretches without events, before and after all events."""
    import random

    from tapeledger.operators import intervals as I

    rnd, t0, hour = random.Random(8), dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    events = sorted((s, at(rnd.choice([rnd.randrange(0, 900), rnd.randrange(4000, 5000)])), i) for i, s in enumerate(["A"] * 60 + ["B"] * 5))
    records = [(rnd.choice("AB"), at(a := rnd.randrange(0, 5000)), at(a + rnd.randrange(10, 900))) for _ in range(12)]
    stretches = [(i, rnd.choice("ABC"), t0 + (h := rnd.randrange(-5, 90)) * hour, t0 + (h + rnd.randrange(1, 30)) * hour) for i in range(60)]
    e = spark.createDataFrame(events, "symbol string, timestamp timestamp_ntz, n int")
    c = spark.createDataFrame(records, "symbol string, coverage_start timestamp_ntz, coverage_end timestamp_ntz")
    s = spark.createDataFrame(stretches, "id int, symbol string, stretch_start timestamp_ntz, stretch_end timestamp_ntz")
    covered = {r.id: (r.n_periods, r.n_covered) for r in I.covered_periods(c, s, ["id"]).collect()}
    gaps = {r.id: r.max_gap_us for r in I.stretch_gaps(e, s, ["id"], tie="n").collect()}
    for i, symbol, a, b in stretches:
        hours = [a + k * hour for k in range(int((b - a) / hour))]
        assert covered[i] == (len(hours), sum(any(x == symbol and p <= h and h + hour <= q for x, p, q in records) for h in hours))
        times = [t for x, t, _ in events if x == symbol]
        touching = [(q - p) // dt.timedelta(microseconds=1) for p, q in zip(times, times[1:]) if q >= a and p < b]
        assert gaps[i] == max(touching, default=None), i
