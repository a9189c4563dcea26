"""Block-wise ordered operators against pandas, with one key that holds most of the rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapeledger.functions.timegrid import HOUR_US, MINUTE_US, time_block
from tapeledger.operators import ordered
from tapeledger.operators.asof import asof_price
from tapeledger.operators.ordered import exact_percentiles, with_position, with_previous, with_running


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    # clustered times with long empty stretches, so that blocks are skipped
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.choice([0, 3, 50, 51, 400], n) * 3600 + rng.integers(0, 3600, n), unit="s")
    return pd.DataFrame({"k": key, "timestamp": t, "i": np.arange(n), "x": rng.normal(size=n).round(2)})


def _spark(spark, frame):
    return spark.createDataFrame(frame).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@pytest.fixture(params=[None, 40], ids=["calendar", "rows"])
def bound(request, monkeypatch):
    """Blocks of the calendar only, and blocks of at most 40 rows."""
    if request.param:
        monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", request.param)
        monkeypatch.setattr(ordered, "SAMPLED", 300)
        monkeypatch.setattr(ordered, "FAN_OUT", 8)
    return request.param


def test_no_block_is_larger_than_the_bound(spark, monkeypatch):
    """A third of the rows lie in one hour of one symbol, a half of those at one instant."""
    monkeypatch.setattr(ordered, "SAMPLED", 500)
    n = 30_000
    third, instant = F.col("id") % 3 == 0, F.col("id") % 6 == 0
    at = F.when(instant, 5_000_000).when(third, F.pmod(F.xxhash64("id"), F.lit(HOUR_US))).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000 * HOUR_US)))
    df = spark.range(n).select("id", F.when(third, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("k"), F.timestamp_micros(at).cast("timestamp_ntz").alias("timestamp"))
    cut = ordered.row_blocks(df, ["k"], ["timestamp", "id"], time_block("timestamp", HOUR_US), most=200)
    assert cut.count() == n and cut.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 200
    edges = cut.groupBy("k", "_block").agg(F.min(F.struct("timestamp", "id")).alias("a"), F.max(F.struct("timestamp", "id")).alias("b")).where("k = 'hot'").orderBy("_block").collect()
    assert len(edges) > 50 and all(x.b < y.a for x, y in zip(edges, edges[1:]))
    alike = spark.range(500).select(F.lit("k").alias("k"), F.lit(1).alias("t"))
    assert ordered.row_blocks(alike, ["k"], ["t"], F.lit(0), most=100).count() == 500  # cannot be told apart


def test_asof_within_row_blocks(spark, frame, bound):
    df = _spark(spark, frame).withColumn("timestamp", F.date_trunc("minute", "timestamp").cast("timestamp_ntz"))
    events, quotes = df.where("i % 2 = 0").select("k", "timestamp", "i"), df.where("i % 2 = 1").select("k", "timestamp", F.col("x").alias("oracle_px"), "i")
    got = asof_price(events, quotes, keys=["k"], tolerance_us=5 * MINUTE_US, sequence="i").toPandas().set_index("i").sort_index()
    f = frame.assign(timestamp=frame.timestamp.dt.floor("min"))
    for i, row in f[f.i % 2 == 0].set_index("i").iterrows():
        q = f[(f.i % 2 == 1) & (f.k == row.k) & (f.timestamp <= row.timestamp) & (f.timestamp >= row.timestamp - pd.Timedelta("5min"))]
        here = q[q.timestamp == q.timestamp.max()].sort_values("i")
        want = np.nan if not len(here) else here.x.iloc[0] if here.timestamp.iloc[0] == row.timestamp else here.x.iloc[-1]
        assert got.oracle_price[i] == want or (np.isnan(want) and np.isnan(got.oracle_price[i]))


def test_previous_and_next(spark, frame, bound):
    df = _spark(spark, frame)
    got = with_previous(df, ["k"], ["timestamp", "i"], time_block("timestamp", HOUR_US), {"before": "x"})
    got = with_previous(got, ["k"], ["timestamp", "i"], time_block("timestamp", HOUR_US), {"after": "x"}, ahead=True).toPandas().set_index("i").sort_index()
    want = frame.sort_values(["k", "timestamp", "i"])
    want["before"], want["after"] = want.groupby("k").x.shift(1), want.groupby("k").x.shift(-1)
    want = want.set_index("i").sort_index()
    pd.testing.assert_series_equal(got.before, want.before, check_dtype=False)
    pd.testing.assert_series_equal(got.after, want.after, check_dtype=False)


def test_running(spark, frame, bound):
    got = with_running(_spark(spark, frame), ["k"], ["timestamp", "i"], time_block("timestamp", HOUR_US), {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("min", F.col("x"))}).toPandas().set_index("i").sort_index()
    want = frame.sort_values(["k", "timestamp", "i"])
    want["s"], want["m"], want["l"] = (getattr(want.groupby("k").x, f)() for f in ("cumsum", "cummax", "cummin"))
    want = want.set_index("i").sort_index()
    for c in "sml":
        np.testing.assert_allclose(got[c], want[c], atol=1e-9)


def test_position(spark, frame, bound):
    got = with_position(_spark(spark, frame), ["k"], ["timestamp", "i"], time_block("timestamp", HOUR_US)).toPandas().set_index("i").sort_index()
    want = frame.sort_values(["k", "timestamp", "i"])
    want["p"] = want.groupby("k").cumcount() + 1
    assert (got.position == want.set_index("i").sort_index().p).all()


@pytest.mark.parametrize("most", [3, 1_000_000])
@pytest.mark.parametrize("accuracy", [5, 10_000])
def test_exact_percentiles(spark, frame, accuracy, most):
    """A poor sketch must cost time only, not correctness."""
    ps = [0, 1, 5, 25, 50, 75, 95, 99, 100]
    got = {(r.k, r.percent): r.value for r in exact_percentiles(_spark(spark, frame), ["k"], "x", ps, accuracy, most).collect()}
    for k, g in frame.groupby("k"):
        for p in ps:
            assert got[k, p] == pytest.approx(g.x.quantile(p / 100), abs=1e-12)
    whole = {r.percent: r.value for r in exact_percentiles(_spark(spark, frame), [], "x", ps, accuracy, most).collect()}
    assert whole[50] == pytest.approx(frame.x.quantile(0.5))


def test_percentiles_of_equal_values(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1.0).otherwise(2.0).alias("x"))
    got = {r.percent: r.value for r in exact_percentiles(df, [], "x", [1, 50, 95]).collect()}
    assert got == {1: 1.0, 50: 1.0, 95: 2.0}


def test_last_brackets_are_bounded(spark, monkeypatch):
    """Ten million distinct values, and as many rows of one value: nothing over the bound is ordered, but equal rows."""
    seen, plain = [], ordered._ranked

    def watched(rows, wanted, keys, value):
        seen.append(wanted.agg(F.max(F.when(F.element_at("_path", -1) % 2 == 0, F.col("_in_bin")))).first()[0] or 0)
        return plain(rows, wanted, keys, value)

    monkeypatch.setattr(ordered, "_ranked", watched)
    df = spark.range(20_000_000).select(F.when(F.col("id") < 10_000_000, F.col("id").cast("double")).otherwise(7.5).alias("x"))
    got = {r.percent: r.value for r in exact_percentiles(df, [], "x", [25, 50, 90], accuracy=100, most=20_000).collect()}
    assert max(seen) <= 20_000 and len(seen) > 1
    at = lambda r: r if r < 8 else 7.5 if r < 10_000_008 else r - 10_000_000
    for p, v in got.items():
        r = (20_000_000 - 1) * p / 100
        assert v == pytest.approx(at(int(r)) + (at(int(r) + 1) - at(int(r))) * (r - int(r)), abs=1e-6)


def test_blocks_do_not_depend_on_wall_clock(spark):
    one = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 30),)], "t timestamp_ntz")
    assert one.select(time_block("t", HOUR_US)).first()[0] == -1


def test_short_series_are_shuffled_once(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 3.0)], "k string, t bigint, x double")
    got = with_running(df, ["k"], ["t"], F.col("t"), {"n": ("count", F.lit(1)), "f": ("first", F.struct("x"))})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert rows(got.select("k", "t", "n", "f.x"), "k", "t") == [("a", 1, 1, 2.0), ("a", 3, 2, 2.0), ("b", 2, 1, 3.0)]


def test_first_of_a_long_series_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 2)
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "k string, t bigint, x double")
    got = with_running(df, ["k"], ["t"], F.floor(F.col("t") / 2), {"n": ("count", F.lit(1)), "f": ("first", F.struct("x"))})
    assert rows(got.select("t", "n", "f.x"), "t") == [(i, i + 1, 0.0) for i in range(9)]
