"""Streams over several batches give what one batch job gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapeledger.operators import asof, bars, intervals
from tapeledger.streaming import tape

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "symbol string, timestamp timestamp, trade_id bigint, px double, sz double, venue string"


@pytest.fixture
def feed(spark, tmp_path):
    """Three files in time order, read one per batch; one symbol has most of the ticks."""
    rnd = random.Random(11)
    minutes = sorted(rnd.uniform(0, 3 * 24 * 60) for _ in range(900))
    items = [("hot" if rnd.random() < 0.7 else "cold", T0 + dt.timedelta(minutes=m), i, round(rnd.uniform(1, 9), 2), 1.0, rnd.choice("AB")) for i, m in enumerate(minutes)]
    folder = tmp_path / "feed"
    for day in range(3):
        part = [x for x in items if (x[1] - T0).days == day]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream, spark.createDataFrame(items, SCHEMA), tmp_path


def test_bars_and_coverage(spark, feed):
    stream, batch, tmp = feed
    tape.append_to(tape.closed_bars(stream), f"{tmp}/b", f"{tmp}/bc").awaitTermination()
    end = batch.agg(F.max("timestamp") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    want = bars.ticks_to_bars(batch).where(F.col("timestamp") + F.expr("INTERVAL 1 HOUR") <= F.lit(end).cast("timestamp_ntz"))
    got = spark.read.parquet(f"{tmp}/b").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    cols = ["symbol", "timestamp", "open", "high", "low", "close", "volume", "trade_count"]
    assert rows(got.select(cols), "symbol", "timestamp") == rows(want.select(cols), "symbol", "timestamp")
    tape.append_to(tape.coverage(stream), f"{tmp}/c", f"{tmp}/cc").awaitTermination()
    closed = intervals.coverage_islands(batch).where(F.col("coverage_end") + F.expr("INTERVAL 90 MINUTES") <= F.lit(end).cast("timestamp_ntz"))
    seen = spark.read.parquet(f"{tmp}/c").select("symbol", F.col("coverage_start").cast("timestamp_ntz").alias("coverage_start"), F.col("coverage_end").cast("timestamp_ntz").alias("coverage_end"), "n_events")
    assert rows(seen, "symbol", "coverage_start") == rows(closed, "symbol", "coverage_start")


def test_asof_of_a_stream_out_of_order(spark, tmp_path):
    """Quotes of one instant, an event at that very instant, hot symbol; days come in the order 1, 0, 2; one event is late."""
    rnd = random.Random(5)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    items = [("hot" if rnd.random() < 0.7 else "cold", at(rnd.randrange(3 * 24 * 60)), i, round(rnd.uniform(1, 9), 2), 1.0, rnd.choice("AB")) for i in range(600)]
    items += [("solo", at(100), 1000 + i, float(i), 1.0, "A") for i in range(3)] + [("solo", at(100), 1010, 0.0, 1.0, "B"), ("solo", at(101), 1011, 0.0, 1.0, "B")]
    late = [("cold", at(7), 2000, 0.0, 1.0, "B")]
    end = [("end", at(60 * 24 * 60), 3000 + i, 0.0, 1.0, v) for i, v in enumerate("AB")]
    batch = spark.createDataFrame(items, SCHEMA)

    def split(b):
        return b.where("venue = 'B'").select("symbol", "timestamp", "trade_id"), b.where("venue = 'A'").select("symbol", "timestamp", F.col("px").alias("oracle_px"), F.col("trade_id").alias("quote_id"))

    for part in ([x for x in items if (x[1] - T0).days == 1], [x for x in items if (x[1] - T0).days == 0], [x for x in items if (x[1] - T0).days == 2], late, end):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        tape.append_to(tape.asof_prices(*split(stream), "2 days", 30 * 60_000_000), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = asof.asof_price(*split(batch), tolerance_us=30 * 60_000_000, sequence="quote_id").select("trade_id", "oracle_price")
    assert rows(got.select("trade_id", "oracle_price"), "trade_id") == rows(want, "trade_id")
    assert {r.trade_id: r.oracle_price for r in got.collect()}[1010] == 0.0 and {r.trade_id: r.oracle_price for r in got.collect()}[1011] == 2.0
    everything = spark.createDataFrame(items + late, SCHEMA)
    assert [r.trade_id for r in tape.late_events(split(everything)[0], got, ["trade_id"]).collect()] == [2000]


def test_dense_events_and_quotes_are_not_paired(spark, tmp_path):
    """700 rows of one symbol within two hours, many at one instant: each is kept once, in the state of its block."""
    rnd = random.Random(8)
    items = [("hot", T0 + dt.timedelta(minutes=rnd.randrange(120)), i, round(rnd.uniform(1, 9), 2), 1.0, rnd.choice("ABB")) for i in range(700)]
    end = [("end", T0 + dt.timedelta(days=60), 3000 + i, 0.0, 1.0, v) for i, v in enumerate("AB")]
    split = lambda b: (b.where("venue = 'B'").select("symbol", "timestamp", "trade_id"), b.where("venue = 'A'").select("symbol", "timestamp", F.col("px").alias("oracle_px"), F.col("trade_id").alias("quote_id")))
    kept = []
    for part in (items[::2], items[1::2], end):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        job = tape.append_to(tape.asof_prices(*split(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), "2 days", 7 * 60_000_000), f"{tmp_path}/out", f"{tmp_path}/cp")
        job.awaitTermination()
        kept += [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in job.recentProgress]
    want = asof.asof_price(*split(spark.createDataFrame(items, SCHEMA)), tolerance_us=7 * 60_000_000, sequence="quote_id").select("trade_id", "oracle_price", "quote_time")
    got = spark.read.parquet(f"{tmp_path}/out").select("trade_id", "oracle_price", F.col("quote_time").cast("timestamp_ntz").alias("quote_time"))
    assert rows(got, "trade_id") == rows(want.withColumn("quote_time", F.col("quote_time").cast("timestamp_ntz")), "trade_id")
    assert max(kept) <= 30  # blocks of seven minutes, not rows or pairs


def test_events_without_symbol_are_late_only_if_unpriced(spark, tmp_path):
    """Events without a symbol have no price but a row of the stream, so they are not late; nor is one without a time."""
    items = [(None, T0, 1, 0.0, 1.0, "B"), ("hot", T0, 2, 0.0, 1.0, "B"), ("end", T0 + dt.timedelta(days=60), 3, 0.0, 1.0, "B"), ("end", T0 + dt.timedelta(days=60), 4, 0.0, 1.0, "A")]
    late = [(None, T0, 5, 0.0, 1.0, "B"), ("hot", T0, 6, 0.0, 1.0, "B"), ("hot", None, 7, 0.0, 1.0, "B")]
    split = lambda b: (b.where("venue = 'B'").select("symbol", "timestamp", "trade_id"), b.where("venue = 'A'").select("symbol", "timestamp", F.col("px").alias("oracle_px"), F.col("trade_id").alias("quote_id")))
    for part in (items, late):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        tape.append_to(tape.asof_prices(*split(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), "2 days", 7 * 60_000_000), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    events, got = split(spark.createDataFrame(items[:2] + late, SCHEMA))[0], spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.trade_id for r in got.collect()) == [1, 2]
    assert sorted(r.trade_id for r in tape.late_events(events, got, ["symbol", "timestamp", "trade_id"]).collect()) == [5, 6]


def test_increments_keep_what_late_events_need(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    quotes = lambda *q: spark.createDataFrame([("X", t, p, i) for i, (t, p) in enumerate(q)], "symbol string, timestamp timestamp_ntz, oracle_px double, qid bigint")
    events = lambda *t: spark.createDataFrame([("X", x) for x in t], "symbol string, timestamp timestamp_ntz")
    minute = 60_000_000
    _, carry, _ = asof.incremental_asof(events(), quotes((at(10, 0), 1.0), (at(10, 20), 2.0), (at(8, 0), 9.0)), None, tolerance_us=30 * minute, sequence="qid", lateness_us=15 * minute)
    assert sorted(r.oracle_px for r in carry.collect()) == [1.0, 2.0]
    priced, carry, late = asof.incremental_asof(events(at(10, 10), at(10, 25), at(10, 4)), quotes((at(10, 24), 3.0)), carry, tolerance_us=30 * minute, sequence="qid", lateness_us=15 * minute)
    assert [(r.timestamp, r.oracle_price) for r in priced.orderBy("timestamp").collect()] == [(at(10, 10), 1.0), (at(10, 25), 3.0)]
    assert [r.timestamp for r in late.collect()] == [at(10, 4)]


def test_pages_merge_once(spark, tmp_path):
    schema = "key string, timestamp timestamp, px double"
    at = lambda h: T0 + dt.timedelta(hours=h)
    pages = [[("a", at(1), 1.0), ("a", at(1), 1.0), ("b", at(2), 5.0)], [("b", at(2), 6.0), ("c", at(3), None)], [("a", at(1), 1.0), ("c", at(3), None)], [("end", at(500), 0.0)]]
    for page in pages:
        spark.createDataFrame(page, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        tape.append_to(tape.agreed_pages(stream, ["key", "timestamp"], ["px"], "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.key: (r.px if r.agree else None, r.n_rows, r.agree) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a": (1.0, 1, True), "b": (None, 2, False), "c": (None, 1, True)}


def test_accretion_over_batches(spark, tmp_path):
    schema = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, trade_count bigint, native_traded boolean"
    row = lambda n, c: ("X", dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), c, c, c, c, 1.0, 1, True)
    for part in ([row(0, 1.0), row(1, 1.0)], [row(1, 1.0), row(2, 2.0)], [row(2, 9.0), row(3, 3.0), row(4, 1.0), row(4, 2.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tape.accrete_stream(stream, f"{tmp_path}/out", f"{tmp_path}/conflicts", f"{tmp_path}/cp").awaitTermination()
    assert [r.close for r in spark.read.parquet(f"{tmp_path}/out").orderBy("timestamp").collect()] == [1.0, 1.0, 2.0, 3.0]
    assert [(r.old.close, r.new.close) for r in spark.read.parquet(f"{tmp_path}/conflicts/kind=stored").collect()] == [(2.0, 9.0)]
    assert [r.n_rows for r in spark.read.parquet(f"{tmp_path}/conflicts/kind=batch").collect()] == [2]
