"""Streaming queries, run over the given events as a file stream until everything is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions.timegrid import MINUTE_US, epoch_us
from tapeledger.plans import views as V
from tapeledger.plans.quality_queries import _ASOF
from tapeledger.plans.registry import query
from tapeledger.session import cut_lineage, scratch_path
from tapeledger.streaming import tape


#: The closing row of a stream: so far ahead of all others that every window and interval before it is finished.
END = "~end"
_TICKS = "symbol string, timestamp timestamp, trade_id bigint, px double, sz double, venue string"


def _slice(ticks, n, jitter_us=0):
    """Which of ``n`` equal stretches of the ticks' time a row falls in; ``jitter_us`` moves a row back by up to so much."""
    span = ticks.agg(F.min(epoch_us("timestamp")).alias("a"), F.max(epoch_us("timestamp")).alias("b"))
    a, b = span.select("a").scalar(), span.select("b").scalar()
    moved = F.greatest(epoch_us("timestamp") - (F.pmod(F.xxhash64("trade_id"), F.lit(jitter_us)) if jitter_us else 0), a)
    return F.floor((moved - a) * n / (b - a + 1)).cast("int")


def _batches(spark, sf, n, order, jitter_us=0):
    """The ticks as ``order`` says: batch i holds stretch ``order[i]``; the last one holds the closing row."""
    t = V.ticks(spark, sf)
    rows = t.withColumn("part", _slice(t, n, jitter_us)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = cut_lineage(rows, "stream-ticks")
    end = rows.agg((F.max("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("timestamp"))
    ends = [end.select(F.lit(END).alias("symbol"), "timestamp", F.lit(i).cast("bigint").alias("trade_id"), F.lit(0.0).alias("px"), F.lit(0.0).alias("sz"), F.lit(v).alias("venue")) for i, v in enumerate("AB")]
    return [rows.where(F.col("part") == i).drop("part") for i in order], ends[0].unionByName(ends[1])


def _run(spark, batches, build, name, schema=_TICKS):
    """Feed the batches one after another, each a folder of as many files as its plan writes; the job is stopped and goes
    on from its checkpoint in between. ``build`` turns the file stream into the stream that is stored."""
    out = scratch_path(spark, name)
    for batch in batches:
        batch.write.mode("append").parquet(f"{out}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{out}/in"))
        tape.append_to(stream, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    wanted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    df = spark.read.schema(wanted).parquet(f"{out}/data")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in stream.schema.fields if f.dataType.simpleString() == "timestamp"})


@query("stream_bars", "SELECT * FROM bars_1h", ("bars_1h",))
def stream_bars(spark, sf):
    """Bars from four batches whose ticks are out of order by up to nine minutes, within and across batches."""
    batches, end = _batches(spark, sf, 4, range(4), 9 * MINUTE_US)
    return _run(spark, [*batches, end], tape.closed_bars, "stream-bars").where(F.col("symbol") != END)


@query("stream_bars_open", "SELECT * FROM bars_1h WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM ticks) - INTERVAL 10 MINUTE", ("bars_1h",))
def stream_bars_open(spark, sf):
    """Without a closing row the watermark holds the last bars back."""
    batches, _ = _batches(spark, sf, 4, range(4), 9 * MINUTE_US)
    return _run(spark, batches, tape.closed_bars, "stream-bars-open")


@query("stream_coverage", "SELECT symbol, coverage_start, coverage_end, n_events FROM coverage", ("coverage",))
def stream_coverage(spark, sf):
    """Sessions that go on over batches; rows out of order as for the bars."""
    batches, end = _batches(spark, sf, 4, range(4), 9 * MINUTE_US)
    return _run(spark, [*batches, end], tape.coverage, "stream-coverage").where(F.col("symbol") != END)


_PART = "floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM ticks)) * 6.0 / ((SELECT max(epoch_us(timestamp)) - min(epoch_us(timestamp)) FROM ticks) + 1))"
_LATE = f"venue = 'B' AND trade_id % 7 = 2 AND {_PART} = 0"
#: Stretches in the order of their batches, none more than one place from its own, and what the watermark waits.
_ORDER, _DELAY = (1, 0, 3, 2, 5, 4), "11 days"


def _priced_late(spark, sf):
    """Six stretches out of order, then a seventh batch with events of the first stretch, behind the watermark by then."""
    def split(stream):
        events = stream.where("venue = 'B'").select("symbol", "timestamp", "trade_id")
        quotes = stream.where("venue = 'A'").select("symbol", "timestamp", F.col("px").alias("oracle_px"), F.col("trade_id").alias("quote_id"))
        return tape.asof_prices(events, quotes, _DELAY, 30 * MINUTE_US)

    batches, end = _batches(spark, sf, 6, _ORDER)
    late = F.expr("venue = 'B' AND trade_id % 7 = 2")
    batches[1], held_back = batches[1].where(~late), batches[1].where(late)
    return _run(spark, [*batches, held_back, end], split, "stream-asof").where(~F.col("symbol").eqNullSafe(END))


@query("stream_asof", _ASOF.format(m=30).replace("WHERE venue = 'B'", f"WHERE venue = 'B' AND NOT ({_LATE})"), ("ticks",))
def stream_asof(spark, sf):
    """As-of prices from batches in shuffled order are those of one batch run, but for events behind the watermark."""
    return _priced_late(spark, sf)


@query("stream_asof_late", f"SELECT symbol, timestamp, trade_id FROM ticks WHERE {_LATE}", ("ticks",))
def stream_asof_late(spark, sf):
    """The events that came behind the watermark."""
    events = V.ticks(spark, sf).where("venue = 'B'").select("symbol", "timestamp", "trade_id")
    return tape.late_events(events, _priced_late(spark, sf), ["symbol", "timestamp", "trade_id"])


@query("stream_pages", """SELECT symbol, timestamp, trade_id, px, CASE WHEN trade_id % 50 = 0 THEN 2 ELSE 1 END AS n_rows, trade_id % 50 <> 0 AS agree FROM ticks
  WHERE trade_id % 50 <> 0 UNION ALL SELECT symbol, timestamp, trade_id, NULL, 2, false FROM ticks WHERE trade_id % 50 = 0""", ("ticks",))
def stream_pages(spark, sf):
    """Five overlapping pages out of order: a fifth of the rows comes on two pages, some of them twice on a page; where
    the copies differ in price the key is marked, and no price is given."""
    order, pages = (1, 0, 3, 2, 4), []
    batches, end = _batches(spark, sf, 5, order)
    for at, batch in enumerate(batches):
        again = batches[order.index((order[at] + 1) % 5)] if order[at] < 4 else None
        page = batch.unionByName(batch.where("trade_id % 30 = 0"))
        if again is not None:  # the page reaches into the next stretch
            page = page.unionByName(again.where("trade_id % 5 = 0").withColumn("px", F.expr("CASE WHEN trade_id % 50 = 0 THEN px + 1 ELSE px END")))
        pages.append(page)
    first = batches[order.index(0)].where("trade_id % 50 = 0").withColumn("px", F.col("px") + 1)  # a page before all others
    build = lambda s: tape.agreed_pages(s.select("symbol", "timestamp", "trade_id", "px"), ["symbol", "timestamp", "trade_id"], ["px"], "20 days")
    got = _run(spark, [first, *pages, end], build, "stream-pages").where(F.col("symbol") != END)
    return got.withColumns({"px": F.when(F.col("agree"), F.col("px")), "n_rows": F.col("n_rows").cast("int")})


def _shuffled_files(spark, sf, n=3):
    """The ticks in a few batches without any order of time. A copy of every tenth tick comes in
    another batch, every fiftieth with another price; every seventieth comes twice in one batch with two prices."""
    t = V.ticks(spark, sf).select("symbol", "timestamp", "trade_id", "px")
    at = F.pmod("trade_id", F.lit(n))
    copies = F.array(
        F.struct(at.alias("file"), F.lit(0.0).alias("off")),
        F.when(F.col("trade_id") % 10 == 0, F.struct(F.pmod(at + 1, F.lit(n)).alias("file"), F.when(F.col("trade_id") % 50 == 0, 1.0).otherwise(0.0).alias("off"))),
        F.when(F.col("trade_id") % 70 == 3, F.struct(at.alias("file"), F.lit(2.0).alias("off"))))
    rows = t.withColumn("c", F.explode(F.array_compact(copies))).select("symbol", "timestamp", "trade_id", (F.col("px") + F.col("c.off")).alias("px"), "c.file")
    return [rows.where(F.col("file") == i).drop("file") for i in range(n)], "symbol string, timestamp timestamp_ntz, trade_id bigint, px double"


def _accreted(spark, sf):
    out = scratch_path(spark, "stream-accrete")
    batches, schema = _shuffled_files(spark, sf)
    for batch in batches:
        batch.write.mode("append").parquet(f"{out}/in")
        tape.accrete_stream(spark.readStream.schema(schema).parquet(f"{out}/in"), f"{out}/data", f"{out}/conflicts", f"{out}/checkpoint", ["symbol", "timestamp", "trade_id"]).awaitTermination()
    return out, schema


@query("stream_accrete", "SELECT symbol, timestamp, trade_id FROM ticks WHERE trade_id % 70 <> 3", ("ticks",))
def stream_accrete(spark, sf):
    """Three batches in shuffled order; the archive keeps each key once, and none whose rows differ in its batch."""
    out, schema = _accreted(spark, sf)
    return spark.read.schema(schema).parquet(f"{out}/data").select("symbol", "timestamp", "trade_id")


@query("stream_accrete_conflicts", "SELECT symbol, timestamp, trade_id, CASE WHEN trade_id % 70 = 3 THEN 'batch' ELSE 'stored' END AS kind FROM ticks WHERE trade_id % 70 = 3 OR trade_id % 50 = 0", ("ticks",))
def stream_accrete_conflicts(spark, sf):
    """What the archive refused: keys with two values in one batch, and stored keys that came back with another value."""
    out, schema = _accreted(spark, sf)
    return spark.read.schema("symbol string, timestamp timestamp_ntz, trade_id bigint, kind string").parquet(f"{out}/conflicts").select("symbol", "timestamp", "trade_id", "kind")
