"""Streaming twins: bars, coverage, as-of prices and the accreting archive as Structured Streaming jobs.

Event time must be a zoned timestamp here (watermarks refuse zone-less ones). Every job keeps its state in the
checkpoint and writes files, so it can be stopped, lose executors and go on."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeledger.functions.timegrid import MINUTE_US, epoch_us, moment
from tapeledger.operators.accrete import KEYS
from tapeledger.operators.asof import PRICE_TOLERANCE_US
from tapeledger.operators.bars import dedupe_by_key, native_traded
from tapeledger.session import cut_lineage


def closed_bars(ticks: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Bars of a tick stream. With a watermark and append mode a bar comes out once, when it is closed; a bar
    still in progress is never stored. Partial aggregates combine before the shuffle, as in batch."""
    at = moment(ticks, "timestamp", "trade_id")
    bars = ticks.withWatermark("timestamp", delay).groupBy("symbol", F.window("timestamp", width).alias("w")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("sz").alias("volume"), F.count("sz").alias("trade_count"))
    return bars.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "trade_count", native_traded(F.col("volume"), F.col("trade_count")).alias("native_traded"))


def coverage(events: DataFrame, delay: str = "10 minutes", gap_minutes: int = 90) -> DataFrame:
    """Coverage intervals of an event stream: sessions that end when nothing follows within the gap."""
    s = events.withWatermark("timestamp", delay).groupBy("symbol", F.session_window("timestamp", f"{gap_minutes} minutes").alias("w")).agg(F.min("timestamp").alias("coverage_start"), F.max("timestamp").alias("coverage_end"), F.count(F.lit(1)).alias("n_events"))
    return s.select("symbol", "coverage_start", "coverage_end", "n_events")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asof_prices(events: DataFrame, quotes: DataFrame, delay: str, tolerance_us: int = PRICE_TOLERANCE_US, sequence: str = "quote_id") -> DataFrame:
    """As-of prices of an event stream ``(symbol, timestamp, ...)`` from a quote stream ``(symbol, timestamp, oracle_px,
    sequence)``; both may be out of order by ``delay``.

    Both sides go into one aggregation by symbol and block of time, no shorter than the tolerance. A block collects its events
    and quotes, each row once, and of the block before only the newest quote. It comes out when the watermark has passed its
    end; a search in the sorted quotes then finds each event's, so events and quotes are never paired and the work grows with
    the rows, however dense they are. A task holds one block of one symbol at a time, not a symbol. Spark keeps and cleans
    the state. Rows of a block behind the watermark are dropped: see ``late_events``."""
    width = max(MINUTE_US, tolerance_us)
    at = F.col("timestamp").alias("_at")
    event = F.struct(*events.columns).alias("_event")
    quote = F.struct(F.col("timestamp").alias("at"), F.col(sequence).alias("n"), F.col("oracle_px").alias("px")).alias("_quote")
    event_type, quote_type = events.select(event).schema["_event"].dataType, quotes.select(quote).schema["_quote"].dataType
    left = events.withWatermark("timestamp", delay).select(F.col("symbol").alias("_symbol"), at, event, F.lit(None).cast(quote_type).alias("_quote"))
    right = quotes.where("symbol is not null").withWatermark("timestamp", delay).select(F.col("symbol").alias("_symbol"), at, F.lit(None).cast(event_type).alias("_event"), quote)
    # a window is a block, its second half, and the block before
    rows = left.unionByName(right).withColumn("_w", F.window("_at", f"{2 * width} microseconds", f"{width} microseconds"))
    own = epoch_us("_at") - epoch_us(F.col("_w.start")) >= width
    blocks = rows.where(own | F.col("_quote").isNotNull()).groupBy("_symbol", "_w").agg(
        F.collect_list(F.when(own, F.col("_event"))).alias("_events"), F.collect_list(F.when(own, F.col("_quote"))).alias("_quotes"), F.max(F.when(~own, F.col("_quote"))).alias("_carry"))
    blocks = blocks.where(F.size("_events") > 0).select("_events", F.sort_array("_quotes").alias("_quotes"), "_carry")
    n, quote_at = F.size("_quotes"), lambda i: F.get("_quotes", i)
    steps = F.when(n > 0, F.sequence(F.floor(F.log2(n)).cast("int") + 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def earlier(e: Column) -> Column:
        """How many quotes of the block are earlier than the event: steps of falling powers of two."""
        def step(found: Column, k: Column) -> Column:
            ahead = found + F.call_function("shiftleft", F.lit(1), k)
            return F.when((ahead <= n) & (quote_at(ahead - 1)["at"] < e["timestamp"]), ahead).otherwise(found)

        return F.aggregate("_steps", F.lit(0), step)

    def newest(x: Column) -> Column:
        """Of quotes at the very time of the event the first counts, of earlier ones the last."""
        here = quote_at(x["found"])
        return F.struct(x["event"].alias("event"), F.when(here["at"] == x["event"]["timestamp"], here).otherwise(F.coalesce(quote_at(x["found"] - 1), F.col("_carry"))).alias("quote"))

    placed = blocks.withColumn("_steps", steps).withColumn("_found", F.transform("_events", lambda e: F.struct(e.alias("event"), earlier(e).alias("found"))))
    best = placed.select(F.explode(F.transform("_found", newest)).alias("_b"))
    near = epoch_us(F.col("_b.event.timestamp")) - epoch_us(F.col("_b.quote.at")) <= tolerance_us
    return best.select("_b.event.*", F.when(near, F.col("_b.quote.px")).alias("oracle_price"), F.when(near, F.col("_b.quote.at")).alias("quote_time"))


def late_events(events: DataFrame, priced: DataFrame, keys: list[str]) -> DataFrame:
    """Events of a finished stream (one whose watermark has passed all of them) that came behind the watermark and so have no row.
    Missing keys count as equal; an event without a time is in no stream and is not late."""
    done = priced.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return events.where("timestamp is not null").join(done, on=same, how="left_anti")


def agreed_pages(pages: DataFrame, keys: list[str], values: list[str], delay: str) -> DataFrame:
    """Overlapping pages of a stream merged: each key once, when the watermark has passed it, with ``n_rows`` (rows that
    gave it) and ``agree`` (whether their values were equal; of unequal ones those of the smallest hash come out).

    ``keys`` hold the event time ``timestamp``. Exact repeats are dropped within the watermark before they reach the
    aggregation, so a page that is read over and over costs one row of state per key and value, and ``n_rows`` counts
    different rows."""
    marked = pages.withWatermark("timestamp", delay).withColumn("_hash", F.xxhash64(*values))
    once = marked.dropDuplicatesWithinWatermark([*keys, "_hash"])
    merged = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min_by(F.struct(*values), "_hash").alias("_row"))
    return merged.select(*keys, "_row.*", "n_rows", (F.col("n_rows") == 1).alias("agree"))


def accrete_stream(stream: DataFrame, out: str, conflict_log: str, checkpoint: str, keys: list[str] = KEYS) -> StreamingQuery:
    """The accreting archive fed by a stream: rows under new keys are appended, stored rows stay.

    Logged, and not stored: keys that came back with other values (``kind=stored``: the key, old and new values) and
    keys whose rows differ within one batch (``kind=batch``: the key and ``n_rows``). Equal repeats collapse. The
    archive is laid out by day, and a batch reads the days it touches, once. Nothing is rewritten; a batch that is
    run again overwrites its own files."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        values = [c for c in batch.columns if c not in keys]
        rows, unequal = dedupe_by_key(batch, keys, values)
        unequal.write.mode("overwrite").parquet(f"{conflict_log}/kind=batch/batch={batch_id}")
        rows = cut_lineage(rows.select(*batch.columns).withColumn("day", F.to_date("timestamp")), "accrete-batch")
        if batch_id > 0:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
            days = [r["day"] for r in rows.select("day").distinct().collect()]  # as many as the batch spans
            stored = spark.read.schema(f"{schema}, batch bigint, day date").parquet(out).where((F.col("batch") < batch_id) & F.col("day").isin(days))
            old = stored.select(*keys, F.struct(*values).alias("old"))
            both = cut_lineage(rows.withColumn("new", F.struct(*values)).join(old, on=keys, how="left"), "accrete-both")
            both.where(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "old", "new").write.mode("overwrite").parquet(f"{conflict_log}/kind=stored/batch={batch_id}")
            rows = both.where("old is null").select(*batch.columns, "day")
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
