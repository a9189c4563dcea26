"""Raw JSON responses of a venue: candle pages and funding pages, as stored (gzip JSON) or as a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.functions.numeric import finite
from tapeledger.functions.timegrid import FREQUENCY_US
from tapeledger.operators.bars import dedupe_by_key, native_traded
from tapeledger.operators.quality import ohlc_violation_codes

# Fixed values of the raw formats; prices and sizes are strings there.
CANDLE_DDL = "array<struct<t:bigint,T:bigint,s:string,i:string,o:string,h:string,l:string,c:string,v:string,n:bigint>>"
FUNDING_DDL = "array<struct<coin:string,fundingRate:string,premium:string,time:bigint>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Archived responses, one JSON array per file; gzip files are read as they are."""
    return spark.read.text(path, wholetext=True)


def write_pages(pages: DataFrame, path: str) -> None:
    pages.select("value").write.option("compression", "gzip").mode("errorifexists").text(path)


def page_findings(pages: DataFrame, ddl: str = CANDLE_DDL) -> DataFrame:
    """Pages that are no JSON array of the given kind. Their rows are in no table; the digest names the page."""
    whole = F.from_json("value", "array<string>")
    parsed = F.from_json(F.regexp_replace("value", r'"T"\s*:', '"close_ms":'), ddl.replace("T:bigint", "close_ms:bigint"))
    broken = whole.isNull() | parsed.isNull() | F.exists(F.coalesce(parsed, F.array()), lambda x: x.isNull())
    return pages.where(broken).select(F.sha2("value", 256).alias("page"), F.length("value").cast("bigint").alias("n_chars"), F.lit("UNPARSEABLE_PAGE").alias("code"))


def parse_candles(pages: DataFrame) -> DataFrame:
    """Candles of all pages with times and numbers cast; repeated candles of overlapping pages are still there."""
    # Spark field names ignore case by default, so t and T are told apart by renaming one in the text
    renamed = F.regexp_replace("value", r'"T"\s*:', '"close_ms":')
    ddl = CANDLE_DDL.replace("T:bigint", "close_ms:bigint")
    c = pages.select(F.explode(F.from_json(renamed, ddl)).alias("c")).select("c.*")
    numbers = {long: F.col(short).try_cast("double") for long, short in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))}
    return c.select(
        F.timestamp_millis("t").cast("timestamp_ntz").alias("timestamp"), F.col("s").alias("symbol"), F.col("i").alias("frequency"), *[v.alias(k) for k, v in numbers.items()],
        F.col("n").alias("trade_count"), "t", "close_ms",
    ).withColumn("native_traded", native_traded(F.col("volume"), F.col("trade_count")))


def candle_findings(candles: DataFrame) -> DataFrame:
    """Candles that break a rule: wrong close time for their width, or a malformed bar."""
    width = F.element_at(F.create_map(*[x for f, us in FREQUENCY_US.items() for x in (F.lit(f), F.lit(us // 1000))]), F.col("frequency"))
    late = F.when(F.col("close_ms").isNotNull() & (F.col("close_ms") != F.col("t") + width - 1), "BAD_CLOSE_TIME")
    codes = F.concat(F.array_compact(F.array(late)), ohlc_violation_codes())
    return candles.select("symbol", "timestamp", F.explode(codes).alias("code"))


def normalise_candles(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, conflicts, findings): pages are merged, equal repeats collapse, unequal repeats are conflicts. A page that
    does not parse is a finding without symbol and time."""
    candles = parse_candles(pages)
    values = ["open", "high", "low", "close", "volume", "trade_count", "native_traded"]
    bars, conflicts = dedupe_by_key(candles.select("symbol", "timestamp", *values), ["symbol", "timestamp"], values)
    unread = page_findings(pages).select(F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), "code")
    return bars, conflicts, candle_findings(candles).distinct().unionByName(unread)


def parse_funding(pages: DataFrame) -> DataFrame:
    """Funding events with millisecond times kept and the rate as given."""
    e = pages.select(F.explode(F.from_json("value", FUNDING_DDL)).alias("e")).select("e.*")
    return e.select(
        F.timestamp_millis("time").cast("timestamp_ntz").alias("timestamp"), F.col("coin").alias("symbol"), F.col("fundingRate").try_cast("double").alias("funding_rate"),
        F.col("premium").try_cast("double").alias("premium"), F.lit(None).cast("double").alias("notional_price"),
    )


def funding_page_findings(funding: DataFrame) -> DataFrame:
    return funding.where(~finite(F.col("funding_rate"))).select("symbol", "timestamp", F.lit("NON_FINITE_RATE").alias("code"))


def parse_universe(meta: DataFrame, listing: DataFrame | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Instrument metadata (column ``value``, one JSON document) as a table; the index is the array position."""
    ddl = "struct<universe:array<struct<name:string,szDecimals:int,maxLeverage:int,isDelisted:boolean>>>"
    u = meta.select(F.from_json("value", ddl).alias("m")).select(F.posexplode("m.universe").alias("asset_index", "u"))
    out = u.select(
        F.col("u.name").alias("symbol"), "asset_index", F.col("u.szDecimals").alias("sz_decimals"), F.col("u.maxLeverage").alias("max_leverage"),
        F.coalesce("u.isDelisted", F.lit(False)).alias("is_delisted"), F.when(F.startswith("u.name", F.lit("k")), 1000).otherwise(1).alias("unit_multiplier"),
        F.lit(False).alias("survivorship_safe"),
    )
    if symbols is not None:
        out = out.where(F.col("symbol").isin(symbols))
    return out if listing is None else out.join(listing.select("symbol", "first_native_bar", "last_native_bar"), on="symbol", how="left")


_CONTEXT_DDL = "time bigint, coin string, funding string, open_interest string, prev_day_px string, day_ntl_vlm string, premium string, oracle_px double, date date"


def read_contexts(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Context rows of CSV files in a folder per day (``date=2024-01-31``). Other days are not opened, and only the
    columns that a plan uses are parsed."""
    rows = spark.read.schema(_CONTEXT_DDL).option("header", "true").csv(path)
    rows = rows if first is None else rows.where(F.col("date") >= F.lit(first).cast("date"))
    return rows if last is None else rows.where(F.col("date") <= F.lit(last).cast("date"))


def parse_contexts(csv_rows: DataFrame) -> DataFrame:
    """Context rows (time in epoch ms, coin, oracle_px, ...) cut down to the three columns the price join needs."""
    return csv_rows.select(
        F.col("coin").alias("symbol"), F.timestamp_millis(F.col("time").cast("bigint")).cast("timestamp_ntz").alias("timestamp"), F.col("oracle_px").cast("double").alias("oracle_px")
    )
