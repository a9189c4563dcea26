"""Stored bars and funding: one dataset partitioned by venue and frequency, clustered by symbol and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeledger.operators.bars import BAR_COLUMNS
from tapeledger.operators.quality import BAR_TYPES, FUNDING_COLUMNS, FUNDING_TYPES, assert_bar_schema, assert_funding_schema

BAR_SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampType())] + [T.StructField(c, BAR_TYPES[c]) for c in BAR_COLUMNS[1:]])
FUNDING_SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampType())] + [T.StructField(c, FUNDING_TYPES[c]) for c in FUNDING_COLUMNS[1:]])


def _range(df: DataFrame, symbols: list[str] | None, start, end) -> DataFrame:
    kind = df.schema["timestamp"].dataType
    t = F.col("timestamp")
    kept = df.where((t >= F.lit(start).cast(kind)) & (t < F.lit(end).cast(kind)))
    return kept if symbols is None else kept.where(F.col("symbol").isin(symbols))


def scan_bars(bars: DataFrame, symbols: list[str] | None, start, end, ordered: bool = True) -> DataFrame:
    """Bars of the symbols in ``[start, end)``. Filters are plain column predicates, so they reach the parquet scan."""
    kept = _range(bars, symbols, start, end)
    return kept.orderBy("symbol", "timestamp") if ordered else kept


def scan_funding(funding: DataFrame, symbols: list[str] | None, start, end) -> DataFrame:
    return _range(funding, symbols, start, end)


def read_bars(spark: SparkSession, path: str, venue: str | None = None, frequency: str | None = None) -> DataFrame:
    """Bars of a store; venue and frequency are directories, so only those that are asked for are listed."""
    schema = T.StructType([*BAR_SCHEMA.fields, T.StructField("is_aggregated", T.BooleanType()), T.StructField("venue", T.StringType()), T.StructField("frequency", T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    for name, value in (("venue", venue), ("frequency", frequency)):
        df = df if value is None else df.where(F.col(name) == value)
    return df


def write_bars(bars: DataFrame, path: str, venue: str, frequency: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Check the schema, cluster by symbol and time, write. Range partitioning splits a symbol that has more rows
    than one file should hold."""
    assert_bar_schema(bars)
    clustered = bars.repartitionByRange(*([partitions] if partitions else []), "symbol", "timestamp").sortWithinPartitions("symbol", "timestamp")
    out = clustered.withColumns({"venue": F.lit(venue), "frequency": F.lit(frequency)})
    if "is_aggregated" not in bars.columns:
        out = out.withColumn("is_aggregated", F.lit(False))
    out.write.mode(mode).partitionBy("venue", "frequency").parquet(path)


def write_funding(funding: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    assert_funding_schema(funding)
    funding.repartitionByRange(*([partitions] if partitions else []), "symbol", "timestamp").sortWithinPartitions("symbol", "timestamp").write.mode(mode).parquet(path)


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FUNDING_SCHEMA).parquet(path)
