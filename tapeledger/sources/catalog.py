"""Dataset catalogue: one JSON sidecar per dataset, read as one table and joined to the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR_DDL = (
    "dataset_id string, source_venue string, source_type string, native_or_proxy string, proxy_for string, retrieved_at string, start_timestamp string, end_timestamp string, symbols array<string>, "
    "frequency string, processing_version string, endpoint string, request_windows array<array<bigint>>, api_response_count bigint, code_version string, excluded_backfill_bars map<string,bigint>, "
    "coverage_segments array<string>, notes string, hl_symbol string, binance_symbol string, unit_multiplier bigint, hl_unit_multiplier bigint, venue_unit_multiplier bigint, "
    "checksum_manifest_entries array<struct<symbol:string,month:string,url:string,sha256:string,rows:bigint,first_ts:bigint,last_ts:bigint>>"
)
DATASET_TYPES = ["ohlcv", "funding_rate"]


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return parse_sidecars(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True))


def parse_sidecars(text: DataFrame) -> DataFrame:
    """Sidecar documents (column ``value``). Old ones hold a single multiplier, which then stands for both."""
    d = text.select(F.from_json("value", SIDECAR_DDL).alias("d")).select("d.*")
    return d.withColumns({
        "own_unit_multiplier": F.coalesce("hl_unit_multiplier", "unit_multiplier"), "venue_unit_multiplier": F.coalesce("venue_unit_multiplier", "unit_multiplier"),
        "own_symbol": F.col("hl_symbol"), "venue_symbol": F.col("binance_symbol"), **{c: F.col(c).try_cast("timestamp") for c in ("retrieved_at", "start_timestamp", "end_timestamp")},
    }).drop("unit_multiplier", "hl_unit_multiplier", "hl_symbol", "binance_symbol")


def sidecar_findings(text: DataFrame, name: str = "file") -> DataFrame:
    """(name, code) of documents (columns ``name`` and ``value``) that are no JSON object, name no dataset or repeat one."""
    known = text.withColumns({"_d": F.from_json("value", SIDECAR_DDL), "_object": F.from_json("value", "map<string,string>").isNotNull()})
    named = known.withColumn("_id", F.col("_d.dataset_id"))
    code = F.when(~F.col("_object"), "UNPARSEABLE_SIDECAR").when(F.trim(F.coalesce("_id", F.lit(""))) == "", "MISSING_DATASET_ID")
    single = named.select(name, code.alias("code")).where("code is not null")
    repeated = named.where(code.isNull()).groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias("_first")).where("_n > 1")
    again = named.join(repeated, on="_id").where(F.col(name) != F.col("_first")).select(name, F.lit("DUPLICATE_DATASET").alias("code"))
    return single.unionByName(again)


def write_sidecars(catalog: DataFrame, path: str, mode: str = "append") -> None:
    catalog.write.mode(mode).json(path)


def catalog_findings(catalog: DataFrame) -> DataFrame:
    """Broken rules: dataset_id, code."""
    col, when = F.col, F.when
    codes = F.array_compact(F.array(
        when(~F.coalesce(col("native_or_proxy").isin("native", "proxy"), F.lit(False)), "BAD_NATIVE_OR_PROXY"),
        when((col("source_venue") == "Hyperliquid") & (col("native_or_proxy") != "native"), "OWN_VENUE_NOT_NATIVE"),
        when((col("source_venue") == "Binance") & (col("native_or_proxy") != "proxy"), "OTHER_VENUE_NOT_PROXY"),
        when((col("native_or_proxy") == "proxy") & ~F.coalesce(F.length(F.trim("proxy_for")) > 0, F.lit(False)), "PROXY_FOR_REQUIRED"),
        when(col("source_type").isNotNull() & ~col("source_type").isin(DATASET_TYPES), "BAD_DATASET_TYPE"),
    ))
    return catalog.select("dataset_id", F.explode(codes).alias("code"))


def catalog_status(datasets: DataFrame, catalog: DataFrame, version: str) -> DataFrame:
    """Each stored dataset: OK, MISSING (no sidecar) or VERSION_MISMATCH (processed by another version)."""
    d = datasets.select("dataset_id").join(catalog.select("dataset_id", "processing_version"), on="dataset_id", how="left")
    known = F.col("processing_version").isNotNull()
    return d.select("dataset_id", "processing_version", F.when(~known, "MISSING").when(F.col("processing_version") != version, "VERSION_MISMATCH").otherwise("OK").alias("catalog_status"))


def as_provenance(catalog: DataFrame) -> DataFrame:
    """The part of a sidecar that travels with results: venue, type, span, origin, mapping and notes."""
    mapped = F.concat(F.col("own_symbol"), F.lit("->"), F.col("venue_symbol"), F.lit(" ("), F.col("own_unit_multiplier").cast("string"), F.lit(", "), F.col("venue_unit_multiplier").cast("string"), F.lit(")"))
    notes = F.concat_ws("; ", F.concat(F.lit("code_version="), "code_version"), F.concat(F.lit("api_response_count="), F.col("api_response_count").cast("string")), F.concat(F.lit("checksum_manifest_entries="), F.size("checksum_manifest_entries").cast("string")), "notes")
    return catalog.select(
        "dataset_id", "source_venue", F.coalesce("source_type", F.lit("ohlcv")).alias("field_type"), F.col("start_timestamp").alias("span_start"), F.col("end_timestamp").alias("span_end"), "native_or_proxy", "proxy_for",
        "processing_version", F.to_date("retrieved_at").alias("retrieval_date"), F.coalesce(mapped, F.array_join("symbols", ",")).alias("symbol_mapping"), notes.alias("notes"),
    )
