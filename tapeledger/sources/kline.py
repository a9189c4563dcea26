"""Monthly kline archives: zip files of CSV with and without a header, checked against their digests.

One job reads all files of all symbols. Files are independent, so the unzipping is spread over tasks by file;
lines, not files, are what later steps work on."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.operators.bars import dedupe_by_key, drop_leading_placeholders, native_traded
from tapeledger.operators.quality import ohlc_violation_codes

# Fixed values of the archive format.
KLINE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"]
FIELDS_NEEDED = 11
ROWS_PER_MONTH = 730
PARQUET_PER_ZIP_BYTE = 49.2 / 52.3

_LINE_DDL = "file string, line_no bigint, line string, error string"
_LINES_AT_ONCE = 50_000


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(name: str, first: int, lines: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"file": name, "line_no": range(first, first + len(lines)), "line": lines, "error": None})

    for batch in batches:
        for name, content in zip(batch["file"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = name.rsplit("/", 1)[-1].removesuffix(".zip") + ".csv"
                    names = z.namelist()
                    if inner not in names and len(names) != 1:
                        raise ValueError("UNEXPECTED_MEMBERS")
                    z.testzip()  # a damaged member is found before any of its lines is given out
                    with io.TextIOWrapper(z.open(inner if inner in names else names[0]), "utf-8", newline=None) as text:
                        first, lines = 0, []
                        for line in text:
                            lines.append(line.rstrip("\n"))
                            if len(lines) == _LINES_AT_ONCE:
                                yield rows(name, first, lines)
                                first, lines = first + len(lines), []
                        yield rows(name, first, lines)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, UnicodeDecodeError, ValueError) as e:
                code = str(e) if str(e) == "UNEXPECTED_MEMBERS" else "UNREADABLE_ARCHIVE"
                yield pd.DataFrame({"file": [name], "line_no": [None], "line": [None], "error": [code]}).astype({"line_no": "Int64"})


def archive_pattern(symbols: list[str] | None = None, months: list[str] | None = None) -> str:
    """The file names of some venue symbols and months (or days), as a pattern for the listing: other files are never opened."""
    one = lambda names: "*" if names is None else "{" + ",".join(names) + "}"
    return f"{one(symbols)}-1h-{one(months)}.zip"


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Archive files: file, content, length, sha256. The listing is pruned by ``pattern`` (see ``archive_pattern``), and the
    bytes are read only by plans that use ``content`` or ``sha256``. Spark lists and opens the files, so they may lie in
    any store it reaches; a source of our own in Python could not."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("file"), "content", "length", F.sha2("content", 256).alias("sha256"))


def zip_lines(lines: DataFrame) -> DataFrame:
    """The archive of each file of ``lines(file, line_no, line)``: ``file, content``. A file is a month of bars at most."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        name, out = pdf["file"].iloc[0], io.BytesIO()
        member = zipfile.ZipInfo(name.rsplit("/", 1)[-1].removesuffix(".zip") + ".csv")  # no time stamp: equal lines give equal bytes
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(member, "\n".join(pdf.sort_values("line_no")["line"]) + "\n", zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"file": [name], "content": [out.getvalue()]})

    return lines.groupBy("file").applyInPandas(pack, "file string, content binary")


def read_sidecars(spark: SparkSession, path: str, pattern: str = "*.CHECKSUM") -> DataFrame:
    t = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return t.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.CHECKSUM$", "").alias("file"), "value")


def archive_lines(archives: DataFrame) -> DataFrame:
    """The lines of every archive that can be read; ``archive_findings`` names the others."""
    return archives.select("file", "content").mapInPandas(_unzip, _LINE_DDL).where("error is null").drop("error")


def archive_findings(archives: DataFrame) -> DataFrame:
    """(file, code) for archives that are damaged or hold other members than expected. The job goes on."""
    return archives.select("file", "content").mapInPandas(_unzip, _LINE_DDL).where("error is not null").select("file", F.col("error").alias("code")).distinct()


def checksum_audit(archives: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Status of each archive (file, sha256) against its sidecar text ``<digest>  <name>``: OK, MISSING_SIDECAR,
    MALFORMED_SIDECAR, WRONG_NAME or MISMATCH."""
    parts = F.split(F.trim("value"), r"\s+")
    d = archives.select("file", "sha256").join(sidecars.select("file", "value"), on="file", how="left")
    name = F.element_at(F.split("file", "/"), -1)
    status = (
        F.when(F.col("value").isNull(), "MISSING_SIDECAR").when(F.size(parts) < 2, "MALFORMED_SIDECAR")
        .when(F.get(parts, F.lit(1)) != name, "WRONG_NAME").when(F.get(parts, F.lit(0)) != F.col("sha256"), "MISMATCH").otherwise("OK")
    )
    return d.select("file", status.alias("checksum_status"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Kline rows of all lines. Whether a file has a header shows in its own first line: ``open_time`` there is a
    header, a number is data, anything else is an error. ``error`` is set on lines that cannot be used."""
    parts = F.split("line", ",")
    first = F.get(parts, F.lit(0))
    header = (F.col("line_no") == 0) & (first == "open_time")
    kept = lines.where(~header & (F.trim("line") != ""))
    at = lambda i: F.get(parts, F.lit(i))
    stamp = first.try_cast("bigint")
    error = F.when((F.col("line_no") == 0) & stamp.isNull(), "UNKNOWN_FIRST_LINE").when(F.size(parts) < FIELDS_NEEDED, "TOO_FEW_FIELDS").when(stamp.isNull() | at(8).try_cast("bigint").isNull(), "NOT_A_NUMBER")
    return kept.select(
        "file", "line_no", F.timestamp_millis(stamp).cast("timestamp_ntz").alias("timestamp"), *[at(i + 1).try_cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))],
        at(8).try_cast("bigint").alias("trade_count"), error.alias("error"),
    )


def venue_symbol_of(file) -> F.Column:
    """``BTCUSDT-1h-2024-01.zip`` -> ``BTCUSDT``."""
    return F.regexp_extract(file, r"([^/]+)-1h-[^/]*$", 1)


def normalise_klines(rows: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, conflicts, findings) under our own symbols. Equal rows at file boundaries collapse, unequal ones are
    conflicts; the untraded run before a symbol's first trade is dropped."""
    named = rows.withColumn("venue_symbol", venue_symbol_of(F.col("file"))).join(mapping.where("status = 'mapped'").select("symbol", "venue_symbol"), on="venue_symbol")
    named = named.withColumn("native_traded", native_traded(F.col("volume"), F.col("trade_count")))
    values = ["open", "high", "low", "close", "volume", "trade_count", "native_traded"]
    usable = named.where("error is null").select("symbol", "timestamp", *values)
    bars, conflicts = dedupe_by_key(usable, ["symbol", "timestamp"], values)
    broken = named.where("error is not null").select("symbol", "timestamp", F.col("error").alias("code"))
    malformed = usable.select("symbol", "timestamp", F.explode(ohlc_violation_codes()).alias("code"))
    return drop_leading_placeholders(bars), conflicts, broken.unionByName(malformed)


def file_manifest(rows: DataFrame) -> DataFrame:
    """Rows and time span of each file."""
    return rows.where("error is null").groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def size_estimate(files: DataFrame, bytes_per_row: F.Column, rows_per_file: int = ROWS_PER_MONTH, limit_gb: float | None = None) -> DataFrame:
    """Expected rows and gigabytes of an ingest from the listing alone, and whether it stays under ``limit_gb``
    (always, if there is none)."""
    n = F.count(F.lit(1))
    rows = n * F.lit(rows_per_file)
    out = files.agg(n.alias("n_files"), rows.alias("n_rows"))
    zipped = F.col("n_rows") * bytes_per_row / 1e9
    out = out.withColumn("zip_gb", zipped).withColumn("parquet_gb", F.col("zip_gb") * PARQUET_PER_ZIP_BYTE)
    return out.withColumn("within_limit", F.lit(True) if limit_gb is None else F.col("parquet_gb") <= limit_gb)


def require_within_limit(estimate: DataFrame) -> None:
    row = estimate.first()
    if not row["within_limit"]:
        raise ValueError(f"the ingest would write {row['parquet_gb']:.3f} GB, more than allowed")
