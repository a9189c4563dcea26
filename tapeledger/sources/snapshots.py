"""Write-once snapshots of table slices, listed by digest and row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.digest import table_digest


def closed_slice(df: DataFrame, start, end) -> DataFrame:
    """Rows of ``[start, end]``; sealed windows include both ends."""
    kind = df.schema["timestamp"].dataType
    return df.where(F.col("timestamp").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def manifest(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return table_digest(df, columns, keys)


def seal(df: DataFrame, root: str, dataset_id: str, start, end, columns: list[str] | None = None) -> DataFrame:
    """Store a closed slice once (a second seal of the same id fails) and return its manifest row."""
    piece = closed_slice(df, start, end)
    path = f"{root}/{dataset_id}"
    piece.write.mode("errorifexists").parquet(path)
    stored = df.sparkSession.read.schema(piece.schema).parquet(path).withColumn("dataset_id", F.lit(dataset_id))
    return manifest(stored, columns or piece.columns, ["dataset_id"]).withColumn("path", F.lit(path))


def store_by_content(df: DataFrame, root: str, columns: list[str] | None = None) -> str:
    """Store a table under its own digest; storing the same rows again finds the copy that is there."""
    marked = df.withColumn("_all", F.lit(1))
    digest = table_digest(marked, columns or df.columns, ["_all"]).first()
    path = f"{root}/{digest['digest'] if digest else 'empty'}"
    df.write.mode("ignore").parquet(path)
    return path
