"""The accreting archive: stored rows win, corrections are explicit, nothing may shrink.

All steps are equality joins on (symbol, timestamp), a near-unique key, so no task depends on how many rows one
symbol has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.digest import table_digest
from tapeledger.functions.timegrid import HOUR_US, epoch_us
from tapeledger.operators.bars import BAR_VALUES, dedupe_by_key

KEYS = ["symbol", "timestamp"]


def accrete(stored: DataFrame, fetched: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Stored rows as they are, plus fetched rows under new keys. Equal repeats of a fetched key count once; a new key
    whose fetched rows differ is not stored (``duplicate_keys`` and ``dedupe_by_key`` report it)."""
    fresh, _ = dedupe_by_key(fetched.select(*stored.columns).join(stored.select(*keys), on=keys, how="left_anti"), keys)
    return stored.unionByName(fresh.select(*stored.columns))


def _packed(df: DataFrame, name: str, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, F.struct(*[F.col(c) for c in values]).alias(name))


def conflicts(stored: DataFrame, fetched: DataFrame, keys: list[str] = KEYS, values: list[str] = BAR_VALUES) -> DataFrame:
    """Keys on both sides whose values differ (NULL equals NULL, NaN equals NaN)."""
    both = _packed(stored, "old", keys, values).join(_packed(fetched, "new", keys, values), on=keys)
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def duplicate_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys that occur more than once; accretion expects none on either side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def regression_guard(stored: DataFrame, union: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Per symbol: row counts and first bar before and after, and whether a write would lose rows or history."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.min("timestamp").alias(f"{name}_start"))

    both = side(stored, "stored").join(side(union, "union"), on=keys, how="full_outer")
    shrinks = F.coalesce(F.col("union_rows"), F.lit(0)) < F.coalesce(F.col("stored_rows"), F.lit(0))
    later = F.coalesce(F.col("union_start") > F.col("stored_start"), F.lit(False))
    return both.withColumn("regression", shrinks | later)


def refresh_window(stored: DataFrame, bars_back: int = 3, width_us: int = HOUR_US, keys: list[str] = ["symbol"]) -> DataFrame:
    """Where the next fetch of each symbol starts: the last stored bar minus a few bars."""
    last = stored.groupBy(*keys).agg(F.max("timestamp").alias("last_bar"))
    return last.withColumn("fetch_start", F.timestamp_micros(epoch_us("last_bar") - bars_back * width_us).cast("timestamp_ntz"))


def changed_symbols(stored: DataFrame, union: DataFrame, columns: list[str], keys: list[str] = ["symbol"]) -> DataFrame:
    """Digest before and after per symbol; a symbol whose digest is equal needs no write."""
    old = table_digest(stored, columns, keys).select(*keys, F.col("digest").alias("_old"))
    new = table_digest(union, columns, keys).select(*keys, F.col("digest").alias("_new"), "n_rows")
    both = new.join(old, on=keys, how="left")
    return both.select(*keys, "n_rows", (~F.col("_old").eqNullSafe(F.col("_new"))).alias("needs_write"))


def reconcile_actions(
    stored: DataFrame, fresh: DataFrame, now: Column, trailing_only: bool = False, width_us: int = HOUR_US, values: list[str] = BAR_VALUES,
) -> DataFrame:
    """What an explicit correction would do to each stored row: KEEP, REPLACE, or REFUSE. A fresh bar counts only
    once it is closed; a fresh placeholder (no volume, no trades) never replaces a traded bar. With
    ``trailing_only`` just the last stored bar of a symbol may change."""
    closed = fresh.where(epoch_us("timestamp") + F.lit(width_us) <= epoch_us(now))
    both = _packed(stored, "old", KEYS, values).join(_packed(closed, "new", KEYS, values), on=KEYS, how="left")
    differs = F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    empty = lambda side: (F.col(f"{side}.volume") == 0) & (F.col(f"{side}.trade_count") == 0)
    downgrade = ~F.coalesce(empty("old"), F.lit(False)) & F.coalesce(empty("new"), F.lit(False))
    action = F.when(~differs, "KEEP").when(downgrade, "REFUSE").otherwise("REPLACE")
    if trailing_only:
        last = stored.groupBy("symbol").agg(F.max("timestamp").alias("_last"))
        both = both.join(last, on="symbol")
        plain = F.when(differs, "REPLACE").otherwise("KEEP")
        action = F.when(F.col("timestamp") == F.col("_last"), plain).otherwise("KEEP")
    return both.withColumn("action", action).select(*KEYS, "old", "new", "action")


def apply_reconciliation(stored: DataFrame, actions: DataFrame, values: list[str] = BAR_VALUES) -> DataFrame:
    """Stored rows with the REPLACE values put in. The set of keys cannot change."""
    swaps = actions.where("action = 'REPLACE'").select(*KEYS, F.col("new").alias("_new"))
    joined = stored.join(swaps, on=KEYS, how="left")
    put = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in values}
    return joined.withColumns(put).select(*stored.columns)


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Totals per symbol and over all symbols (symbol NULL) from per-symbol outcomes."""
    return outcomes.rollup("symbol").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum("n_rows").cast("bigint").alias("n_rows"),
        F.sum("conflicts").cast("bigint").alias("conflicts"), F.min("start_timestamp").alias("start_timestamp"), F.max("end_timestamp").alias("end_timestamp"),
    )
