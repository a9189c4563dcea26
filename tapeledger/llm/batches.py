"""Arrow batches of bounded size for the operators that run numpy inside tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 2 << 20


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per context: they need not have the repository."""
    context = spark.sparkContext
    if getattr(context, "_tapeledger_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="tapeledger-"), "tapeledger_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    context._tapeledger_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Prepare a session: the package on the executors, and Arrow batches of a few megabytes, whatever the length of the texts."""
    _ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces whose ``column`` holds at most ``most`` bytes (or one row). Workers live on from task
    to task, so what Arrow keeps of freed memory is given back after every batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        pa.default_memory_pool().release_unused()
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held + n > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The texts of a batch as an array of its own; a missing text is an empty one.

    The cast of a slice has offsets that do not begin at 0, which some Arrow kernels misread: slices are copied first.
    """
    texts = batch.column(column)
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")
