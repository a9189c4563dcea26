"""Bounded-space online packing of token sequences into windows of fixed length.

Every partition keeps a fixed number of windows open. A piece goes into the open window that it fills best; if it
fits none and all are open, the fullest is closed and a new one opened. What is still open at the end of the
partitions is merged best-fit among groups of bounded size, so no task sees more than a fixed number of windows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapeledger.llm.batches import bound_batches, slices, texts_of
from tapeledger.llm.tokens import piece_tokenizer, with_end
from tapeledger.session import cut_lineage

WINDOW, OPEN_WINDOWS, MERGED = 4096, 64, 4096


class OpenWindows:
    """The open windows of one partition; ``put`` places pieces online and gives ``(window, offset)``."""

    def __init__(self, first: int, window: int = WINDOW, most: int = OPEN_WINDOWS) -> None:
        self.next, self.window, self.most = first, window, most
        self.room: list[tuple[int, int]] = []  # (room left, window) in order

    def put(self, length: int) -> tuple[int, int]:
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, name = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                self.room.pop(0)  # the fullest is emitted as it is
            room, name = self.window, self.next
            self.next += 1
        if room > length:
            insort(self.room, (room - length, name))
        return name, self.window - room


def merge_windows(fills: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Best fit, fullest first: for each fill ``(number of its merged window, offset there)``."""
    windows = OpenWindows(0, window, len(fills))
    out = [(0, 0)] * len(fills)
    for i in sorted(range(len(fills)), key=lambda i: -fills[i]):
        out[i] = windows.put(fills[i])
    return out


def pack_documents(documents: DataFrame, tokenizer_file: str, end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if ``with_ids``,
    ``ids`` (little-endian unsigned 32-bit).

    A document is its ids and the end id; a null or empty text is the end id alone. Only documents longer than a
    window are cut: full windows first, then the rest. Each piece lies in one sequence, sequences have no gaps and
    at most ``window`` ids. Repeated rows and rows without id are documents of their own. An empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    definition = spark.sparkContext.broadcast(Path(tokenizer_file).read_text())  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(definition.value)
        windows = OpenWindows(TaskContext.get().partitionId() << 36, window, open_windows)
        for batch in slices(batches, text_col):
            offsets, ids = with_end(*tokenizer.encode(texts_of(batch, text_col)), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            row, start, length, crc, total, name, offset, part = [], [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                a, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                for s in range(0, n, window):
                    size = min(window, n - s)
                    piece = raw[4 * (a + s):4 * (a + s + size)]
                    sequence, at = windows.put(size)
                    row.append(i)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    name.append(sequence)
                    offset.append(at)
                    if with_ids:
                        part.append(bytes(piece))
            columns = [batch.column(id_col).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, name, offset)), pa.nulls(len(row), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(part, pa.binary())] if with_ids else []), names)
        last = [w for _, w in windows.room]  # one row for each window that is left
        empty = [pa.nulls(len(last), key_type), *(pa.nulls(len(last), pa.int64()) for _ in range(4)), pa.array(last, pa.int64()), pa.nulls(len(last), pa.int64()), pa.array([window - r for r, _ in windows.room], pa.int64())]
        yield pa.RecordBatch.from_arrays(empty + ([pa.nulls(len(last), pa.binary())] if with_ids else []), names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "fill", *(["ids"] if with_ids else [])]
    kept = documents.select(id_col, text_col)
    key_type = to_arrow_type(kept.schema[id_col].dataType)
    schema = f"`{id_col}` {dict(kept.dtypes)[id_col]}, " + ", ".join(f"{c} long" for c in names[1:8]) + (", ids binary" if with_ids else "")
    placed = cut_lineage(kept.mapInArrow(run, schema), "packed")
    left = placed.filter("fill is not null").select("sequence_id", "fill")
    groups = max(1, round(left.count() / MERGED))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_id")
        target = merge_windows(pdf["fill"].tolist(), window)
        head = {}
        for w, (number, _) in zip(pdf["sequence_id"], target, strict=True):
            head.setdefault(number, w)
        return pd.DataFrame({"sequence_id": pdf["sequence_id"], "merged": [head[n] for n, _ in target], "shift": [s for _, s in target]})

    merged = left.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g")).applyInPandas(merge, "sequence_id long, merged long, shift long")
    pieces = placed.filter("fill is null").drop("fill").join(merged, "sequence_id", "left")
    return pieces.withColumns({"offset": F.col("offset") + F.coalesce("shift", F.lit(0)), "sequence_id": F.coalesce("merged", "sequence_id")}).select(*(c for c in names if c != "fill"))
