"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is ``sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``. The pair term is taken as
half of ``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, linear in the number of features of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tapeledger.llm.batches import bound_batches, slices, spare_names, texts_of
from tapeledger.llm.words import word_codes, word_hashes

WORD_BINS = 1 << 14
FACTORS = 8
#: Labelled rows used for fitting, at most; taken by the hash of the identifier.
MAX_LABELLED = 4000
#: Byte classes counted by the structure statistics; any other byte is of class 0.
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,;:?'\"()-",
    b"!", b"#$%&*+=@^~", b"|/\\<>[]{}_`", bytes(range(0x80, 0x100)), bytes(range(0x20)).translate(None, b"\t\n\r\x0b\x0c") + b"\x7f",
]
N_STATS = len(CLASSES) + 9
N_FEATURES = N_STATS + WORD_BINS


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, chars in enumerate(CLASSES):
        table[np.frombuffer(chars, np.uint8)] = k
    return table


def metadata_column(documents: DataFrame, columns: tuple[str, ...]) -> Column:
    """The columns as ``name=value`` strings; numbers by the power of two below them, so that near values share a feature."""
    def value(c: str) -> Column:
        if isinstance(documents.schema[c].dataType, NumericType):
            x = F.col(c).cast("double")
            return F.when(x.isNotNull() & ~F.isnan(x), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.floor(F.log2(F.abs(x) + 1)).cast("string")))
        return F.col(c).cast("string")

    return F.array(*(F.concat(F.lit(f"{c}="), F.coalesce(value(c), F.lit(""))) for c in columns)).cast("array<string>")


def features(texts: pa.Array, word_bins: int = WORD_BINS, metadata: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse ``(row, feature, value)`` of the texts, sorted by row: statistics first, then hashed words, then the
    hashed ``metadata`` (a list of strings per text), each of value 1/2.

    Statistics are between 0 and 1, so no document's length dominates; word values are square roots of shares
    (unit length per document). An empty text has only the statistics of its length.
    """
    n = len(texts)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    filled = np.flatnonzero(length)
    classes = _byte_classes()[data]
    stats = np.zeros((n, N_STATS))
    if len(filled):
        begins = (offsets[:-1] - offsets[0])[filled]
        for k in range(len(CLASSES)):
            stats[filled, k] = np.add.reduceat(classes == k, begins, dtype=np.int64) / length[filled]
    codes, rows, words = word_codes(texts, lower=False)
    counts = np.bincount(rows, minlength=n)
    some = np.maximum(counts, 1)
    pairs, times = np.unique(rows * max(1, len(words)) + codes, return_counts=True)
    row, code = pairs // max(1, len(words)), pairs % max(1, len(words))
    k = len(CLASSES)
    stats[:, k] = np.bincount(row, minlength=n) / some  # distinct words
    stats[:, k + 1] = np.where(counts > 0, np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (codes[1:] == codes[:-1])], minlength=n) / some, 0) if len(rows) > 1 else 0
    top = np.zeros(n)
    np.maximum.at(top, row, times)
    stats[:, k + 2] = top / some
    stats[:, k + 3] = np.minimum(1, np.log1p(length) / 14)
    stats[:, k + 4] = np.minimum(1, np.log1p(counts) / 12)
    stats[:, k + 5] = np.minimum(1, (length / some) / 20)
    stats[:, k + 6] = counts < 5
    stats[:, k + 7] = counts < 50
    stats[:, k + 8] = length == 0
    share = np.sqrt(times / some[row])
    bins = N_STATS + (word_hashes(words) % np.uint64(word_bins)).astype(np.int64)[code] if len(words) else code
    r, c = np.divmod(np.arange(n * N_STATS), N_STATS)
    told = np.zeros(0, np.int64)
    if metadata is not None:
        told = pc.list_parent_indices(metadata).to_numpy(zero_copy_only=False).astype(np.int64)
    about = N_STATS + (word_hashes([f"\0{x}" for x in metadata.flatten().to_pylist()]) % np.uint64(word_bins)).astype(np.int64) if len(told) else told
    all_rows, all_bins, all_values = np.concatenate([r, row, told]), np.concatenate([c, bins, about]), np.concatenate([stats.ravel(), share, np.full(len(told), 0.5)])
    keep = all_values != 0
    order = np.argsort(all_rows[keep], kind="stable")
    return all_rows[keep][order], all_bins[keep][order], all_values[keep][order]


def features_in_parts(texts: pa.Array, word_bins: int = WORD_BINS, rows: int = 250, metadata: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of many texts, a few at a time, so that only the sparse result is held whole."""
    parts = [features(texts.slice(at, rows), word_bins, None if metadata is None else metadata.slice(at, rows)) for at in range(0, len(texts), rows)] or [features(texts, word_bins)]
    return (np.concatenate([p[0] + rows * i for i, p in enumerate(parts)]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def sums(self, row: np.ndarray, bin_: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(margin, sum_i v_if x_i)`` per document."""
        linear = np.bincount(row, self.weight[bin_] * value, n)
        inner = np.empty((n, self.factor.shape[1]))
        pair = np.zeros(n)
        for f in range(self.factor.shape[1]):
            vx = self.factor[bin_, f] * value
            inner[:, f] = np.bincount(row, vx, n)
            pair += inner[:, f] ** 2 - np.bincount(row, vx * vx, n)
        return self.bias + linear + pair / 2, inner

    def score(self, texts: pa.Array, metadata: pa.Array | None = None) -> np.ndarray:
        row, bin_, value = features(texts, metadata=metadata)
        return 1 / (1 + np.exp(-np.clip(self.sums(row, bin_, value, len(texts))[0], -30, 30)))


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 25, rate: float = 0.1, decay: float = 1e-4, seed: int = 7, metadata: pa.Array | None = None) -> Machine:
    """Fit by AdaGrad over mini-batches of 256 documents, both classes weighted by the root of their rarity.

    Without rows of both classes the machine gives every document the share of label 1 (a half without rows).
    """
    rng = np.random.default_rng(seed)
    y = labels.astype(float)
    model = Machine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.01, (N_FEATURES, FACTORS)))
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Machine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)))
    share = y.mean()
    importance = np.where(y == 1, 1.0, np.sqrt(share / (1 - share)))
    row, bin_, value = features_in_parts(texts, metadata=metadata)
    start = np.searchsorted(row, np.arange(len(y) + 1))
    g_w, g_v, g_b = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, FACTORS), 1e-2), 1e-2
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            docs = np.sort(order[at:at + 256])
            pick = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
            r = np.searchsorted(docs, row[pick])
            b, x = bin_[pick], value[pick]
            margin, inner = model.sums(r, b, x, len(docs))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[docs]) * importance[docs] / len(docs)
            used, at_used = np.unique(b, return_inverse=True)
            d_w = np.bincount(at_used, slope[r] * x, len(used)) + decay * model.weight[used]
            g_w[used] += d_w ** 2
            model.weight[used] -= rate * d_w / np.sqrt(g_w[used])
            for f in range(FACTORS):
                v = model.factor[b, f]
                d_v = np.bincount(at_used, slope[r] * x * (inner[r, f] - v * x), len(used)) + decay * model.factor[used, f]
                g_v[used, f] += d_v ** 2
                model.factor[used, f] -= rate * d_v / np.sqrt(g_v[used, f])
            d_b = slope.sum()
            g_b += d_b ** 2
            model.bias -= rate * d_b / np.sqrt(g_b)
    return model


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED, metadata: tuple[str, ...] = ()) -> Machine:
    """Fit on at most ``most`` labelled rows (a bounded sample, the same for the same rows).

    ``metadata`` names columns of ``documents`` whose values are hashed into features of their own.

    Rows whose label is neither 0 nor 1 or whose identifier is null are left out; conflicting labels of one
    document are left out too. Identifier and label serve to pick rows only.
    """
    clean = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_y2")).filter("_y = _y2")
    chosen = clean.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", "_y")
    known = documents.select(F.col(id_col).alias("_id"), F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), metadata_column(documents, metadata).alias("told")).alias("_row")).join(chosen, "_id")
    rows = known.groupBy("_id").agg(F.min("_row").alias("_row"), F.min("_y").alias("_y")).orderBy("_id").select("_id", "_row.text", "_row.told", "_y").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit(pa.array([], pa.string()), np.zeros(0))
    return fit(rows.column("text").combine_chunks(), rows.column("_y").to_numpy(), metadata=rows.column("told").combine_chunks() if metadata else None)


def score_documents(documents: DataFrame, model: Machine, text_col: str = "text", score_col: str = "score", metadata: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` with ``score_col``, the probability of label 1 (a column of that name is replaced).

    ``metadata`` names the columns that ``train`` was given. Null texts are scored as empty ones; every row is scored, repeated ones alike.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    documents = documents.drop(score_col)
    (told,) = spare_names(documents, "told")
    kept = documents.columns
    fitted = spark.sparkContext.broadcast(model)  # of fixed size: (statistics + word bins) x (1 + factors) numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            likely = fitted.value.score(texts_of(batch, text_col), batch.column(told) if metadata else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(likely)], [*kept, score_col])

    given = documents.withColumn(told, metadata_column(documents, metadata)) if metadata else documents
    return given.mapInArrow(score, documents.withColumn(score_col, F.lit(0.0)).schema)
