"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) maps a unit vector to its nearest signed
axis. A bucket of a table is the tuple of ``functions`` such axes. Queries look into several buckets of each table, those
whose axes have the largest coordinates. Candidates are ranked by their exact inner product.

Inner products of vectors of any length are reduced to angles: vectors are divided by the largest norm and get one more
coordinate that makes them unit vectors; queries get a zero there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches
from tapeledger.session import cut_lineage

TABLES, PROBES, FUNCTIONS = 16, 8, 1
#: Candidates, and queries, of one bucket that are compared in one tile.
TILE = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation of the rows, padded to a power of two."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, width))
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def buckets(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """``(rows, probes)`` bucket numbers, best first; bucket numbers are mixed-radix tuples of signed axes."""
    best, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for f in range(functions):
        y = rotate(x, 1_000_003 * table + f)
        both = np.concatenate([y, -y], axis=1)
        keep = min(probes, both.shape[1])
        top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
        value = np.take_along_axis(both, top, axis=1)
        all_score = (score[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        all_best = (best[:, :, None] * both.shape[1] + top[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-all_score, axis=1, kind="stable")[:, :probes]
        best, score = np.take_along_axis(all_best, order, axis=1), np.take_along_axis(all_score, order, axis=1)
    return best


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of the ``k`` best of these vectors for each query, its own id left out.

    Rows of one id count as one, by the best of them. The matrix product only preselects, ties and its rounding
    included; scores are summed per pair in one fixed order, so equal vectors have equal scores wherever they lie.
    """
    out_q, out_i, out_s = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    names, first = np.unique(ids, return_index=True)
    group = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(ids))))
    for at in range(0, len(queries), 256):
        block = queries[at:at + 256]
        rough = block @ vectors.T
        rough[query_ids[at:at + 256][:, None] == ids] = -np.inf
        keep = min(k, len(names))
        best = np.maximum.reduceat(rough, first, axis=1)
        edge = -np.partition(-best, keep - 1, axis=1)[:, keep - 1]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        for i, q in enumerate(block):
            some = np.flatnonzero((rough[i] >= edge[i] - slack[i]) & (rough[i] > -np.inf))
            score = np.add.reduce(vectors[some] * q, axis=1)
            by_id = np.lexsort((-score, group[some]))
            by_id = by_id[np.unique(group[some][by_id], return_index=True)[1]]
            top = by_id[np.lexsort((ids[some][by_id], -score[by_id]))[:k]]
            out_q.append(np.full(len(top), query_ids[at + i]))
            out_i.append(ids[some][top])
            out_s.append(score[top])
    none = np.zeros(0)
    return (np.concatenate(out_q) if out_q else none.astype(np.int64), np.concatenate(out_i) if out_i else none.astype(np.int64), np.concatenate(out_s) if out_s else none)


def _in_tiles(rows: DataFrame, tile: int, k: int, dtype: str) -> DataFrame:
    """The ``k`` best candidates of each query within every tile of ``rows(bucket_table, bucket, asks, id, vector)``."""
    sizes = rows.groupBy("bucket_table", "bucket").agg(F.count_if("asks").alias("n_q"), F.count_if(~F.col("asks")).alias("n_c")).filter("n_q > 0 and n_c > 0")
    parts = sizes.select("bucket_table", "bucket", *(F.ceil(F.col(n) / tile).cast("int").alias(p) for n, p in (("n_q", "q"), ("n_c", "c"))))
    tiled = rows.join(parts, ["bucket_table", "bucket"])
    own = lambda p: F.pmod(F.xxhash64("id"), F.col(p)).cast("int")
    over = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.sequence(F.lit(0), F.col("q") - 1)))
    tiled = tiled.withColumn("other", over).withColumns({"i": F.when(F.col("asks"), own("q")).otherwise(F.col("other")), "j": F.when(F.col("asks"), F.col("other")).otherwise(own("c"))})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, asks = np.stack([np.frombuffer(v, dtype) for v in pdf["vector"]]).astype(np.float64), pdf["asks"].to_numpy(bool)
        ids = pdf["id"].to_numpy()
        q, i, s = nearest(ids[~asks], vectors[~asks], ids[asks], vectors[asks], k) if asks.any() and not asks.all() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    return tiled.select("bucket_table", "bucket", "i", "j", "asks", "id", "vector").groupBy("bucket_table", "bucket", "i", "j").applyInPandas(best, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, functions: int = FUNCTIONS) -> DataFrame:
    """The ``k`` nearest rows found for the rows that the SQL condition ``queries`` picks: ``query_id, rank, vec_id, score``.

    Nearness is the inner product in double precision; ties go to the smaller id. A query's own id is no candidate.
    Vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do those of another length
    than the most frequent one, nor rows without id. Rows that share an id count as one neighbour, by their best
    score. A query whose buckets hold fewer than ``k`` candidates is compared with all rows instead. Larger
    corpora take more ``functions`` (axes to a bucket) and ``probes``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    double = "double" in dict(vectors.dtypes)[vector_col]
    dtype = "<f8" if double else "<f4"
    x = F.col(vector_col).cast("array<double>" if double else "array<float>")
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), F.expr(queries).alias("asks"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    valid = valid.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)).withColumn("asks", F.coalesce("asks", F.lit(False)))
    width = valid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if width is None:
        return empty
    d = width["d"]
    valid = cut_lineage(valid.filter(F.size("x") == d), "ann_vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    shortest, longest = valid.select(F.min(square), F.max(square)).first()
    norm, unequal = np.sqrt(longest), shortest < (1 - 1e-5) * longest  # with equal lengths the further coordinate is zero everywhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asks = batch.column("id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            raw = np.array([v.tobytes() for v in x.astype(dtype)], object)
            unit = x.astype(np.float64) / norm
            rest = np.sqrt(np.maximum(0, 1 - (unit ** 2).sum(axis=1)))[:, None]
            ask = unit[asks] / np.linalg.norm(unit[asks], axis=1, keepdims=True)
            if unequal:
                unit, ask = np.concatenate([unit, rest], axis=1), np.concatenate([ask, np.zeros((len(ask), 1))], axis=1)
            for t in range(tables):
                own = buckets(unit, t, functions, 1)[:, 0]
                yield rows(t, own, False, ids, raw)
                if len(ask):
                    into = buckets(ask, t, functions, probes)
                    yield rows(t, into.ravel(), True, np.repeat(ids[asks], into.shape[1]), np.repeat(raw[asks], into.shape[1]))

    def rows(t: int, bucket: np.ndarray, asks: bool, ids: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(bucket), pa.array(np.full(n, asks)), pa.array(ids), pa.array(raw, pa.binary())], ["bucket_table", "bucket", "asks", "id", "vector"])

    schema = "bucket_table int, bucket long, asks boolean, id long, vector binary"
    hashed = cut_lineage(valid.mapInArrow(run, schema), "ann_buckets")
    found = cut_lineage(_in_tiles(hashed, TILE, k, dtype).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "ann_found")
    there = valid.select("id").distinct().count()
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = cut_lineage(valid.filter("asks").select("id").distinct().join(counts, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("n", F.lit(0)) < min(k, there - 1)).select("id"), "ann_short")
    if not short.isEmpty():
        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                    yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int32()).fill_null(-1), pa.nulls(batch.num_rows, pa.int64()).fill_null(0), batch.column("asks"), batch.column("id"), pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary())], ["bucket_table", "bucket", "asks", "id", "vector"])

        again = valid.withColumn("asks", F.lit(False)).unionByName(valid.filter("asks").join(short, "id", "left_semi").select(valid.columns))
        whole = _in_tiles(again.mapInArrow(plain, schema), TILE, k, dtype).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(whole)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
