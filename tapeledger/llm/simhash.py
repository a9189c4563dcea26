"""SimHash fingerprints of whole texts and exact search of all fingerprints within a Hamming radius.

Each distinct word (A-Z lower-cased) votes with weight ``1 + ln(count)`` on 64 signed bits. For the search the 64 bits are
cut into ``blocks`` blocks; two fingerprints that differ in at most ``radius`` bits agree on ``blocks - radius`` whole
blocks, so there is one table for each choice of so many blocks, keyed by these bits: no neighbour is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices
from tapeledger.llm.words import word_codes, word_hashes
from tapeledger.session import cut_lineage

BITS, RADIUS, BLOCKS = 64, 3, 6
#: Fingerprints of a bucket compared in one tile, from each side.
TILE = 2048
#: Links that leave a task in one batch, about.
LINKS = 1 << 16

_SIGNS = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2.0 - 1.0)


def fingerprints(texts: list[str]) -> np.ndarray:
    """The 64-bit fingerprint of each text; one without words has 0."""
    codes, rows, words = word_codes(pa.array(texts, pa.large_string()))
    out = np.zeros(len(texts), np.uint64)
    if not len(codes):
        return out
    term, count = np.unique(rows * len(words) + codes, return_counts=True)
    row, code = np.divmod(term, len(words))
    weight = (1 + np.log(count))[:, None]
    hashes = word_hashes(words)
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    for byte in range(8):
        signs = _SIGNS[((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)[code]]
        votes = np.add.reduceat(signs * weight, begins, axis=0) > 0
        out[row[begins]] |= (votes << np.arange(8)).sum(axis=1).astype(np.uint64) << np.uint64(8 * byte)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def _hex(values: np.ndarray) -> list[str]:
    return [f"{int(v):016x}" for v in values]


_PAIRED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _paired(doc_ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    edited = []
    for text, other in zip(texts, following, strict=True):
        k = len(text) // 2
        edited.append(text[:len(text) - k] + other[:k])
    changed = fingerprints(edited)
    digest = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
    return [pa.array(doc_ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digest, pa.string()), pa.array(_hex(own), pa.string()), pa.array(_hex(changed), pa.string()),
            pa.array(likeness(own, changed)), pa.array(likeness(own, after))]


def fingerprint_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprints of ``documents(doc_id, text)``, of edited texts, and their likeness to the next document.

    Documents follow each other by ``doc_id`` (missing ones first, equal ones by text hash); the last is followed by
    the first, a lone document by itself. The edited text has its last ``n // 2`` code points replaced by the first
    as many of the next one. Null texts are empty. Texts are sorted by range once; only the first and last
    document of each partition go through a join. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; an empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = [*_PAIRED, "part", "kind", "text"]

    def ends(doc_id, text: str, part: int, kind: str) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in types), pa.array([part], pa.int64()), pa.array([kind]), pa.array([text], pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in slices(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            prints = fingerprints(texts)
            if last is None:
                yield ends(ids[0], texts[0], part, "head")
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], np.concatenate([[last[2]], prints])
            last = (ids[-1], texts[-1], prints[-1])
            if len(ids) > 1:
                columns = _paired(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
        if last is not None:
            yield ends(last[0], last[1], part, "tail")

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            yield pa.RecordBatch.from_arrays(_paired(batch.column("doc_id").to_pylist(), texts, following, fingerprints(texts), fingerprints(following)), _PAIRED)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    stored = cut_lineage(ordered.mapInArrow(run, f"{schema}, part long, kind string, text string"), "simhash")
    parts = [r["part"] for r in stored.filter("kind = 'head'").select("part").orderBy("part").collect()]  # as many as partitions
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, next_part long")
    heads = stored.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = stored.filter("kind = 'tail'").select("doc_id", "text", "part").join(after, "part").join(heads, "next_part")
    return stored.filter("kind is null").select(*_PAIRED).unionByName(tails.select("doc_id", "text", "following").mapInArrow(join_ends, schema))


def _tables(radius: int, blocks: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """The chosen blocks of each table, and the first bit of each block (and the end)."""
    return list(combinations(range(blocks), blocks - radius)), [BITS * i // blocks for i in range(blocks + 1)]


def _distinct(prints: DataFrame) -> DataFrame:
    return cut_lineage(prints.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("n")), "simhash_distinct")


def _links(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``(fp, near_fp, distance, n, near_n)`` of the links between ``distinct(fp, n)``, each once."""
    tables, bounds = _tables(radius, blocks)
    first_of = np.array([next((t for t, c in enumerate(tables) if all(m >> b & 1 for b in c)), -1) for m in range(1 << blocks)])
    masks = [sum(1 << i for i in range(bounds[b], bounds[b + 1])) for b in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    block_masks = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            keys = np.stack([table.column(c).to_numpy() for c in ("t", "key", "i", "j")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            done = int(cut[-1]) + 1 if len(cut) else 0
            held = table.slice(done)
            if done:
                yield from linked(table.slice(0, done), keys[:, :done])
        if held is not None and held.num_rows:
            yield from linked(held, np.stack([held.column(c).to_numpy() for c in ("t", "key", "i", "j")]))

    def linked(table: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, n, tile = table.column("fp").to_numpy().view(np.uint64), table.column("n").to_numpy(), table.column("b").to_numpy()
        group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        end = np.searchsorted(group, group, side="right")
        some, size, at, d = [], 0, np.arange(len(fp)), 1

        def batch() -> pa.RecordBatch:
            x, y = np.concatenate(some, axis=1)
            bits = np.bitwise_count(fp[x] ^ fp[y]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (fp[x].view(np.int64), fp[y].view(np.int64), bits, n[x], n[y])], ["fp", "near_fp", "distance", "n", "near_n"])

        while True:
            at = at[at + d < end[at]]
            if not len(at):
                break
            x, y = at, at + d
            pair = x[((tile[x] != tile[y]) | (keys[2][x] == keys[3][x])) & (np.bitwise_count(fp[x] ^ fp[y]) <= radius)]
            if len(pair):
                differ = fp[pair] ^ fp[pair + d]
                equal = ((differ[:, None] & block_masks) == 0) @ (1 << np.arange(blocks))
                pair = pair[first_of[equal] == keys[0][pair]]
                some.append(np.stack([pair, pair + d]))
                size += len(pair)
                if size >= LINKS:
                    yield batch()
                    some, size = [], 0
            d += 1
        if size:
            yield batch()

    keyed = distinct.select("fp", "n", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(sum(masks[b] for b in c)))) for c in tables))).alias("t", "key"))
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1")
    # Spark takes the exploded rows for as small as the stored table, which at a million fingerprints is below the broadcast limit
    members = keyed.join(full.hint("merge"), ["t", "key"]).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    members = members.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = members.select("t", "key", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "fp", "n")
    sorted_ = tiled.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return sorted_.mapInArrow(run, "fp long, near_fp long, distance int, n long, near_n long")


def links_within(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(fp, near_fp, distance)``: every two different fingerprints of ``prints(fp long)`` within ``radius`` bits, once, the smaller first.

    Rows with equal fingerprints are one class and make no link; who is in a class is told by the rows of ``prints``.
    Members of a bucket are compared inside the task that holds them, in tiles of at most ``TILE`` from each side; a
    link is given by the first table in which it meets. Null fingerprints are ignored; an empty table gives no rows.
    """
    return _links(_distinct(prints), radius, blocks).select("fp", "near_fp", "distance")


def count_within(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(fp, n_equal, n_near)`` for each distinct ``fp`` of ``prints(fp long)``: how many other rows hold it, and how
    many other rows lie within ``radius`` bits, those included.

    The second is the sum over the links, combined before the shuffle. Null fingerprints are ignored; an empty
    table gives no rows.
    """
    distinct = _distinct(prints)
    ends = F.explode(F.array(F.struct("fp", F.col("near_n").alias("near")), F.struct(F.col("near_fp").alias("fp"), F.col("n").alias("near"))))
    found = _links(distinct, radius, blocks).select(ends.alias("e")).groupBy(F.col("e.fp").alias("fp")).agg(F.sum("e.near").alias("near"))
    return distinct.join(found, "fp", "left").select("fp", (F.col("n") - 1).alias("n_equal"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"))


def near_documents(prints: DataFrame, links: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, near_id, distance)``, both ways: the documents of ``prints(doc_id, fp)`` whose different fingerprints
    ``links`` connects. Those with the same fingerprint are found by it."""
    both = links.unionByName(links.select(F.col("near_fp").alias("fp"), F.col("fp").alias("near_fp"), "distance"))
    near = prints.select(F.col("fp").alias("near_fp"), F.col(id_col).alias("near_id"))
    return prints.select("fp", id_col).join(both, "fp").join(near, "near_fp").select(id_col, "near_id", "distance")
