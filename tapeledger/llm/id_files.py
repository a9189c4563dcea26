"""Token-id files: ids ranked by how frequent they are, in byte-aligned codes with separate control bytes.

A file holds a run of documents in ascending order. Its head gives the counts; then come the identifiers, a byte that
tells which are missing, the lengths, the control bytes and the data bytes. The rank of an id is written in as many
bytes as it needs: one or two if the vocabulary allows (one control bit an id), else one to four (two bits). Readers
look the lengths of a control byte up in a table and gather all ranks at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices, texts_of
from tapeledger.llm.tokens import piece_tokenizer, with_end
from tapeledger.session import cut_lineage, scratch_path

MAGIC = b"TLIDS1\0\0"
#: magic, ids of all documents before the file, documents, ids, control bits an id, data bytes, crc32 of what follows
HEAD = struct.Struct("<8sqqqqqq")
#: Ids in a file, about: a file ends with the document that passes it.
FILE_IDS = 4 << 20

_LENGTHS = {bits: ((np.arange(256)[:, None] >> (bits * np.arange(8 // bits))) & ((1 << bits) - 1)).astype(np.uint8) + 1 for bits in (1, 2)}


def encode_ranks(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """``(control bytes, data bytes)`` of the ranks; ``bits`` is 1 for ranks below 65,536, else 2."""
    size = 1 + (ranks > 0xFF).astype(np.uint8)
    if bits == 2:
        size += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF).astype(np.uint8)
    per = 8 // bits
    codes = np.zeros(-(-len(ranks) // per) * per, np.uint8)
    codes[:len(ranks)] = size - 1
    control = (codes.reshape(-1, per) << (bits * np.arange(per, dtype=np.uint8))).sum(axis=1).astype(np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - size
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        data[begin[some] + k] = (ranks[some] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int, bits: int) -> np.ndarray:
    size = _LENGTHS[bits][control].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    begin = ends - size
    ranks = np.zeros(n, np.uint32)
    for k in range(int(size.max()) if n else 0):
        some = size > k
        ranks[some] |= data[begin[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def file_bytes(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ranks: np.ndarray, first: int, bits: int) -> bytes:
    control, data = encode_ranks(ranks, bits)
    body = doc_ids.astype("<i8").tobytes() + missing.astype(np.uint8).tobytes() + counts.astype("<i8").tobytes() + control + data
    return HEAD.pack(MAGIC, first, len(doc_ids), len(ranks), bits, len(data), zlib.crc32(body)) + body


@dataclass
class IdFile:
    """One file read back; documents without identifier have ``missing`` set."""

    doc_ids: np.ndarray
    missing: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    first: int


def read_file(raw: bytes) -> IdFile:
    """Decode a file; a damaged or foreign one raises."""
    magic, first, docs, n, bits, size, crc = HEAD.unpack_from(raw)
    if magic != MAGIC or zlib.crc32(memoryview(raw)[HEAD.size:]) != crc:
        raise ValueError("not a token-id file, or a damaged one")
    at = HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    missing = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
    counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    control = np.frombuffer(raw, np.uint8, -(-n * bits // 8), at)
    return IdFile(doc_ids, missing, counts, decode_ranks(control, np.frombuffer(raw, np.uint8, size, at + len(control)), n, bits), first)


def _write(folder: str, name: str, content: bytes) -> None:
    """Put a whole file in place at once: a task that is run again replaces it by the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, f"{path}/{name}")


def _pack_ids(ids: np.ndarray) -> bytes:
    """The low and the high bytes apart, compressed: what is stored until the ranks are known."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").reshape(n)


def _blocks(documents: DataFrame, definition, end_id: int, file_ids: int) -> DataFrame:
    """Documents in ascending order, encoded, in blocks of which each becomes a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = piece_tokenizer(definition.value), TaskContext.get().partitionId()
        names, block, before, held = ["part", "block", "before", "n_ids", "doc_ids", "counts", "ids"], 0, 0, []

        def one() -> pa.RecordBatch:
            nonlocal block, before, held
            docs, counts, ids = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = [pa.array([part]), pa.array([block]), pa.array([before]), pa.array([len(ids)]), pa.array([docs.to_pylist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([_pack_ids(ids)], pa.binary())]
            block, before, held = block + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays(row, names)

        for batch in slices(batches, "text"):
            offsets, ids = with_end(*tokenizer.encode(texts_of(batch, "text")), end_id)
            at, n = 0, batch.num_rows
            while at < n:
                there = sum(len(h[2]) for h in held)
                end = min(n, int(np.searchsorted(offsets[1:], offsets[at] + file_ids - there)) + 1)
                held.append((batch.column("doc_id").slice(at, end - at), np.diff(offsets[at:end + 1]), ids[offsets[at]:offsets[end]]))
                at = end
                if there + len(held[-1][2]) >= file_ids:
                    yield one()
        if held:
            yield one()

    ordered = documents.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "part long, block long, before long, n_ids long, doc_ids array<long>, counts array<long>, ids binary")


def _frequencies(blocks: DataFrame) -> DataFrame:
    """``(id, times)`` over all documents; summed within a task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column("ids"), batch.column("n_ids"), strict=True):
                seen = np.bincount(_unpack_ids(raw.as_py(), n.as_py()))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[:len(seen)] += seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "times"])

    return blocks.select("ids", "n_ids").mapInArrow(run, "id long, times long").groupBy("id").agg(F.sum("times").alias("times"))


def write_id_files(documents: DataFrame, tokenizer_file: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``documents(doc_id, text)``, each followed by ``end_id``, into files below ``folder``.

    Documents are in ascending ``doc_id`` (missing ones first, equal ones by their text's hash) over the files in the
    order of their names. A null or empty text is the end id alone. Returns one row per file: ``name, first_id,
    n_docs, n_ids, n_bytes``. The folder must be one that all executors reach; ``ranks.bin`` in it lists the ids by
    falling frequency. An empty table writes the (empty) rank list only.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    definition = spark.sparkContext.broadcast(Path(tokenizer_file).read_text())  # a file of fixed size
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = cut_lineage(_blocks(documents, definition, end_id, file_ids), "id_blocks")
    counts = _frequencies(blocks).orderBy(F.desc("times"), "id").toArrow()  # as many rows as the vocabulary has ids, at most
    by_rank = counts.column("id").to_numpy().astype("<u4")
    _write(folder, "ranks.bin", by_rank.tobytes())
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toArrow()  # a row for each partition
    first = dict(zip(parts.column("part").to_pylist(), (np.cumsum(parts.column("n").to_numpy()) - parts.column("n").to_numpy()).tolist(), strict=True))
    bits = 1 if len(by_rank) <= 1 << 16 else 2
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    known = spark.sparkContext.broadcast((rank_of, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, begins = known.value
        for batch in batches:
            for row in batch.to_pylist():
                at = begins[row["part"]] + row["before"]
                missing = np.array([d is None for d in row["doc_ids"]], bool)
                docs = np.array([d or 0 for d in row["doc_ids"]], np.int64)
                content = file_bytes(docs, missing, np.array(row["counts"], np.int64), ranks[_unpack_ids(row["ids"], row["n_ids"])], at, bits)
                name = f"ids-{row['part']:06d}-{row['block']:06d}.bin"
                _write(folder, name, content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (at, len(docs), row["n_ids"], len(content)))], ["name", "first_id", "n_docs", "n_ids", "n_bytes"])

    return cut_lineage(blocks.mapInArrow(run, "name string, first_id long, n_docs long, n_ids long, n_bytes long"), "id_files")


def read_id_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if ``with_ids``, ``ids``.

    ``start`` counts the ids of all documents before it; the end id belongs to its document.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/ranks.bin") as f:
        known = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))  # as long as the vocabulary, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                f = read_file(content.as_py())
                raw = known.value[f.ranks].astype("<u4").tobytes()
                ends = np.cumsum(f.counts)
                cuts = [raw[4 * a:4 * b] for a, b in zip(ends - f.counts, ends, strict=True)]
                columns = [pa.array(f.doc_ids, mask=f.missing), pa.array(f.first + ends - f.counts), pa.array(f.counts.astype(np.int64)), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(cuts, pa.binary())] if with_ids else []), names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return files.select("content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def encode_corpus(documents: DataFrame, tokenizer_file: str, end_id: int = 0, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write the files (below the shared folder if none is given) and read them back."""
    folder = folder or scratch_path(documents.sparkSession, "token_ids")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1)
    write_id_files(documents, tokenizer_file, folder, end_id)
    return read_id_files(documents.sparkSession, folder, with_ids)
