"""Source divergence audit: how the word use of every source differs from that of the other sources of its language.

Pairs are compared by a partition of the cube (source, source, term). Sources and terms of a language are cut into
blocks; a cell (block of sources, block of sources, block of terms) is one task group, which gets the two slices of
the count table that it needs and gives the partial divergences of its pairs; these are summed along the term axis.
A slice is copied once per block of sources. Neither the vocabulary nor the sources of a language meet in one task.

All figures are whole numbers: a smoothed share ``p = 1 + floor(10^9 (count + 1) / (total + terms))``, and the part
``floor((p - q)^2 / q)`` that a term adds to the divergence of one source from another (``q``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices, texts_of
from tapeledger.session import cut_lineage

#: Sources of a block and terms of a block, about: a cell holds two matrices of this size.
GROUP_BLOCK, TERM_BLOCK = 32, 8192
LEAST_DOCS, MOST_TERMS, UNIT = 3, 200, 1_000_000_000


def term_lists(texts: pa.Array) -> pa.Array:
    """The terms of each text: runs of letters A-Z, lower-cased, and of characters beyond ASCII."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if n and texts.buffers()[2] else np.zeros(0, np.uint8)
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    small = np.arange(ord("a"), ord("z") + 1)
    table[small] = table[small - 32] = small
    plain = pa.LargeStringArray.from_buffers(n, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(table[data].tobytes()))
    return pc.ascii_split_whitespace(plain)


def _pair_codes(one: np.ndarray, two: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each is there."""
    key, times = np.unique(one * width + two, return_counts=True)
    return key // width, key % width, times


def count_terms(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each group; a row with null ``term``
    for every group. Null text, language and source are empty ones."""
    bound_batches(documents.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = term_lists(texts_of(batch, "text"))
            words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
            full = pc.not_equal(words, "")
            coded = pc.filter(words, full).dictionary_encode()
            code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.filter(rows, full).to_numpy(zero_copy_only=False).astype(np.int64)
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * (len(source.dictionary) + 1) + source.indices.to_numpy()
            groups, place = np.unique(group, return_inverse=True)
            width = len(coded.dictionary) + 1
            g, c, n = _pair_codes(place[row], code, width)
            r, c2, _ = _pair_codes(row, code, width)
            _, _, docs = _pair_codes(place[r], c2, width)
            of_group = np.concatenate([g, np.arange(len(groups))])
            none = np.zeros(len(groups), np.int64)
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(groups[of_group] // (len(source.dictionary) + 1))), source.dictionary.take(pa.array(groups[of_group] % (len(source.dictionary) + 1))),
                pa.concat_arrays([coded.dictionary.take(pa.array(c)).cast(pa.string()), pa.nulls(len(groups), pa.string())]),
                pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))], names)

    kept = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = kept.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """The smoothed share in parts of ``UNIT``; the product is a decimal, so no count is too large."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} as decimal(20,0))")


def _cell(rows: pa.Table) -> pa.Table:
    """The partial divergences of one cell, in both directions, of every pair of a source of its first block and one of its second.

    A source has a row with ``at`` -1, its share of an absent term and the number of terms of the block, and a row for each
    term that it holds. Terms that no source of the cell holds add the same each. A cell whose second block has no
    sources has no pairs.
    """
    side, g, at, p, width = (rows.column(c).to_numpy() for c in ("side", "g", "at", "p", "width"))
    same, name = rows.column("same")[0].as_py(), rows.column("source").to_numpy()
    terms = np.unique(at[at >= 0])

    def matrix(which: int) -> tuple[np.ndarray, np.ndarray]:
        head, own = np.flatnonzero((at < 0) & (side == which)), np.flatnonzero((at >= 0) & (side == which))
        head = head[np.argsort(g[head])]
        full = np.repeat(p[head][:, None], len(terms) + 1, axis=1)  # the last column is an absent term
        full[np.searchsorted(g[head], g[own]), np.searchsorted(terms, at[own])] = p[own]
        return name[head], full

    names_a, a = matrix(0)
    names_b, b = (names_a, a) if same else matrix(1)
    source, item, value = [], [], []
    if len(a) and len(b):
        times = np.ones(len(terms) + 1, np.int64)
        times[-1] = width.max() - len(terms)
        for own_name, own in zip(names_a, a, strict=True):
            square, one = (own - b) ** 2, np.full(len(b), own_name, object)
            source, item, value = source + [one], item + [names_b], value + [(square // b) @ times]
            if not same:
                source, item, value = source + [names_b], item + [one], value + [(square // own) @ times]
    flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
    out = pa.table({"source": flat(source, pa.string()), "item": flat(item, pa.string()), "value": flat(value, pa.int64())})
    out = out.add_column(0, "lang", pa.repeat(pa.scalar(rows.column("lang")[0].as_py(), pa.string()), len(out)))
    return out.filter(pc.not_equal(out.column("source"), out.column("item")))


def divergences(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS,
                group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every ``(lang, source)`` group.

    A language keeps the terms in at least ``least_docs`` of its documents (rows). Part ``pair``: for every other source of the
    language the divergence from it, all ranks; 0 where the language keeps no term. Part ``term``: the terms that the
    group uses more than the language does, by what they add to its divergence from the language, up to rank ``most_terms``.
    Values fall; of equal ones the item that comes first by its UTF-8 bytes. Null text, language and source are empty ones;
    repeated rows count as documents of their own; groups without terms have their pairs; a lone source has none; an
    empty table gives no rows. A sum fits a long as long as a language keeps fewer than 10^9 terms.
    """
    counts = cut_lineage(count_terms(documents, lang_col, source_col, text_col), "divergence_counts")
    groups = counts.filter("term is null").select("lang", "source")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "n")
    terms = cut_lineage(terms, "divergence_terms")
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(vocabulary, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("lang_n"), F.ceil(F.col("sources") / group_block).alias("group_blocks"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / term_block)).alias("term_blocks"))
    langs = cut_lineage(langs, "divergence_langs")
    placed = terms.join(langs.select("lang", "v", "lang_n", "term_blocks"), "lang").withColumn("t", F.pmod(F.xxhash64("term"), "term_blocks"))
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "t").orderBy("term")) - 1)
    placed = cut_lineage(placed.select("lang", "term", "t", "at", share("n", "lang_n + v").alias("q")), "divergence_placed")
    held = cut_lineage(counts.filter("term is not null").select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "divergence_held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").withColumns({"total": F.coalesce("n", F.lit(0)) + F.col("v"), "block": F.pmod(F.xxhash64("source"), "group_blocks")})
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1)
    groups = cut_lineage(groups.select("lang", "source", "total", "block", "g", "group_blocks", "term_blocks", F.when(F.col("total") > 0, share("0", "total")).otherwise(1).alias("p")), "divergence_groups")
    held = cut_lineage(held.join(groups.drop("p", "term_blocks"), ["lang", "source"]).withColumn("p", share("n", "total")), "divergence_shares")

    widths = placed.groupBy("lang", "t").agg(F.count("*").alias("width"))
    heads = groups.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))).join(widths, ["lang", "t"], "left")
    columns = ["lang", "t", "block", "group_blocks", "g", "at", "p", "width", "source"]
    rows = heads.withColumns({"at": F.lit(-1), "width": F.coalesce("width", F.lit(0))}).select(columns).unionByName(held.withColumns({"width": F.lit(0).cast("long"), "source": F.lit(None).cast("string")}).select(columns))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1))).select(
        "lang", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"), "g", "at", "p", "width", "source")
    parts = cells.groupBy("lang", "i", "j", "t").applyInArrow(_cell, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    used = held.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    return pairs.unionByName(used.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= most_terms))
