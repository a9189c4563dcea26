"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, and their components.

Candidates come from multi-match prefixes. All shingles are put in one global order, those seen often last. If two
sets reach the threshold, the first ``m`` shingles they share lie in the first ``n - ceil(t n) + m`` shingles of
each, for every ``m`` up to ``ceil(t n)``. Each document chooses its own ``m`` by the estimated cost of its lists:
a longer prefix, from which correspondingly more shared shingles are asked for before a pair is verified. A pair
needs as many as the smaller ``m`` of the two, and as many as the sizes and the rests behind the prefixes demand.
Every pair is verified on the whole sets.

Groups of copies never become pairs. Equal sets form one class. In a list of documents that share a shingle,
each is first verified against one centre only, as many pairs as entries. What these links leave in different
components is compared whole: lists with many such pairs inside tasks, in tiles from which only links leave, the
others as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices, spare_names, texts_of
from tapeledger.llm.components import connected_components
from tapeledger.llm.words import shingles
from tapeledger.session import cut_lineage, drop_stored

SIZE, PERCENT = 5, 80
#: Bits of the sketch of frequent shingles, and of the filter of documents to verify: fixed sizes, 4 and 8 MB.
SKETCH_BITS, FILTER_BITS = 22, 26
#: Shingles a task counts at a time when it looks for repeated ones.
COUNTED = 2 << 20
#: Largest number of shared shingles asked for, and the cost of verifying a pair in list entries.
MOST_MATCHES, VERIFY_COST = 16, 50

#: A list with more pairs between components is compared in tiles, of at most so many documents from each side.
HEAVY, TILE, BLOCK_TURNS = 10_000, 512, 2

_PROFILE = "doc_id long, n long, digest binary, token long, times long"


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _profiles(documents: DataFrame, size: int) -> DataFrame:
    """A row per document with the size and digest of its set, and rows of shingles repeated within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        total = 0

        def repeated() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(list(held.values())), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            token, times = token[times > 1], times[times > 1]
            null = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([null, null, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(times.astype(np.int64))], names)

        names = ["doc_id", "n", "digest", "token", "times"]
        for batch in slices(batches, "text"):
            row, value = shingles(texts_of(batch, "text"), size)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = [value[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            null = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(digests, pa.binary()), null, null], names)
            for d, s in zip(digests, sets, strict=True):
                if d not in held:
                    held[d] = s
                    total += len(s)
            if total > COUNTED:
                yield repeated()
                held, total = {}, 0
        yield repeated()

    return documents.select("doc_id", "text").mapInArrow(run, _PROFILE)


def _levels(profiles: DataFrame) -> np.ndarray:
    """Per bucket of shingles the logarithm of how often they were seen; of a fixed size, whatever the corpus."""
    bucket = F.shiftrightunsigned(F.col("token"), 64 - SKETCH_BITS)
    seen = profiles.filter("token is not null").groupBy(bucket.alias("bucket")).agg(F.sum("times").alias("times")).filter("times >= 4").toArrow()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    levels[seen.column("bucket").to_numpy()] = np.log2(seen.column("times").to_numpy().astype(float)).astype(np.uint8)
    return levels


def choose_prefix(level: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """``(length, matches)`` of the cheapest prefix of a set whose ordered shingles have these levels.

    The cost of asking for ``m`` matches is the entries of the lists that are read plus the verifications, of which
    there are at most the foreign entries divided by ``m``.
    """
    n = len(level)
    need = int(_least_shared(np.int64(n), percent))
    most = min(MOST_MATCHES, need)
    foreign = np.cumsum(np.exp2(level[:n - need + most].astype(float)) - 1)
    m = np.arange(1, most + 1)
    length = n - need + m
    cost = length + foreign[length - 1] * (1 + VERIFY_COST / m)
    best = int(np.argmin(cost))
    return int(length[best]), int(m[best])


def _prefixes(documents: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """``(doc_id, matches, n, tokens)``: the prefix of every non-empty set and the size of the set."""
    known = documents.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, value = shingles(texts_of(batch, "text"), size)
            level = known.value[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((value, level, row))
            row, value, level = row[order], value[order], level[order]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            docs, matches, tokens, size_ = [], [], [], []
            for i in np.flatnonzero(np.diff(ends)):
                length, m = choose_prefix(level[ends[i]:ends[i + 1]], percent)
                docs.append(i)
                matches.append(m)
                size_.append(int(ends[i + 1] - ends[i]))
                tokens.append(value[ends[i]:ends[i] + length].view(np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(matches, pa.int32()), pa.array(size_, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), flat)], ["doc_id", "matches", "n", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, matches int, n long, tokens array<long>")


def _position(column: str | Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS)


def _filter_words(wanted: DataFrame, column: str) -> DataFrame:
    """``(word, bits)``: a bit for the hash of every value, at most ``2 ** (FILTER_BITS - 6)`` rows whatever their number."""
    at = wanted.select(_position(column).alias("position"))
    return at.groupBy(F.shiftright("position", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(position & 63 as int))")).alias("bits"))


def _filter(spark: SparkSession, wanted: DataFrame, column: str) -> Broadcast:
    """A bit for the hash of every value: of a fixed size, so it only lets more pass as the values grow in number."""
    words = _filter_words(wanted, column).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bits)


def _passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 6] >> (at & 63)) & 1).astype(bool)


def _sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n, tokens)`` of the wanted documents, read again from their whole texts.

    A filter of fixed size keeps most other texts from being hashed; the join makes the choice exact.
    """
    known = _filter(documents.sparkSession, wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = batch.column("position").to_numpy()
            some = np.flatnonzero(_passes(known.value, at))
            if not len(some):
                continue
            batch = batch.take(pa.array(some))
            row, value = shingles(texts_of(batch, "text"), size)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sets, pa.binary())], ["doc_id", "n", "tokens"])

    kept = documents.select("doc_id", "text", _position("doc_id").alias("position")).mapInArrow(run, "doc_id long, n long, tokens binary")
    return cut_lineage(kept.join(wanted, "doc_id", "left_semi").distinct(), "ngram_sets")


def _entries_of(prefixes: DataFrame, known: Broadcast) -> DataFrame:
    """``(token, doc_id)`` of the prefixes for the tokens that pass the filter; the other ones never leave their task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _passes(known.value, batch.column("at").flatten().to_numpy(zero_copy_only=False))
            docs = np.repeat(batch.column("doc_id").to_numpy(), pc.list_value_length(batch.column("tokens")).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("tokens").flatten().filter(pa.array(keep)), pa.array(docs[keep])], ["token", "doc_id"])

    at = F.transform("tokens", lambda t: F.shiftrightunsigned(F.xxhash64(t), 64 - FILTER_BITS))
    return prefixes.select("doc_id", "tokens", at.alias("at")).mapInArrow(run, "token long, doc_id long")


def _possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, n)``, ``n`` shared prefix shingles, that can reach the threshold.

    The sizes must be near enough, and what the prefixes share plus what may follow the prefix that ends first must
    reach the overlap that the threshold asks for. At least the smaller number of matches is asked for in any case.
    """
    columns = ["m", "low", "high", "beyond"]
    for side in ("a", "b"):
        pairs = pairs.join(sizes.toDF(side, *(f"{c}_{side}" for c in columns)), side)
    return pairs.filter(f"""n >= least(m_a, m_b) and 100 * least(high_a, high_b) >= {percent} * greatest(low_a, low_b)
        and {100 + percent} * (n + greatest(beyond_a, beyond_b)) >= {percent} * (low_a + low_b)""").select("a", "b")


def _verified(documents: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the threshold on their whole sets."""
    pairs = cut_lineage(pairs, "ngram_pairs")
    sets = _sets(documents, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), size)
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    links = cut_lineage(pairs.join(left, "a").join(right, "b").filter(near).mapInArrow(run, "a long, b long"), "ngram_links")
    drop_stored(pairs, sets)
    return links


def _tile_links(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the documents of two sides, as many as join their components and no more."""
    left, right = ([np.frombuffer(t, np.uint64) for t in side["tokens"]] for side in (a, b))
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, token = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.searchsorted(both, token)
        at[at == len(both)] = 0
        held = both[at] == token
        return row[held], at[held]

    shared = np.zeros((len(left), len(right)), np.float32)
    if len(both):
        (row_a, at_a), (row_b, at_b) = incidence(left), incidence(right)
        for start in range(0, len(both), 4096):
            width = min(4096, len(both) - start)
            one, two = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            for matrix, row, at in ((one, row_a, at_a), (two, row_b, at_b)):
                some = (at >= start) & (at < start + width)
                matrix[row[some], at[some] - start] = 1
            shared += one @ two.T
    shared = shared.astype(np.int64)
    n_a, n_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    part_a, part_b = a["component"].to_numpy(), b["component"].to_numpy()
    near = (100 * shared >= percent * (n_a[:, None] + n_b - shared)) & (part_a[:, None] != part_b)
    x, y = np.nonzero(near)
    parent: dict[int, int] = {}

    def root(p: int) -> int:
        while parent.get(p, p) != p:
            p = parent[p]
        return p

    links = []
    _, first = np.unique(np.stack([part_a[x], part_b[y]]), axis=1, return_index=True)
    for i in first:
        p, q = root(part_a[x[i]]), root(part_b[y[i]])
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((int(a["doc_id"].iloc[x[i]]), int(b["doc_id"].iloc[y[i]])))
    return links


def _block_links(documents: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within the blocks of ``blocks(block, doc_id, component)`` between documents of different components.

    Everything outside a block's largest component is compared with the whole block; the largest is not compared
    with itself. Tiles hold at most ``TILE`` documents of each side, about.
    """
    main = blocks.groupBy("block", "component").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main")).filter("n > n_main")
    sets = _sets(documents, blocks.join(main, "block", "left_semi").select("doc_id").distinct(), size)
    rows = blocks.join(main.select("block", "main", F.ceil((F.col("n") - F.col("n_main")) / TILE).cast("int").alias("outs"), F.ceil(F.col("n") / TILE).cast("int").alias("alls")), "block")
    own = lambda parts: F.pmod(F.xxhash64("doc_id"), F.col(parts)).cast("int")
    every = rows.withColumns({"out": F.lit(False), "j": own("alls"), "i": F.explode(F.sequence(F.lit(0), F.col("outs") - 1))})
    outer = rows.filter("component <> main").withColumns({"out": F.lit(True), "i": own("outs")}).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("alls") - 1)))
    columns = ["block", "i", "j", "out", "doc_id", "component"]
    tiles = every.select(columns).unionByName(outer.select(columns)).join(sets.select("doc_id", "tokens"), "doc_id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["out"]], pdf[~pdf["out"]]
        return pd.DataFrame(_tile_links(a, b, percent) if len(a) and len(b) else [], columns=["a", "b"]).astype("int64")

    links = cut_lineage(tiles.groupBy("block", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "ngram_block_links")
    drop_stored(sets)
    return links


def _mixed_lists(lists: DataFrame, links: DataFrame, blocks: DataFrame | None) -> tuple[DataFrame, float]:
    """The lists whose documents are not all of one component, or of one block already compared.

    ``(token, doc_id, component, blocks, pairs)``, ``pairs`` those left to compare in the list (of blocks the last one
    counts), and the sum of these over all lists. ``blocks(doc_id, blocks)`` has at most ``BLOCK_TURNS`` a document.
    ``lists`` is deleted from the shared folder: what is returned takes its place.
    """
    known, nothing = connected_components(links.toDF("u", "v"), "ngram_components").withColumnRenamed("node", "doc_id"), F.array().cast("array<long>")
    known = known.join(blocks, "doc_id", "full_outer") if blocks is not None else known.withColumn("blocks", nothing)
    parts = lists.select("token", "doc_id").join(known, "doc_id", "left").withColumns({"component": F.coalesce("component", "doc_id"), "blocks": F.coalesce("blocks", nothing)})
    parts = cut_lineage(parts, "ngram_parts")
    groups = parts.groupBy("token", "component").agg(F.count("*").alias("n"))
    mixed = groups.groupBy("token").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own")).filter("k > 1")
    square = F.sum(F.col("n") * F.col("n"))
    inside = parts.filter(F.size("blocks") > 0).groupBy("token", F.element_at("blocks", -1).alias("block"), "component").agg(F.count("*").alias("n"))
    inside = inside.groupBy("token", "block").agg(F.sum("n").alias("n"), square.alias("both")).groupBy("token").agg((square - F.sum("both")).alias("done"))
    mixed = mixed.join(inside, "token", "left").withColumn("pairs", (F.col("all") * F.col("all") - F.col("own") - F.coalesce("done", F.lit(0))) / 2).filter("pairs > 0")
    mixed = cut_lineage(mixed.select("token", "pairs"), "ngram_mixed")
    rest = cut_lineage(parts.join(mixed, "token"), "ngram_rest")
    pairs = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
    drop_stored(lists, parts, mixed)
    return rest, pairs


def ngram_links(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)`` of ``documents(doc_id, text)``.

    ``classes(doc_id, n_shingles, class_id)`` has a row per document; equal sets have one class, named after its
    smallest ``doc_id`` (null where the set is empty or the document has no ``doc_id``). ``links(a, b)`` connects the
    classes: two classes are connected by links exactly if a chain of pairs at the threshold connects them.
    """
    spark: SparkSession = documents.sparkSession
    bound_batches(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = cut_lineage(_profiles(documents, size), "ngram_profiles")
    rows = profiles.filter("n is not null").select("doc_id", "n", "digest")
    first = rows.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("class_id"))
    classes = cut_lineage(rows.join(first, ["digest", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "ngram_classes")

    heads = classes.filter("doc_id = class_id").select("doc_id").distinct()
    prefixes = cut_lineage(_prefixes(documents, _levels(profiles), size, percent).join(heads, "doc_id", "left_semi"), "ngram_prefixes")
    entries = prefixes.select(F.explode("tokens").alias("token"), "doc_id")
    shared = entries.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).filter("n > 1")
    shared = cut_lineage(shared, "ngram_shared")
    lists = cut_lineage(_entries_of(prefixes, _filter(spark, shared, "token")).join(shared.select("token", "centre"), "token"), "ngram_lists")
    sizes = cut_lineage(prefixes.groupBy("doc_id").agg(F.min("matches").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.size("tokens")).alias("beyond")), "ngram_sizes")
    drop_stored(profiles, prefixes, shared)

    same = classes.filter("class_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a <> b")
    links = classes.join(same.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b")).filter("a <> b").distinct()
    if lists.isEmpty():
        return classes, cut_lineage(links, "ngram_all_links")
    stars = lists.filter("doc_id <> centre").groupBy("doc_id", "centre").agg(F.count("*").alias("n"))
    best = stars.groupBy("doc_id").agg(F.max(F.struct("n", "centre")).alias("best"))
    hoped = best.select(F.least("doc_id", "best.centre").alias("a"), F.greatest("doc_id", "best.centre").alias("b"), "best.n")
    links = links.unionByName(_verified(documents, _possible(hoped, sizes, percent), size, percent))
    rest, _ = _mixed_lists(lists, links, None)
    blocks = None
    for _ in range(BLOCK_TURNS):
        heavy = rest.filter(F.col("pairs") > HEAVY)
        if heavy.isEmpty():
            break
        first = heavy.groupBy("doc_id").agg(F.max(F.struct("pairs", "token")).alias("best"), F.first("component").alias("component")).select("doc_id", F.col("best.token").alias("token"), "component")
        first = cut_lineage(first, "ngram_first_blocks")
        # the lists of one group of copies differ by a few documents: each list goes to where most of its documents go
        usual = heavy.select("token", "doc_id").join(first.select("doc_id", F.col("token").alias("block")), "doc_id").groupBy("token", "block").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "block")).alias("most"))
        chosen = cut_lineage(first.join(usual, "token").select("doc_id", F.col("most.block").alias("block"), "component"), "ngram_blocks")
        links = links.unionByName(_block_links(documents, chosen, size, percent))
        added = chosen.select("doc_id", F.array("block").alias("blocks"))
        blocks = added if blocks is None else cut_lineage(blocks.unionByName(added).groupBy("doc_id").agg(F.flatten(F.collect_list("blocks")).alias("blocks")), "ngram_all_blocks")
        rest, pairs = _mixed_lists(rest, links, blocks)
        if pairs <= 4 * rest.count():
            break
    if not rest.isEmpty():
        left, right = (rest.select("token", F.col("doc_id").alias(x), F.col("component").alias(f"part_{x}"), F.col("blocks").alias(f"blocks_{x}")) for x in ("a", "b"))
        counted = left.join(right, "token").filter("a < b and part_a <> part_b and not arrays_overlap(blocks_a, blocks_b)").groupBy("a", "b").agg(F.count("*").alias("n"))
        links = links.unionByName(_verified(documents, _possible(counted, sizes, percent), size, percent))
    links = cut_lineage(links.distinct(), "ngram_all_links")
    drop_stored(rest, sizes)
    return classes, links


def near_duplicates(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``documents(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable over links. Words are lower-cased (A-Z) runs of anything but
    white space; a set holds the distinct ``size``-word shingles of the whole text, or the whole sequence if it is
    shorter. Null, empty and wordless texts have an empty set and link to nothing. Rows with one ``doc_id`` are one
    node; a row without ``doc_id`` takes no part and has a null component. Empty tables give no rows.
    """
    classes, links = ngram_links(documents, size, percent)
    named = connected_components(links.toDF("u", "v"), "ngram_components").toDF("class_id", "component")
    joined = classes.join(named, "class_id", "left").withColumn("c", F.coalesce("component", "class_id", "doc_id"))
    repeated = classes.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1 and doc_id is not null").select("doc_id")
    ids = joined.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("c").alias("c_id"))
    return joined.join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.least(F.coalesce("c_id", "c"), F.coalesce("c", "c_id")).alias("component_id"))


def _without(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """``documents`` less the rows whose ``doc_id`` is in ``dropped(doc_id)``.

    Rows that miss a bit filter of the dropped ids, at most ``2 ** FILTER_BITS`` bits in words of 64, stay where they
    are; only the others are shuffled with their texts for the exact anti join.
    """
    word, bits, position = spare_names(documents, "word", "bits", "position")
    words = _filter_words(dropped, "doc_id").toDF(word, bits)
    at = documents.withColumn(position, _position(F.col("doc_id").cast("long"))).withColumn(word, F.shiftright(position, 6))
    marked = at.join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{position}` & 63 as int)) & 1"), F.lit(0)) == 1
    missed = marked.filter(~hit | F.col("doc_id").isNull()).select(*documents.columns)
    return missed.unionByName(marked.filter(hit & F.col("doc_id").isNotNull()).join(dropped, "doc_id", "left_anti").select(*documents.columns))


def keep_first(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``documents`` with one document of each component: the one with the smallest ``doc_id``.

    Rows without ``doc_id`` stay. Rows that share the kept ``doc_id`` are of one node and leave one row, the one with
    the smallest text hash.
    """
    groups = near_duplicates(documents, size, percent).filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    kept = _without(documents, cut_lineage(groups, "ngram_dropped"))
    k, h, own = spare_names(documents, "k", "h", "own")
    twice = documents.filter("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(k), F.min(F.xxhash64("text")).alias(h)).filter(F.col(k) > 1)
    if twice.isEmpty():
        return kept
    marked = kept.join(twice, F.col("doc_id") == F.col(own), "left")
    plain = marked.filter(F.col(own).isNull()).select(*documents.columns)
    return plain.unionByName(marked.filter(F.xxhash64("text") == F.col(h)).dropDuplicates(["doc_id"]).select(*documents.columns))
