"""Quality rules by line labels: a linear-chain conditional random field marks lines as content or boilerplate.

Every line with a word is described by a few figures (symbols, capitals, repeats, length ...). The field scores the
figures of each line and each pair of neighbouring labels; the Viterbi path is the best sequence for the whole text.
A document stays if enough of its words lie in content lines and no base rule fails.

The field is fitted by its gradient (forward-backward) on a bounded sample of labelled documents. Lines have no labels
of their own: those of a good document count as content, repeated ones excepted, those of a bad one as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices, texts_of
from tapeledger.llm.words import mix

BOILERPLATE, CONTENT = 0, 1
#: Labelled rows used for fitting, at most (taken by the hash of the identifier); lines of one training sequence, at most.
MAX_LABELLED, TRAINED_LINES = 4000, 32
#: Share of a text's words that must lie in content lines.
LEAST_CONTENT = 0.5

# The base rules.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
SYMBOLS = b"#*$%&|<>"

#: Byte classes whose share of a line's bytes is a figure.
CLASSES = [SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b".,;:?'\"()-", b"{}[]=\\/_~^`@+"]
#: Words of menus, notices and links, compared in lower case without the punctuation around them.
FURNITURE = frozenset("""cookie cookies copyright reserved privacy terms login logout signup register subscribe newsletter share tweet
    facebook twitter instagram menu navigation sitemap contact click comments reply previous next javascript advertisement sponsored""".split())
N_FIGURES = len(CLASSES) + 11

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Lines:
    """The lines with a word of some texts: the row of each, its number of words and its figures; base counts per row."""

    row: np.ndarray
    words: np.ndarray
    figures: np.ndarray
    repeated: np.ndarray
    stats: dict[str, np.ndarray]


def _class_counts(words: pa.Array) -> np.ndarray:
    """``(classes, words)``: how many bytes of each class every word has."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    out = np.zeros((len(CLASSES), len(words)), np.int64)
    if len(data):  # words are not empty
        for k, members in enumerate(CLASSES):
            table = np.zeros(256, bool)
            table[np.frombuffer(members, np.uint8)] = True
            out[k] = np.add.reduceat(table[data], offsets[:-1] - offsets[0], dtype=np.int64)
    return out


def repeated_window_words(rows: np.ndarray, codes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words lie in a run of ``size`` words that their row holds twice or more."""
    marked = np.zeros(len(codes), bool)
    n = len(codes) - size + 1
    if n <= 0:
        return marked
    value = rows[:n].astype(np.uint64)
    for i in range(size):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + codes[i:n + i].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(rows[:n] == rows[size - 1:])
    order = at[np.argsort(value[at], kind="stable")]
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = order[twice]
    for i in range(size):
        marked[starts + i] = True
    return marked


def lines_of(texts: pa.Array) -> Lines:
    """Lines and base counts of whole texts. Words are runs of anything but space and ``\\t`` to ``\\r``."""
    n = len(texts)
    lists = pc.split_pattern(texts, "\n")
    lines, line_row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = pc.ascii_split_whitespace(lines)
    words, word_line = pc.list_flatten(parts), pc.list_parent_indices(parts)
    full = pc.not_equal(words, "")
    coded = pc.filter(words, full).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line = pc.filter(word_line, full).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    classes = _class_counts(coded.dictionary)
    bare = pc.utf8_lower(pc.utf8_trim(coded.dictionary, " .,;:!?()[]|<>\"'*#-"))
    furniture = pc.is_in(bare, pa.array(sorted(FURNITURE), bare.type)).to_numpy(zero_copy_only=False)

    used = np.unique(line)
    place = np.searchsorted(used, line)  # number of each word's line among the lines with a word
    row, k = line_row[used], len(used)
    word_row = row[place]
    total = lambda weight: np.bincount(place, weight, k)
    words_in = np.bincount(place, minlength=k)
    bytes_in = np.maximum(total(size[codes]), 1)

    line_code = pc.take(lines, pa.array(used)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first = np.unique(row * (k + 1) + line_code, return_index=True)
    repeated = np.ones(k, bool)
    repeated[first] = False
    windows = repeated_window_words(word_row, codes)
    next_same = np.zeros(len(codes), bool)
    next_same[1:] = (codes[1:] == codes[:-1]) & (place[1:] == place[:-1])
    one_of = np.unique(place * (len(coded.dictionary) + 1) + codes) // (len(coded.dictionary) + 1)
    ends = np.cumsum(words_in) - 1
    last = coded.dictionary.take(pa.array(codes[ends])) if k else pa.array([], pa.string())

    figures = np.zeros((k, N_FIGURES))
    for c in range(len(CLASSES)):
        figures[:, c] = total(classes[c][codes]) / bytes_in
    c, some = len(CLASSES), np.maximum(words_in, 1)
    figures[:, c] = repeated
    figures[:, c + 1] = total(windows) / some
    figures[:, c + 2] = total(next_same) / some
    figures[:, c + 3] = np.bincount(one_of, minlength=k) / some
    figures[:, c + 4] = words_in < 3
    figures[:, c + 5] = words_in < 8
    figures[:, c + 6] = np.minimum(1, np.log1p(words_in) / 8)
    figures[:, c + 7] = np.minimum(1, total(chars[codes]) / some / 20)
    figures[:, c + 8] = total(furniture[codes]) / some
    figures[:, c + 9] = pc.match_substring_regex(last, r"[.!?:;。！？…]['\")\]»”]*$").to_numpy(zero_copy_only=False) if k else 0
    figures[:, c + 10] = total(classes[0][codes] > 0) / some  # words with a symbol
    by_row = lambda weight: np.bincount(word_row, weight, n).astype(np.int64)
    stats = {"n_words": np.bincount(word_row, minlength=n).astype(np.int64), "word_chars": by_row(chars[codes]), "n_symbols": by_row(classes[0][codes]),
             "n_dup_lines": np.bincount(row, repeated, n).astype(np.int64), "n_repeat_words": by_row(windows)}
    return Lines(row, words_in, figures, repeated, stats)


@dataclass
class LineField:
    """Label scores of the figures (``figures x 2``) and of each label alone, of a first label, and of neighbouring labels."""

    weight: np.ndarray
    bias: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def emissions(self, figures: np.ndarray) -> np.ndarray:
        return figures @ self.weight + self.bias

    def decode(self, figures: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best label of every line; lines of one text are neighbours and have equal ``row``."""
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        return viterbi(self.emissions(figures), first, self.start, self.step)


def viterbi(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best label sequence of each chain; ``first`` marks where chains begin. Of equally good labels, content.

    Two labels leave one number to carry, by how much content leads, so any length takes one pass forward and one back.
    """
    n = len(emission)
    lead_in = (emission[:, 1] - emission[:, 0]).tolist()
    begins, opening = first.tolist(), float(start[1] - start[0])
    (s00, s01), (s10, s11) = step.tolist()
    to_0, to_1, leads = [0] * n, [0] * n, [0.0] * n
    lead = 0.0
    for i in range(n):
        if begins[i]:
            lead = opening + lead_in[i]
        else:  # paths through content have `lead` more than those through boilerplate
            a, b = lead + s10, lead + s11
            if a >= s00:
                to_0[i], low = 1, a
            else:
                low = s00
            if b >= s01:
                to_1[i], high = 1, b
            else:
                high = s01
            lead = high - low + lead_in[i]
        leads[i] = lead
    out = [0] * n
    after = -1
    for i in range(n - 1, -1, -1):
        label = (1 if leads[i] >= 0 else 0) if after < 0 else (to_1[i + 1] if after else to_0[i + 1])
        out[i] = label
        after = -1 if begins[i] else label
    return np.array(out, np.int8)


def marginals(emission: np.ndarray, mask: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(log partition per chain, label probabilities, summed probabilities of neighbouring labels)`` by forward-backward.

    ``emission`` is ``lines x chains x 2``; ``mask`` marks the lines that a chain has, from the first on.
    """
    steps, chains, _ = emission.shape
    alpha, beta = np.empty_like(emission), np.zeros_like(emission)
    alpha[0] = start + emission[0]
    for t in range(1, steps):
        new = np.logaddexp(alpha[t - 1][:, :1] + step[0], alpha[t - 1][:, 1:] + step[1]) + emission[t]
        alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = emission[t + 1] + beta[t + 1]
        new = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
        beta[t] = np.where(mask[t + 1][:, None], new, beta[t + 1])
    log_z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    node = np.exp(alpha + beta - log_z[:, None]) * mask[:, :, None]
    pair = alpha[:-1, :, :, None] + step + (emission[1:] + beta[1:])[:, :, None, :] - log_z[:, None, None]
    edge = np.where(mask[1:, :, None, None], np.exp(np.minimum(pair, 0)), 0).sum(axis=(0, 1))
    return log_z, node, edge


def fit_field(figures: np.ndarray, row: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 1e-4) -> LineField:
    """Fit by AdaGrad on the log likelihood of the label sequences; texts longer than ``TRAINED_LINES`` count as several.

    Without lines of both labels every line is content (all neutral scores, a slight lead).
    """
    model = LineField(np.zeros((N_FIGURES, 2)), np.array([0.0, 0.01]), np.zeros(2), np.zeros((2, 2)))
    if not len(labels) or labels.min() == labels.max():
        return model
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    position = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    chain = np.cumsum(position % TRAINED_LINES == 0) - 1
    at = (position % TRAINED_LINES, chain)
    shape = (at[0].max() + 1, chain[-1] + 1)
    mask, truth = np.zeros(shape, bool), np.zeros(shape, np.int64)
    mask[at], truth[at] = True, labels
    one = np.eye(2)
    both = mask[1:]
    seen_step = np.array([[(both & (truth[:-1] == i) & (truth[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen_start = one[truth[0]].sum(axis=0)
    lines, gains = len(labels), {k: np.full(getattr(model, k).shape, 1e-6) for k in ("weight", "bias", "start", "step")}
    for _ in range(rounds):
        emission = np.zeros((*shape, 2))
        emission[at] = model.emissions(figures)
        _, node, edge = marginals(emission, mask, model.start, model.step)
        off = node[at] - one[labels]
        slopes = {"weight": figures.T @ off / lines + decay * model.weight, "bias": off.sum(axis=0) / lines,
                  "start": (node[0].sum(axis=0) - seen_start) / lines, "step": (edge - seen_step) / lines + decay * model.step}
        for k, slope in slopes.items():
            gains[k] += slope ** 2
            setattr(model, k, getattr(model, k) - rate * slope / np.sqrt(gains[k]))
    return model


def train_field(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> LineField:
    """Fit on at most ``most`` labelled documents (a bounded sample, the same for the same rows).

    Rows whose label is neither 0 nor 1, whose identifier is null or whose labels conflict are left out.
    """
    clean = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).filter("y = y2")
    chosen = clean.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "y")
    known = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    bound_batches(documents.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the figures, not the texts, go to the driver
        for batch in slices(batches, "text"):
            lines = lines_of(texts_of(batch, "text"))
            y = np.where(lines.repeated, BOILERPLATE, batch.column("y").to_numpy(zero_copy_only=False)[lines.row])
            flat = pa.FixedSizeListArray.from_arrays(pa.array(lines.figures.ravel()), N_FIGURES).cast(pa.list_(pa.float64()))
            at = np.concatenate([np.arange(c) for c in np.unique(lines.row, return_counts=True)[1]]) if len(lines.row) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(lines.row)), pa.array(at), pa.array(y.astype(np.int32)), flat], ["id", "at", "y", "figures"])

    once = known.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = once.mapInArrow(describe, f"id {dict(documents.dtypes)[id_col]}, at long, y int, figures array<double>").orderBy("id", "at").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit_field(np.zeros((0, N_FIGURES)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = rows.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
    figures = rows.column("figures").combine_chunks().flatten().to_numpy().reshape(-1, N_FIGURES)
    return fit_field(figures, row, rows.column("y").to_numpy().astype(np.int64))


def label_lines(documents: DataFrame, model: LineField, text_col: str = "text", least_content: float = LEAST_CONTENT, keep_text: bool = True) -> DataFrame:
    """``documents`` with the base counts (``STATS``), ``n_content_words``, ``line_labels`` (a letter per line with a
    word: C content, B boilerplate), ``base_failed`` and ``kept``; columns of these names are replaced.

    Every row gets its result, repeated ones alike, with null identifiers too. Null, empty and wordless texts have
    zero counts and no labels; they fail the base rules like all texts under ten words. An empty table stays empty.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    added = [*STATS, "n_content_words", "line_labels", "base_failed", "kept"]
    documents = documents.drop(*added)
    kept = [c for c in documents.columns if keep_text or c != text_col]
    known = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            lines = lines_of(texts_of(batch, text_col))
            label = known.value.decode(lines.figures, lines.row)
            content = np.bincount(lines.row, lines.words * (label == CONTENT), batch.num_rows).astype(np.int64)
            ends = np.searchsorted(lines.row, np.arange(batch.num_rows + 1))
            letters = np.where(label == CONTENT, b"C", b"B").astype("S1").tobytes().decode()
            columns = [pa.array(lines.stats[s]) for s in STATS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns, pa.array(content), pa.array([letters[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())],
                                             [*kept, *STATS, "n_content_words", "line_labels"])

    schema = documents.select(*kept).withColumns({**{s: F.lit(0).cast("long") for s in STATS}, "n_content_words": F.lit(0).cast("long"), "line_labels": F.lit("")}).schema
    out = documents.mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_content_words") >= least_content * F.col("n_words")))
