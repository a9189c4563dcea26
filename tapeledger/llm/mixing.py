"""Soft-membership mixing: rates at which documents are taken so that domains reach target shares of the tokens.

A classifier fitted on a labelled table gives every document a posterior over domains. The rates ``r_i >= 0`` minimise
``sum_d (sum_i r_i t_i p_id - target_d)^2 / m_d`` with ``m_d = sum_i t_i p_id``, by projected gradient steps from
``r = 1``. In the metric weighted by tokens the step is ``r_i <- max(0, r_i - sum_d p_id g_d / m_d)`` and needs no
step size: the largest eigenvalue of the scaled problem is at most 1. The gradient ``g`` is one number per domain, summed
over the documents by Spark; rates are not stored but recomputed from the few gradients so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices, spare_names, texts_of
from tapeledger.llm.factor_machine import N_STATS, features, features_in_parts
from tapeledger.llm.words import word_codes
from tapeledger.session import cut_lineage

#: Labelled rows used for fitting, at most; taken by the hash of the identifier.
MAX_LABELLED = 4000
#: Steps at most, and how near to its target a domain must come, as a share of the mixture.
MAX_STEPS, TOLERANCE = 200, 1e-3
#: Hashed words, and the scale of the statistics beside a word's 1.
WORD_BINS, STAT_SCALE = 1 << 18, 4.0


@dataclass
class DomainModel:
    """Softmax over structure statistics and the presence of chosen hashed words; ``column`` is -1 for words not chosen."""

    domains: list[str]
    bias: np.ndarray
    column: np.ndarray
    weight: np.ndarray

    def matrix(self, texts: pa.Array) -> np.ndarray:
        row, bin_, value = features_in_parts(texts, WORD_BINS) if len(texts) > 2000 else features(texts, WORD_BINS)
        at = self.column[bin_]
        used = at >= 0
        x = np.zeros((len(texts), len(self.weight)))
        x[row[used], at[used]] = np.where(bin_[used] < N_STATS, STAT_SCALE * value[used], 1.0)
        return x

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        return _softmax(self.matrix(texts) @ self.weight + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
    return z / z.sum(axis=1, keepdims=True) if z.shape[1] else z


def fit_domains(texts: pa.Array, labels: np.ndarray, domains: list[str], words: int = 200, steps: int = 300, rate: float = 0.3, decay: float = 2e-4) -> DomainModel:
    """Choose for each domain the hashed words most over-represented in it, then fit a softmax by AdaGrad.

    ``labels`` are positions in ``domains``. A domain without rows gets almost no mass; without any rows all
    domains are alike.
    """
    k, n = len(domains), len(labels)
    seen = np.bincount(labels, minlength=k) if n else np.zeros(k)
    column = np.full(N_STATS + WORD_BINS, -1, np.int32)
    column[:N_STATS] = np.arange(N_STATS)
    bias = np.log((seen + 0.1) / (seen.sum() + 0.1 * k)) if k else np.zeros(0)
    if not n:
        return DomainModel(domains, bias, column, np.zeros((N_STATS, k)))
    row, bin_, _ = features_in_parts(texts, WORD_BINS)
    row, bin_ = row[bin_ >= N_STATS], bin_[bin_ >= N_STATS]
    row, bin_ = np.divmod(np.unique(row * len(column) + bin_), len(column))
    total = np.bincount(bin_, minlength=len(column))
    chosen: set[int] = set()
    for d in range(k):
        share = seen[d] / n
        own = np.bincount(bin_[labels[row] == d], minlength=len(column))
        z = (own - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
        best = np.argsort(-z, kind="stable")[:words]
        chosen.update(best[(z[best] > 3) & (own[best] >= 5)].tolist())
    column[sorted(chosen)] = N_STATS + np.arange(len(chosen))
    model = DomainModel(domains, bias, column, np.zeros((N_STATS + len(chosen), k)))
    x = model.matrix(texts)
    target = np.eye(k)[labels]
    g_w, g_b = np.full(model.weight.shape, 1e-6), np.full(k, 1e-6)
    for _ in range(steps):
        slope = (_softmax(x @ model.weight + model.bias) - target) / n
        d_w, d_b = x.T @ slope + decay * model.weight, slope.sum(axis=0)
        g_w += d_w ** 2
        g_b += d_b ** 2
        model.weight -= rate * d_w / np.sqrt(g_w)
        model.bias = model.bias - rate * d_b / np.sqrt(g_b)
    return model


def train_domains(documents: DataFrame, labelled: DataFrame, domains: list[str], domain_col: str = "domain", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DomainModel:
    """Fit on at most ``most`` rows of ``labelled(id, domain)``; null, unknown and conflicting labels are left out."""
    clean = labelled.filter(F.col(domain_col).isin(*domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(domain_col).alias("_y"), F.max(domain_col).alias("_y2")).filter("_y = _y2")
    chosen = clean.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", "_y")
    known = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(chosen, "_id")
    rows = known.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")).orderBy("_id").toArrow()
    place = {d: i for i, d in enumerate(domains)}
    texts = rows.column("_text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return fit_domains(texts, np.array([place[d] for d in rows.column("_y").to_pylist()], np.int64), domains)


def posteriors(documents: DataFrame, model: DomainModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``documents`` with ``tokens`` (words of the whole text) and ``posterior`` (one number per domain)."""
    spark = documents.sparkSession
    bound_batches(spark)
    known = spark.sparkContext.broadcast(model)  # of fixed size: hashed words, chosen words x domains
    documents = documents.drop("tokens", "posterior")
    names = [c for c in documents.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = texts_of(batch, text_col)
            p = known.value.posteriors(texts)
            words = np.bincount(word_codes(texts, lower=False)[1], minlength=len(texts)).astype(np.int64)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(words), flat], [*names, "tokens", "posterior"])

    schema = documents.select(*names).withColumns({"tokens": F.lit(0).cast("long"), "posterior": F.array(F.lit(0.0))}).schema
    return documents.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)


@dataclass
class Bounds:
    """Least and greatest rate of a document, by its likeliest domain."""

    low: np.ndarray
    high: np.ndarray


def rates(p: np.ndarray, steps: list[np.ndarray], bounds: Bounds | None = None) -> np.ndarray:
    """The rates after the gradient steps, each given as one number per domain."""
    likeliest = p.argmax(axis=1) if bounds else None
    low, high = (bounds.low[likeliest], bounds.high[likeliest]) if bounds else (0.0, np.inf)
    r = np.clip(np.ones(len(p)), low, high)
    for step in steps:
        r = np.clip(r - p @ step, low, high)
    return r


def _totals(scored: DataFrame, steps: list[np.ndarray], k: int, bounds: Bounds | None = None) -> np.ndarray:
    """``sum_i r_i t_i p_id`` per domain: one row from each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            p = _matrix(batch, k)
            total += (rates(p, steps, bounds) * batch.column("tokens").to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["d", "total"])

    rows = scored.select("tokens", "posterior").mapInArrow(run, "d long, total double").groupBy("d").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(k)
    out[rows.column("d").to_numpy()] = rows.column("total").to_numpy()
    return out


@dataclass
class Solution:
    """The gradient steps, how far the totals stay from their targets (largest difference as a share of the mixture),
    and whether the steps came to rest: at the targets, or at the least-squares answer where no rates reach them."""

    steps: list[np.ndarray]
    residual: float = 0.0
    converged: bool = True


def solve_rates(scored: DataFrame, weights: list[float], anchor: int | None = None, bounds: Bounds | None = None) -> Solution:
    """The gradient steps that lead from rate 1 to the best rates for ``weights`` (shares of the mixed tokens).

    The mixture has as many tokens as the corpus, or, with ``anchor``, so many that this domain keeps its own. Domains
    without mass are left out. Targets that no nonnegative rates reach give the least-squares answer.
    """
    k, w = len(weights), np.array(weights, float)
    w = w / w.sum() if w.sum() > 0 else w
    mass = _totals(scored, [], k)
    live = mass > 0
    if not live.any():
        return Solution([])
    size = mass[anchor] / w[anchor] if anchor is not None and mass[anchor] > 0 and w[anchor] > 0 else mass.sum()
    target, steps, totals = w * size, [], mass if bounds is None else _totals(scored, [], k, bounds)
    rest = False
    while not rest and len(steps) < MAX_STEPS:
        off = totals - target
        if np.all(np.abs(off[live]) <= TOLERANCE * np.maximum(target, 0.01 * size)[live]):
            rest = True
            break
        steps.append(np.where(live, off / np.where(live, mass, 1), 0.0))
        after = _totals(scored, steps, k, bounds)
        rest = bool(np.abs(after - totals).max() <= 1e-5 * size)
        totals = after
    return Solution(steps, float(np.abs((totals - target)[live]).max() / size), rest)


def mix(documents: DataFrame, model: DomainModel, weights: dict[str, float], anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, keep: tuple[str, ...] = (), most: float = np.inf) -> DataFrame:
    """``documents`` with ``tokens``, ``posterior``, ``rate``, ``copies``, ``n_steps``, ``residual`` and ``converged``
    (columns of these names are replaced; the last three are those of the solution, alike on all rows).

    ``copies`` is the whole part of the rate, and one more with the probability of the rest, decided by a hash of
    identifier and text: the same on every cluster, for equal texts under different identifiers different, for
    repeated rows the same. Documents whose likeliest domain (of equally likely ones the first) is one of ``keep``
    have a rate of 1, so they are neither drawn out nor doubled; no rate is above ``most``. Null and empty texts have no tokens and are given their
    rate like others. An empty table stays empty.
    """
    documents = documents.drop("tokens", "posterior", "rate", "copies", "n_steps", "residual", "converged")
    (draw,) = spare_names(documents, "draw")
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), 11) / float(1 << 53)
    scored = cut_lineage(posteriors(documents.withColumn(draw, drawn), model, text_col, keep_text), "mixing_scored")
    k = len(model.domains)
    bounds = Bounds(np.array([float(d in keep) for d in model.domains]), np.array([1.0 if d in keep else most for d in model.domains])) if keep or most < np.inf else None
    solution = solve_rates(scored, [weights.get(d, 0.0) for d in model.domains], model.domains.index(anchor) if anchor else None, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(_matrix(batch, k), solution.steps, bounds))], [*batch.schema.names, "rate"])

    rated = scored.mapInArrow(run, scored.withColumn("rate", F.lit(0.0)).schema)
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col(draw)).cast("int")).drop(draw).withColumns(
        {"n_steps": F.lit(len(solution.steps)), "residual": F.lit(solution.residual), "converged": F.lit(solution.converged)})


def apply_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: every row as many times as its ``copies``; rows with none go."""
    (copy,) = spare_names(mixed, "copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def mixed_corpus(documents: DataFrame, model: DomainModel, weights: dict[str, float], **options) -> DataFrame:
    """The mixed corpus of ``mix`` (same ``options``) with exactly the columns of ``documents``, also where these have names
    that ``mix`` gives to columns of its own."""
    own = ["tokens", "posterior", "rate", "copies", "n_steps", "residual", "converged"]
    clash = [c for c in documents.columns if c.lower() in own]
    aside = dict(zip(clash, spare_names(documents, *clash), strict=True))
    renamed = documents.withColumnsRenamed(aside)
    out = apply_copies(mix(renamed, model, weights, **options), renamed.columns)
    return out.withColumnsRenamed({new: old for old, new in aside.items()}).select(*documents.columns)
