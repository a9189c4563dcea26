"""The line field against enumeration of all label sequences, its base counts against regular expressions, held-out labels."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tapeledger.llm import line_crf, queries

ODD = [None, "", " \n\t ", "one", "a b c d e f g h i j", "a b c d e " * 6, "Menu | Home | Login\nMenu | Home | Login\nA plain line of text stands here.\r\n\r\n",
       "é è ü\x0bb\x0cc\n\n\nx\nx\n x\nx", "#*$%&|<> & && *", "w " * 3000, "\n".join(f"line {i % 40} of many" for i in range(900)), "same", "same"]


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def score(emission, start, step, labels):
    return start[labels[0]] + sum(emission[i, y] for i, y in enumerate(labels)) + sum(step[a, b] for a, b in itertools.pairwise(labels))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_and_marginals_match_enumeration(seed):
    r = np.random.default_rng(seed)
    start, step = r.standard_normal(2), r.standard_normal((2, 2)) * 2
    sizes = [1, 4, 7, 2]
    emission = r.standard_normal((sum(sizes), 2)) * 2
    first = np.zeros(len(emission), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, at = line_crf.viterbi(emission, first, start, step), 0
    padded, mask = np.zeros((7, 4, 2)), np.zeros((7, 4), bool)
    for k, n in enumerate(sizes):
        padded[:n, k], mask[:n, k] = emission[at:at + n], True
        every = list(itertools.product((0, 1), repeat=n))
        best = max(every, key=lambda y: score(emission[at:at + n], start, step, y))
        assert tuple(got[at:at + n]) == best
        at += n
    log_z, node, edge = line_crf.marginals(padded, mask, start, step)
    all_edges = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        weights = {y: np.exp(score(padded[:n, k], start, step, y)) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        assert np.isclose(np.exp(log_z[k]), z)
        for t in range(n):
            assert np.isclose(node[t, k, 1], sum(w for y, w in weights.items() if y[t]) / z)
        for y, w in weights.items():
            for a, b in itertools.pairwise(y):
                all_edges[a, b] += w / z
    assert np.allclose(edge, all_edges)


def test_fitting_raises_the_likelihood_of_neighbours():
    """Lines whose own figures say nothing are told by their neighbours."""
    r = np.random.default_rng(2)
    labels = np.concatenate([np.repeat(r.integers(0, 2, 4), 5) for _ in range(80)])
    row = np.repeat(np.arange(80), 20)
    figures = np.zeros((len(labels), line_crf.N_FIGURES))
    figures[:, 0] = labels * 0.6 + r.standard_normal(len(labels)) * 0.5
    model = line_crf.fit_field(figures, row, labels)
    alone = (model.emissions(figures).argmax(axis=1) == labels).mean()
    assert (model.decode(figures, row) == labels).mean() > alone + 0.05 and model.step[0, 0] + model.step[1, 1] > model.step[0, 1] + model.step[1, 0]


def test_base_counts_match_plain_rules():
    r = np.random.default_rng(4)
    texts = [t or "" for t in ODD] + ["".join(r.choice(["a", "b ", "\n", " ", "c", "#", "é"], r.integers(0, 80))) for _ in range(300)]
    stats = line_crf.lines_of(pa.array(texts, pa.large_string())).stats
    assert [tuple(int(stats[s][i]) for s in line_crf.STATS) for i in range(len(texts))] == [base_counts(t) for t in texts]


def test_labelled_lines_of_odd_rows(spark, monkeypatch):
    field = line_crf.fit_field(np.zeros((0, line_crf.N_FIGURES)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = [(None if i == 3 else i, t, True, "C") for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, line_labels string")
    monkeypatch.setattr(line_crf, "slices", lambda batches, c: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    got = line_crf.label_lines(frame, field).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", *line_crf.STATS, "n_content_words", "line_labels", "base_failed", "kept"}
    for x in got:
        counts = base_counts(x["text"])
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert tuple(x[s] for s in line_crf.STATS) == counts and x["base_failed"] == failed
        assert x["kept"] == (not failed) and x["n_content_words"] == counts[0]  # without labels every line is content
        assert len(x["line_labels"]) == len([y for y in (x["text"] or "").split("\n") if y.split()])
    assert line_crf.label_lines(frame.limit(0), field).count() == 0


def test_retention_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents").select("doc_id", "text"), queries.table(spark, sf, "labels")
    extra = labels.selectExpr("doc_id", "1 - quality as quality").filter("doc_id = 0").unionByName(labels.selectExpr("cast(null as long) doc_id", "5 quality"))
    field = line_crf.train_field(docs, labels.select("doc_id", "quality").filter("doc_id % 2 = 0").unionByName(extra))
    got = line_crf.label_lines(docs, field).join(labels.filter("doc_id % 2 = 1 and not (quality = 1 and toxic = 1)"), "doc_id").filter("not base_failed").groupBy("quality").agg({"*": "count", "kept": "max"}).count()
    assert got == 2
    rates = {r["quality"]: r["k"] / r["n"] for r in line_crf.label_lines(docs, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").groupBy("quality").agg(
        {"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").join(line_crf.label_lines(docs, field).filter("kept").join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "k"), "quality").collect()}
    assert rates[1] >= 0.98 and rates[0] <= 0.2


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents").toPandas()
    got = queries.QUERIES["op12_line_crf"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for d, t in zip(docs["doc_id"], docs["text"]):
        assert tuple(int(got.loc[d, s]) for s in line_crf.STATS) == base_counts(t)
    assert not (got["kept"] & got["base_failed"]).any() and 0 < got["kept"].sum() < len(got)
