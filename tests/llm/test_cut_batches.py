"""Every text operator gives the same whether a batch is cut into pieces or not; clashing columns, id types, owners, metadata."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tapeledger.llm import batches, cross_polytope, divergence, factor_machine, id_files, license_scan, line_crf, mixing, ngram_join, packing, queries, secret_scan, simhash, url_filter
from tapeledger.llm.words import word_codes

NAMES = ["Alpha", "BETA", "été", "ÉCOLE", "straße", "漢字", "x1", "don't", "Zürich", "naïve", "token=Abcdef0123456789xyz", "MIT License", "###", "I"]


def texts(n=60, seed=1):
    r = random.Random(seed)
    out = [" ".join(r.choice(NAMES) for _ in range(r.randrange(1, 60))) + r.choice(["", ".\n", "\nLast LINE"]) for _ in range(n)]
    return [*out, None, "", "Æ" * 3000, *(t.upper() for t in out[:8]), *out[:5]]


def documents(spark, seed=1):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts(seed=seed))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def domain_model(spark):
    labelled = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "doc_id long, domain string")
    return mixing.train_domains(documents(spark), labelled, ["a", "b"])


def machine(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    return factor_machine.train(documents(spark), labels)


OPERATORS = {
    "ngram_join": (ngram_join, lambda s, d: ngram_join.near_duplicates(d)),
    "mixing": (mixing, lambda s, d: mixing.posteriors(d, domain_model(s)).drop("text")),
    "simhash": (simhash, lambda s, d: simhash.fingerprint_with_next(d)),
    "license_scan": (license_scan, lambda s, d: license_scan.scan_licenses(d.select("doc_id", "text"))),
    "secret_scan": (secret_scan, lambda s, d: secret_scan.scan_secrets(d)),
    "id_files": (id_files, lambda s, d: id_files.encode_corpus(d, queries.tokenizer("byte_bpe_50k.json"))),
    "factor_machine": (factor_machine, lambda s, d: factor_machine.score_documents(d.drop("text_"), machine(s)).drop("text")),
    "packing": (packing, lambda s, d: packing.pack_documents(d, queries.tokenizer("word_bpe_49k.json"), window=64, with_ids=False)),
    "divergence": (divergence, lambda s, d: divergence.divergences(d)),
    "line_crf": (line_crf, lambda s, d: line_crf.label_lines(d, line_crf.fit_field(np.zeros((0, line_crf.N_FIGURES)), np.zeros(0, int), np.zeros(0, int)), keep_text=False)),
}


@pytest.mark.parametrize("name", sorted(n for n, (m, _) in OPERATORS.items() if hasattr(m, "slices")))
def test_cut_batches_give_the_same(spark, monkeypatch, name):
    module, run = OPERATORS[name]
    docs = documents(spark)

    def plain(value):  # sums of floating-point numbers follow the size of a batch in their last digits
        return round(value, 9) if isinstance(value, float) else [plain(v) for v in value] if isinstance(value, (list, tuple)) else value

    whole = sorted(str(plain(r)) for r in run(spark, docs).collect())
    monkeypatch.setattr(module, "slices", lambda parts, column: __import__("tapeledger.llm.batches", fromlist=["slices"]).slices(parts, column, 300))
    cut = sorted(str(plain(r)) for r in run(spark, docs).collect())
    assert whole and cut == whole


def test_texts_of_slices_are_arrays_of_their_own():
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", "DEF ghi", None, "JKL", "mno P", "É A"])], ["text"])
    pieces = list(batches.slices(iter([batch]), "text", 8))
    assert len(pieces) > 2
    for most in (8, 1, 100):
        words = []
        for piece in batches.slices(iter([batch]), "text", most):
            codes, _, names = word_codes(batches.texts_of(piece, "text"))
            words += [names[c] for c in codes]
        assert words == ["abc", "def", "ghi", "jkl", "mno", "p", "É", "a"]


def test_words_that_become_equal_share_a_code():
    codes, rows, names = word_codes(pa.array(["The THE the", "tHe É é"], pa.large_string()))
    assert names == ["the", "É", "é"] and codes.tolist() == [0, 0, 0, 0, 1, 2] and rows.tolist() == [0, 0, 0, 1, 1, 1]


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>", "mine", "k", "r", "h")], "page_id long, url string, html string, action string, key string, reached string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = url_filter.judge_urls(pages, rules).first()
    assert (got["action"], got["key"], got["reached"], got["host"], got["verdict"]) == ("mine", "k", "r", "a.net", "block")
    secret = "token=" + "Ab3" * 8
    docs = spark.createDataFrame([(1, secret, "s", "_t", "d", "c", "r", 7)], "doc_id long, text string, source string, _text string, digest string, cuts string, row string, copy int")
    masked = secret_scan.redact_live(docs).first()
    assert masked.asDict() == {"doc_id": 1, "text": "[secret]", "source": "s", "_text": "_t", "digest": "d", "cuts": "c", "row": "r", "copy": 7}
    assert secret_scan.scan_secrets(docs).first()["row"] == "r"
    copies = mixing.apply_copies(docs.withColumn("copies", F.lit(2)), docs.columns)
    assert [r["copy"] for r in copies.collect()] == [7, 7]
    kept = ngram_join.keep_first(docs.unionByName(docs).withColumnRenamed("digest", "k").withColumnRenamed("cuts", "h"))
    assert [(r["k"], r["h"]) for r in kept.collect()] == [("d", "c")]


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(10,0)"])
def test_packing_keeps_the_type_of_the_id(spark, kind):
    docs = spark.range(3).select(F.col("id").cast(kind).alias("doc_id"), F.lit("some words here").alias("text"))
    got = packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"), with_ids=False)
    assert dict(got.dtypes)["doc_id"] == kind and got.count() == 3


def test_owners_and_repositories_both_count(spark):
    value = lambda i: f"token=Secret{i:04d}{'x' * 12}"
    rows = [(value(1), "r1", "a"), (value(1), "r2", "a"), *((value(2), f"r{i}", "a") for i in range(12)), *((value(3), "r1", o) for o in "abc"), (value(4), None, None)]
    docs = spark.createDataFrame([(i, t, r, o) for i, (t, r, o) in enumerate(rows)], "doc_id long, text string, repo string, owner string")
    got = {r["text"][12:16]: r for r in secret_scan.scan_secrets(docs, "repo", "owner").join(docs.select("doc_id", "text"), "doc_id").collect()}
    state = {k: (r["n_live"], r["most_repos"], r["most_owners"]) for k, r in got.items()}
    assert state == {"0001": (1, 2, 1), "0002": (0, 12, 1), "0003": (0, 3, 3), "0004": (1, 1, 1)}


def test_metadata_alone_can_decide(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["a", "b", "c"]) for _ in range(20)), "good" if i % 2 else "bad", 10.0 if i % 2 else 5000.0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, size double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    for columns in (("kind",), ("size",), ("kind", "size")):
        model = factor_machine.train(docs, labels, metadata=columns)
        held = factor_machine.score_documents(docs.filter("doc_id >= 200"), model, metadata=columns)
        assert held.columns == [*docs.columns, "score"]
        assert all((x["score"] > 0.5) == (x["doc_id"] % 2 == 1) for x in held.collect())
    odd = spark.createDataFrame([(1, None, None, float("nan")), (2, "", "", None)], docs.schema)
    assert factor_machine.score_documents(odd, model, metadata=("kind", "size")).count() == 2


def test_repeated_ids_leave_room_for_other_neighbours():
    r = np.random.default_rng(0)
    vectors = r.standard_normal((60, 8))
    ids = np.concatenate([np.zeros(40, np.int64), np.arange(1, 21)])
    query = vectors[0]
    vectors[:40] = query * 5
    q, i, s = cross_polytope.nearest(ids, vectors, np.array([99]), query[None, :], 5)
    best = sorted(((-(vectors[ids == k] @ query).max(), k) for k in range(21)))[:5]
    assert i.tolist() == [k for _, k in best] and np.allclose(s, [-v for v, _ in best])


def test_mixture_does_not_depend_on_partitions(spark):
    docs, model = documents(spark, 2), domain_model(spark)
    one, many = ({(r["doc_id"], r["copies"]) for r in mixing.mix(d, model, {"a": 0.3, "b": 0.7}).collect()} for d in (docs, docs.repartition(7)))
    assert one == many
    told = mixing.mix(docs, model, {"a": 0.3, "b": 0.7}).first()
    assert told["n_steps"] > 0 and (told["residual"] < 0.01 or not told["converged"] or told["n_steps"] < mixing.MAX_STEPS)


def odd_documents(spark):
    good = "The committee met on a quiet morning and agreed to publish the results of its long study. " * 6
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, good, "en", "s", len(good)), (3, good, "en", "s", len(good)), (4, good + " Once more.", None, "t", 5), (None, good, "en", "s", 1), (5, "token=Abc123Abc123Abc123 " + good, "en", "s", 9)]
    return spark.createDataFrame([(*r, "mine", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, rate double")


@pytest.mark.parametrize("i", range(5))
def test_pipeline_stages_on_odd_rows(spark, i):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[i]
    docs, sf = odd_documents(spark), "/root/testdata/sf0.001"
    out = stage(spark, docs, sf)
    got = out.collect()
    if i < 4:
        assert out.columns == docs.columns and all(r["copies"] == "mine" and r["rate"] == 1.5 for r in got)
    assert stage(spark, docs.limit(0), sf).count() == 0
    ids = sorted(str(r["doc_id"]) for r in got)
    if name == "ngram_jaccard_join":
        assert ids == ["1", "2", "3", "None"]
    if name == "secret_scans":
        assert len(got) == 7 and [r["text"][:9] for r in got if r["doc_id"] == 5] == ["[secret] "]
    if name == "packing":
        assert len(got) == 7
