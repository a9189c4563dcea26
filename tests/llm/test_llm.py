"""The training-data operators against brute force on small fixtures, and on null, empty, long, tied and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeledger.llm import cross_polytope, factor_machine, id_files, license_scan, mixing, ngram_join, packing, queries, secret_scan, simhash, url_filter
from tapeledger.llm.components import connected_components
from tapeledger.llm.tokens import PieceTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(n, seed, names=400):
    r = random.Random(seed)
    return [f"w{r.randrange(names)}" for _ in range(n)]


# components


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (None, 4), (7, 8)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1. n-gram join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1:]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def near_copies(base, n, edits, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 30)  # so that small lists are compared in tiles too
    monkeypatch.setattr(ngram_join, "TILE", 16)
    passage = " ".join(words(60, 5))
    texts = [None, "", " \n\t ", "one", "One", "a b c", "a b c", "A B C d"]
    texts += near_copies(words(150, 1), 60, 3, 2) + near_copies(words(150, 3), 30, 1, 4) + [" ".join(words(120, 9))] * 20
    texts += [" ".join(words(40 + i, 100 + i)) + " " + passage for i in range(25)] + [" ".join(words(4000, 77)), " ".join(words(4000, 77)[:3700])]
    rows = list(enumerate(texts)) + [(3, "one"), (5, " ".join(words(150, 3))), (None, "one"), (None, None)]
    got = ngram_join.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    expected = brute_components(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == sorted(
        (i is None, i or 0, len(shingle_set(t)), expected.get(i, 0)) for i, t in rows)
    kept = {r["doc_id"] for r in ngram_join.keep_first(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert kept == {i for i in expected if expected[i] == i} | {None}


def test_ngram_join_of_nothing(spark):
    empty = docs_of(spark, [])
    assert ngram_join.near_duplicates(empty).count() == 0
    assert sorted(ngram_join.near_duplicates(docs_of(spark, [(1, None, "s"), (2, "", "s")])).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_prefix_choice_asks_for_more_where_lists_are_long():
    plain = ngram_join.choose_prefix(np.zeros(100, np.uint8))
    assert plain == (21, 1)
    length, matches = ngram_join.choose_prefix(np.full(100, 12, np.uint8))
    assert matches > 1 and length == 20 + matches
    assert ngram_join.choose_prefix(np.full(1, 30, np.uint8)) == (1, 1)


# 2. mixing


def test_mixing_reaches_the_shares(spark):
    r = random.Random(3)
    kinds = {"a": "alpha beta gamma", "b": "delta rho sigma", "c": "tau phi chi"}
    rows = [(i, " ".join(r.choice(kinds[k].split()) for _ in range(r.randrange(5, 60))), k) for i, k in enumerate(r.choices("abc", [8, 3, 1], k=400))]
    rows += [(None, None, "a"), (400, "", "a"), (400, "", "a"), (401, "alpha " * 20000, "a")]
    frame = spark.createDataFrame([(i, t, k, 1.0) for i, t, k in rows], "doc_id long, text string, kind string, rate double")
    labelled = frame.filter("doc_id % 2 = 0 and doc_id < 400").selectExpr("doc_id", "kind as domain")
    model = mixing.train_domains(frame, labelled, ["a", "b", "c"])
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(frame, model, shares).collect()
    assert len(got) == len(rows) and all(x["rate"] >= 0 and x["copies"] >= 0 for x in got)
    total = np.sum([x["rate"] * x["tokens"] * np.array(x["posterior"]) for x in got], axis=0)
    assert np.allclose(total / total.sum(), [0.5, 0.3, 0.2], atol=0.005)
    assert np.isclose(total.sum(), sum(x["tokens"] for x in got), rtol=0.01)
    anchored = mixing.mix(frame, model, shares, anchor="a").collect()
    mass = sum(x["tokens"] * x["posterior"][0] for x in anchored)
    assert np.isclose(sum(x["rate"] * x["tokens"] * x["posterior"][0] for x in anchored), mass, rtol=0.01)
    copied = mixing.apply_copies(mixing.mix(frame, model, shares), frame.columns)
    assert copied.columns == frame.columns and copied.count() > 0
    assert mixing.mix(frame.limit(0), model, shares).count() == 0


def test_rates_are_the_least_squares_optimum():
    """Projected gradient against a plain long descent on the same objective."""
    r = np.random.default_rng(1)
    p, t = r.dirichlet([0.3, 0.3, 0.3], 60), r.integers(1, 50, 60).astype(float)
    mass, target = t @ p, np.array([0.5, 0.3, 0.2]) * t.sum()
    x = np.ones(60)
    for _ in range(20000):
        x = np.maximum(0, x - 0.2 * p @ ((((x * t) @ p) - target) / mass))
    steps = []
    for _ in range(400):
        steps.append((((mixing.rates(p, steps) * t) @ p) - target) / mass)
    loss = lambda v: (((v * t) @ p - target) ** 2 / mass).sum()
    assert abs(loss(x) - loss(mixing.rates(p, steps))) < 1e-6 * t.sum()


# 3. SimHash


def test_fingerprints_and_next_documents(spark):
    texts = {5: "Alpha beta gamma delta", 1: None, 9: "", 12: "é" * 7 + " x", 3: "alpha Beta gamma delta", 20: " ".join(words(5000, 1))}
    frame = docs_of(spark, [(i, t, "s") for i, t in texts.items()]).repartition(3)
    got = {r["doc_id"]: r for r in simhash.fingerprint_with_next(frame).collect()}
    order = sorted(texts)
    for at, i in enumerate(order):
        text, other = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(text) // 2
        edited = text[:len(text) - k] + other[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        own, changed, after = (int(simhash.fingerprints([t])[0]) for t in (text, edited, other))
        assert (int(got[i]["fingerprint"], 16), int(got[i]["edited_fingerprint"], 16)) == (own, changed)
        assert got[i]["near_edited"] == 1 - (own ^ changed).bit_count() / 64 and got[i]["near_next"] == 1 - (own ^ after).bit_count() / 64
    assert got[3]["fingerprint"] == got[5]["fingerprint"]
    assert simhash.fingerprint_with_next(frame.limit(0)).count() == 0
    assert simhash.fingerprint_with_next(docs_of(spark, [(1, "a b", "s")])).first()["near_next"] == 1.0


@pytest.mark.parametrize("tile", [2048, 8])
def test_all_fingerprints_within_the_radius(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base[:20] for d in (0, 1, 2, 3, 3, 4, 5)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {x["fp"]: x["n_near"] for x in simhash.count_within(spark.createDataFrame([(s,) for s in signed] + [(None,)], "fp long")).collect()}
    assert got == {s: sum((p ^ q).bit_count() <= 3 for q in prints) - 1 for s, p in zip(signed, prints, strict=True)}


@pytest.mark.parametrize("tile", [2048, 8])
def test_links_name_every_near_fingerprint_once(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "LINKS", 5)
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = base + base[:9] + [b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base[:15] for d in (1, 1, 2, 3, 3, 4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame(list(enumerate(signed)) + [(-1, None)], "doc_id long, fp long")
    links = simhash.links_within(frame)
    got = [tuple(x) for x in links.collect()]
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    kinds = sorted(set(signed))
    assert sorted(got) == [(a, b, distance(a, b)) for i, a in enumerate(kinds) for b in kinds[i + 1:] if distance(a, b) <= 3]
    pairs = sorted(tuple(x) for x in simhash.near_documents(frame, links).collect())
    assert pairs == [(i, j, distance(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if a != b and distance(a, b) <= 3]
    assert {x["fp"]: x["n_equal"] for x in simhash.count_within(frame).collect()} == {a: signed.count(a) - 1 for a in kinds}
    assert simhash.links_within(frame.limit(0)).count() == 0


def test_buckets_never_go_through_the_driver(spark):
    prints = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links_within(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_link_query_accounts_for_the_counts(spark):
    source = "/root/testdata/sf0.001"
    counts = queries.op3_simhash(spark, source).collect()
    held, near = Counter(x["fingerprint"] for x in counts), Counter()
    for x in queries.simhash_links(spark, source).collect():
        assert x["fingerprint"] != x["near_fingerprint"] and (int(x["fingerprint"], 16) ^ int(x["near_fingerprint"], 16)).bit_count() == x["distance"] <= 3
        near[x["fingerprint"]] += held[x["near_fingerprint"]]
        near[x["near_fingerprint"]] += held[x["fingerprint"]]
    assert all(x["n_near"] == held[x["fingerprint"]] - 1 + near[x["fingerprint"]] for x in counts)


# 4. cross-polytope


def test_search_recall_scores_and_order(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 24)) + 3 * r.normal(size=(10, 24))[r.integers(0, 10, 1500)]
    x[:700] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0, None] + [0.0] * 22), (9005, [1.0]), (None, [1.0] * 24)]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    by = defaultdict(list)
    for g in got:
        by[g["query_id"]].append((g["rank"], g["vec_id"], g["score"]))
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score = x @ x[q]
        assert np.allclose([s for _, _, s in found], [score[v] for _, v, _ in found])
        exact = [np.add.reduce(x[v] * x[q]) for v in range(1500)]
        best = [v for v in sorted(range(1500), key=lambda v: (-exact[v], v)) if v != q][:20]
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(by)


def test_search_gives_all_candidates_of_a_small_table(spark):
    rows = [(i, [float(i == k) for k in range(5)]) for i in range(5)]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id = 0").collect()
    assert [(g["rank"], g["vec_id"], g["score"]) for g in sorted(got)] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0), (4, 4, 0.0)]
    assert cross_polytope.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id = 0").count() == 0


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 50))
    y = cross_polytope.rotate(x, 3)
    assert y.shape == (20, 64) and np.allclose(x @ x.T, y @ y.T)


# 5. licences


def best_dice(text, template):
    w = [v.lower() for v in re.findall("[A-Za-z0-9]+", text)]
    b = Counter(zip(*(lambda v: (v, v[1:]))([v.lower() for v in re.findall("[A-Za-z0-9]+", template)])))
    n, best = sum(b.values()), 0.0
    for i in range(len(w)):
        for j in range(i + 2, len(w) + 1):
            a = Counter(zip(w[i:j], w[i + 1:j]))
            best = max(best, 2 * sum((a & b).values()) / (sum(a.values()) + n))
    return best


def test_license_passages_match_every_run_of_words():
    templates = {"x": "permission is granted to use and copy this work", "y": "released under the mit license", "z": "word"}
    prepared, r = license_scan.prepare(templates, 0.8), random.Random(8)
    pool = "permission is granted to use and copy this work released under the mit license other words here".split()
    for k in range(150):
        text = " ".join(r.choice(pool) for _ in range(4)) + " " + " ".join(v for v in templates["xy"[k % 2]].split() if r.random() < 0.9) + ". " + " ".join(r.choice(pool) for _ in range(4))
        found = license_scan.find_licenses(text, prepared, 0.8)
        best = max(best_dice(text, templates[t]) for t in "xy")
        assert (max((f["dice"] for f in found), default=0) == pytest.approx(best)) if best >= 0.8 else not found
        assert all(best_dice(text[f["start"]:f["end"]], templates[f["license"]]) >= 0.8 for f in found)


def test_license_scan_rows(spark):
    full = license_scan.TEMPLATES["MIT"]
    frame = docs_of(spark, [(1, None, "s"), (2, "", "s"), (3, "prose\nReleased under the MIT License.\nmore", "s"), (3, "prose\nReleased under the MIT License.\nmore", "s"), (4, "x " * 9000 + full.upper(), "s"), (5, "license", "s")])
    got = [(r["doc_id"], [(x["license"], round(x["dice"], 3)) for x in r["licenses"]]) for r in license_scan.scan_licenses(frame).collect()]
    assert sorted(got) == [(1, []), (2, []), (3, [("MIT-notice", 1.0)]), (3, [("MIT-notice", 1.0)]), (4, [("MIT", 1.0)]), (5, [])]
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_usual_licenses_get_their_own_names():
    library = license_scan.prepare(license_scan.TEMPLATES, marks=license_scan.MARKS)
    name = lambda text: [(f["license"], f["start"], f["end"]) for f in license_scan.find_licenses(text, library)]
    notices = {
        "Licensed under the MIT License": "MIT", "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
        "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Licensed under the Mozilla Public License, v. 2.0": "MPL-2.0", "Released under CC0 1.0": "CC0-1.0", "Released under the Unlicense": "Unlicense",
        "Licensed under the BSD 3-Clause License": "BSD-3-Clause", "This work is licensed under the GNU General Public License, version 2": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "This work is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0"}
    for notice, expected in notices.items():
        assert name(f"ab {notice}. cd") == [(f"{expected}-notice", 3, 3 + len(notice))], notice
    assert name("This work is licensed under the GNU General Public License, version 4.") == []
    forms = [n for n in license_scan.TEMPLATES if not n.endswith("-notice")]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause", "Unlicense", "GPL-2.0-header", "LGPL-2.1-header", "AGPL-3.0-header"} <= set(forms)
    for form in forms:  # whole texts and headers, also with a changed word, which the notices within them do not have
        wording = license_scan.TEMPLATES[form]
        for text in [wording] if isinstance(wording, str) else wording:
            assert [n for n, _, _ in name("ab " + text + " cd")] == [form]
    assert [n for n, _, _ in name(license_scan.TEMPLATES["Apache-2.0"].replace("perpetual", "lasting"))] == ["Apache-2.0"]


def test_passages_keep_to_their_marks():
    """Every run of words that begins and ends with a bigram of the template, by its coefficient and marks, against the passage found."""
    template, marks = {"x": "under the gnu public license version 3 of the license"}, {"x": (["version 3", "v3"], ["lesser"])}
    library, r = license_scan.prepare(template, 0.7, marks), random.Random(5)
    pool, found_some = "under the gnu public license version 3 of the license lesser v3 other".split(), 0
    for _ in range(200):
        text = " ".join([r.choice(pool) for _ in range(3)] + [w for w in template["x"].split() if r.random() < 0.9] + [r.choice(pool) for _ in range(4)])
        w, best = text.split(), 0.0
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                run, own = " ".join(w[i:j]), set(zip(template["x"].split(), template["x"].split()[1:]))
                if tuple(w[i:i + 2]) in own and tuple(w[j - 2:j]) in own and ("version 3" in run or "v3" in run) and "lesser" not in run:
                    a, b = Counter(zip(w[i:j], w[i + 1:j])), Counter(zip(template["x"].split(), template["x"].split()[1:]))
                    best = max(best, 2 * (a & b).total() / (a.total() + b.total()))
        found = license_scan.find_licenses(text, library, 0.7)
        found_some += bool(found)
        assert max((f["dice"] for f in found), default=0) == pytest.approx(best if best >= 0.7 else 0), text
    assert 20 < found_some < 200


# 6. secrets

SECRET = "0123456789abcdef0123456789abcdef"


def brute_spans(text):
    found = []
    for order, (kind, pattern, least, group) in enumerate(secret_scan.KINDS):
        for m in re.finditer(pattern, text or "", re.A | (re.I if kind == "assign" else 0)):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secret_spans_match_the_plain_patterns():
    r = random.Random(4)
    bits = ["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "abcdef", "0123456789", "x", "é", "password", "ghp_", "eyJ", ".", "-", "\n", "A" * 40]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        assert [(f["kind"], f["start"], f["end"]) for f in secret_scan.find_secrets(text)] == brute_spans(text), text


def test_ownership_and_redaction(spark):
    own, shared = f"token = '{SECRET}'", "password: examplepassword1"
    rows = [(1, own, "o1"), (2, f"é {own} and {own}", "o1"), (3, shared, "o1"), (4, shared, "o2"), (5, shared + " " + own, "o3"), (6, None, "o4"), (7, "", None), (7, "", None), (8, shared, None)]
    frame = docs_of(spark, rows)
    got = sorted((r["doc_id"], len(r["found"]), r["n_live"], r["n_example"]) for r in secret_scan.scan_secrets(frame).collect())
    assert got == [(1, 2, 2, 0), (2, 4, 4, 0), (3, 1, 0, 1), (4, 1, 0, 1), (5, 3, 2, 1), (6, 0, 0, 0), (7, 0, 0, 0), (7, 0, 0, 0), (8, 1, 0, 1)]
    out = secret_scan.redact_live(frame)
    assert out.columns == frame.columns
    texts = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"])
    assert texts == [(1, "[secret]'"), (2, "é [secret]' and [secret]'"), (3, shared), (4, shared), (5, shared + " [secret]'"), (8, shared)]
    assert out.count() == len(rows) and secret_scan.redact_live(frame.limit(0)).count() == 0


# 7. token-id files


def test_ranks_round_trip():
    r = np.random.default_rng(5)
    for bits, most in ((1, 1 << 16), (2, 1 << 32)):
        for n in (0, 1, 7, 8, 9, 1000):
            ranks = (r.integers(0, most, n) >> r.integers(0, 24, n)).astype(np.uint32)
            control, data = id_files.encode_ranks(ranks, bits)
            assert np.array_equal(id_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n, bits), ranks)


def test_damaged_files_are_refused():
    raw = id_files.file_bytes(np.array([1]), np.array([False]), np.array([2]), np.array([0, 300], np.uint32), 0, 1)
    assert id_files.read_file(raw).ranks.tolist() == [0, 300]
    with pytest.raises(ValueError):
        id_files.read_file(raw[:-1] + bytes([raw[-1] ^ 1]))


def encoded(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


ODD_TEXTS = [None, "", " ", "  two  spaces ", "a\n\nb\n c", "É'S it's", "\x1cx\x1d y", "　wide　x", "the <|endoftext|> end", "Σς İ ı", "x" * 5000, "a " * 9000, "tab\tand\r\nline", "same", "same"]


def test_id_files_round_trip(spark, tmp_path):
    rows = [(i * 3 % 31, t, "s") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "s")]
    frame = docs_of(spark, rows).repartition(4)
    id_files.write_id_files(frame, queries.tokenizer("byte_bpe_50k.json"), str(tmp_path / "ids"), file_ids=50)
    got = id_files.read_id_files(spark, str(tmp_path / "ids")).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids, start = encoded("byte_bpe_50k.json", [t for _, t, _ in ordered], 0), 0
    expected = []
    for (doc, _, _), x in zip(ordered, ids, strict=True):
        expected.append((doc, start, len(x), zlib.crc32(x.tobytes()), x.tobytes()))
        start += len(x)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=lambda r: r[1]) == expected
    assert len(list((tmp_path / "ids").glob("ids-*.bin"))) > 1
    assert id_files.encode_corpus(frame.limit(0), queries.tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    with open(queries.tokenizer(name)) as f:
        tokenizer = PieceTokenizer(f.read())
    r = random.Random(9)
    bits = ["a", "The", " ", "  ", "\n", "\t", "é", "É", "ß", "Σ", "ς", "İ", "'s", "'LL", "1", "²", ".", "...", "!", "́", "漢字", "\xa0", "　", "\x85", "\x1c", "<|endoftext|>", "_", "|", "ſ", "K", "🙂", "\x00"]
    texts = [t or "" for t in ODD_TEXTS] + ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(4000)]
    offsets, ids = tokenizer.encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tobytes() == tokenizer.whole(text), text


# 8. URLs


def test_urls_and_aliases(spark):
    link = '<head><link href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://spam.example.net/de/1", ""), (2, "https://m.example.net/en/1", ""), (3, "https://a.org/x", link.format("http://spam.example.net/de/1")),
        (4, "https://b.org/y", '<META http-equiv="Refresh" content="0; url=https://A.org/x#top">'), (5, "https://c.org/fr/1", link.format("//a.org/x")),
        (6, "https://d.org/z", "<!-- " + link.format("https://a.org/x") + " -->"), (7, None, link.format("https://a.org/x")), (8, "no scheme", None), (9, "http://net", ""), (10, "http://net/", ""),
        (11, "https://e.org/p/q", link.format("/p/r")), (12, "https://e.org/p/r", ""), (3, "https://a.org/x", link.format("http://spam.example.net/de/1")), (13, "https://examplenet/x", "")]
    frame = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge_urls(frame, rules).collect())
    assert got == [
        (1, "spam.example.net", "/de/1", "net/", "block"), (2, "m.example.net", "/en/1", "example.net/en/", "allow"), (3, "a.org", "/x", "", "block"), (3, "a.org", "/x", "", "block"), (4, "b.org", "/y", "", "block"),
        (5, "c.org", "/fr/1", "org/fr/", "allow"), (6, "d.org", "/z", "", "allow"), (7, "", "", "", "allow"), (8, "", "", "", "allow"), (9, "net", "", "", "allow"), (10, "net", "/", "net/", "block"),
        (11, "e.org", "/p/q", "", "allow"), (12, "e.org", "/p/r", "", "allow"), (13, "examplenet", "/x", "", "allow")]
    hops = spark.createDataFrame([("https://e.org/p/r", "http://other.net/"), (None, "x")], "from_url string, to_url string")
    again = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(frame, rules, redirects=hops).collect()}
    assert (again[11], again[12], again[6]) == ("block", "block", "allow")
    assert url_filter.judge_urls(frame.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(frame.filter("page_id = 1"), rules.limit(0)).collect()} == {"allow"}


# 9. quality


def test_pair_term_is_the_sum_over_pairs():
    r = np.random.default_rng(4)
    model = factor_machine.Machine(0.3, r.normal(size=30), r.normal(size=(30, 4)))
    bins, values = r.choice(30, 9, replace=False), r.normal(size=9)
    plain = 0.3 + sum(model.weight[b] * v for b, v in zip(bins, values)) + sum(model.factor[bins[i]] @ model.factor[bins[j]] * values[i] * values[j] for i in range(9) for j in range(i))
    assert model.sums(np.zeros(9, int), bins, values, 1)[0][0] == pytest.approx(plain)


def test_quality_on_held_out_rows(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice("the of and to land river stone quiet morning walked".split()) for _ in range(r.randrange(30, 200))) + "."
    bad = lambda: " ".join(r.choice(["buy", "$$$", "now!!", "win", "%%%"]) for _ in range(r.randrange(5, 200)))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(600)] + [(600, None, "s"), (601, "", "s"), (601, "", "s"), (602, "a " * 50000, "s")]
    frame = docs_of(spark, rows).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 2)] + [(1, None), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    model = factor_machine.train(frame, labels)
    out = factor_machine.score_documents(frame, model).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 for x in out)
    held = [x for x in out if x["doc_id"] < 600 and x["doc_id"] % 2]
    assert np.mean([(x["score"] >= 0.5) == (x["doc_id"] % 3 > 0) for x in held]) > 0.97
    assert factor_machine.score_documents(frame.limit(0), model).count() == 0
    alone = factor_machine.train(frame, labels.limit(0))
    assert {x["score"] for x in factor_machine.score_documents(frame.limit(3), alone).collect()} == {0.5}


# 10. packing


def check_packing(got, ids_of, window=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        whole = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(whole[r["start"]:r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in (*pieces.values(), *sequences.values()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: len(x) for d, x in ids_of.items()}
    fills = [sum(n for _, n in s) for s in sequences.values()]
    assert max(fills) <= window
    return fills


def test_packing_covers_every_id_once(spark):
    r = random.Random(6)
    texts = [*ODD_TEXTS, *(" ".join(words(r.choice([3, 40, 300, 900, 3000]), i)) for i in range(150))]
    frame = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(5)
    got = packing.pack_documents(frame, queries.tokenizer("word_bpe_49k.json"), open_windows=4)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    ids = dict(enumerate(encoded("word_bpe_49k.json", texts, 2)))
    rows = got.collect()
    fills = check_packing(rows, ids)
    assert sum(4096 - f for f in fills) < 0.1 * sum(fills)
    assert all(bytes(x["ids"]) == ids[x["doc_id"]][x["start"]:x["start"] + x["length"]].tobytes() for x in rows)
    assert packing.pack_documents(frame.limit(0), queries.tokenizer("word_bpe_49k.json")).count() == 0
    twice = packing.pack_documents(docs_of(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "a b", "s")]), queries.tokenizer("word_bpe_49k.json"), with_ids=False).collect()
    assert sorted((x["doc_id"] or 0, x["length"], x["offset"]) for x in twice)[0][:2] == (0, 3) and sorted(x["offset"] for x in twice) == [0, 3, 6]


def test_open_windows_place_best_fit_and_stay_bounded():
    windows = packing.OpenWindows(0, window=10, most=2)
    assert [windows.put(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    windows = packing.OpenWindows(0, window=10, most=2)
    assert [windows.put(n) for n in (6, 7, 8, 2)] == [(0, 0), (1, 0), (2, 0), (2, 8)]
    assert len(windows.room) == 1 and [x for x, _ in packing.merge_windows([5, 5, 4, 6], 10)] == [1, 1, 0, 0]


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, source).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert after.columns == docs.columns
        if name == "quality_classifier":
            bad = after.join(spark.read.parquet(f"{source}/labels.parquet"), "doc_id").filter("quality = 0").count()
            assert 0 < after.count() < before.count() and bad <= 2
        if name == "ngram_jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            expected = brute_components(rows)
            assert {r["doc_id"] for r in after.collect()} == {d for d in expected if expected[d] == d}
        if name == "secret_scans":
            assert after.count() == before.count()
            assert not [r for r in after.collect() if any(f["kind"] == "assign" for f in secret_scan.find_secrets(r["text"])) and "[secret]" not in r["text"]]
        if name == "packing":
            texts = defaultdict(list)
            for r in before.collect():
                texts[r["doc_id"]].append(r["text"])
            total = sum(len(x) for t in texts.values() for x in encoded("word_bpe_49k.json", t, 2))
            assert after.selectExpr("sum(length)").first()[0] == total
        before = after


def test_mixture_keeps_clean_documents_and_drops_toxic_ones(spark):
    import corpus_pipeline

    source = "/root/testdata/sf0.01"
    labels = queries.domains_of(queries.table(spark, source, "labels"))
    good = queries.table(spark, source, "documents").join(labels.filter("domain in ('clean', 'toxic')").select("doc_id"), "doc_id", "left_semi")
    left = {r["doc_id"] for r in corpus_pipeline.mixture(spark, good, source).select("doc_id").collect()}
    by = defaultdict(set)
    for r in labels.collect():
        by[r["domain"]].add(r["doc_id"])
    here = {r["doc_id"] for r in good.select("doc_id").collect()}
    clean, toxic = by["clean"] & here, by["toxic"] & here
    print(f"clean {len(clean & left)} of {len(clean)}, toxic {len(toxic & left)} of {len(toxic)}")
    assert len(toxic) > 5 and len(clean - left) <= 0.01 * len(clean) and len(toxic & left) <= 0.3 * len(toxic)
    model = mixing.train_domains(queries.table(spark, source, "documents"), labels, list(corpus_pipeline.SHARES))
    likeliest = {r["doc_id"]: int(np.argmax(r["posterior"])) for r in mixing.posteriors(good, model).select("doc_id", "posterior").collect()}
    assert left == {d for d, k in likeliest.items() if model.domains[k] == "clean"}


def test_entry_points_hold_one_query_for_each_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
