"""The divergence audit against plain counting, for every way of cutting the cube."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from tapeledger.llm import divergence, queries
from tools.compare import connect, difference

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least_docs=3, most_terms=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        own = [s for x, s in groups if x == lang]
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in own}
        q = shares(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [("pair", o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, most_terms)):
                for rank, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.append((lang, s, kind, item, value, rank))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    names = ["Word", "été", "ÉTÉ", "naïve", "straße", "x", "don't", "a1b2", "漢字", *(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))]
    rows = [(" ".join(r.choice(names) for _ in range(r.randrange(30))), r.choice(["en", "en", "de"]), f"s{r.choice([0, 0, 0, 0, 1, 2, 3, 4, 5, 6])}") for _ in range(150)]
    rows += [(None, "en", "silent"), ("", None, None), ("42 !!", None, "x"), ("only once", "la", "lone"), ("the " * 5000, "en", "s0"), ("same text", "en", "s1"), ("same text", "en", "s1")]
    rows += [(f"apart alone near{'abcdefghij'[i]}", "fr", f"f{i}") for i in range(5)]
    return rows


@pytest.mark.parametrize("group_block,term_block", [(32, 8192), (2, 8192), (32, 7), (1, 3), (3, 10)])
def test_divergences_match_plain_counting(spark, group_block, term_block):
    rows = corpus(group_block)
    frame = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = divergence.divergences(frame, group_block=group_block, term_block=term_block, most_terms=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, most_terms=5)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    assert divergence.divergences(lone).count() == 0


def test_shares_of_large_counts(spark):
    n, total = 9_000_000_000_000, 9_000_000_000_123
    got = spark.createDataFrame([(n, total)], "n long, total long").select(divergence.share("n", "total").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // total


def test_terms_of_slices():
    texts = pa.array(["skip this", "The CAT-sat é\x80x", "", "ÀB_c9D"], pa.large_string())
    expected = [["the", "cat", "sat", "é\x80x"], [], ["Àb", "c", "d"]]
    assert [[w for w in x if w] for x in divergence.term_lists(texts.slice(1)).to_pylist()] == expected


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    mine = queries.QUERIES["op11_source_divergence"](spark, sf).toPandas()
    assert difference(mine, connect(sf).execute(queries.ORACLES["op11_source_divergence"]).fetch_df()) is None
