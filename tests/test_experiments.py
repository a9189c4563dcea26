"""Experiment log: fold, reruns, lineage with cycles, chain of hashes, record rules, search."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapeledger.functions.digest import hash_bytes, hash_text
from tapeledger.operators import experiments as X
from tapeledger.operators import lineage as G
from tapeledger.operators.ordered import with_previous
from tapeledger.session import RELEASE_SHUFFLES, cut_lineage


def tree(spark, links):
    return spark.createDataFrame(list(links.items()), "experiment_id string, parent_experiment_id string")


def test_lineage_of_a_long_chain(spark):
    n = 70
    r = tree(spark, {f"e{i:03d}": (f"e{i - 1:03d}" if i else None) for i in range(n)})
    got = {x.experiment_id: (x.root_id, x.depth, x.in_cycle) for x in G.lineage(r).collect()}
    assert all(got[f"e{i:03d}"] == ("e000", i, False) for i in range(n))
    one = spark.createDataFrame([("e066",)], "experiment_id string")
    assert rows(G.lineage_of(r, one).select("distance", "experiment_id"), "distance") == [(i, f"e{66 - i:03d}") for i in range(67)]
    assert sorted(x.experiment_id for x in G.descendants_of(r, one).collect()) == ["e067", "e068", "e069"]


def test_counts_in_a_tree(spark):
    r = tree(spark, {"a": None, "b": "a", "c": "a", "d": "b", "e": "d", "x": None, "y": "gone"})
    got = {x.experiment_id: (x.n_children, x.n_descendants) for x in G.descendant_counts(r).collect()}
    assert got == {"a": (2, 4), "b": (1, 2), "c": (0, 0), "d": (1, 1), "e": (0, 0), "x": (0, 0), "y": (0, 0)}


def test_cycles_are_marked_and_left_out(spark):
    r = tree(spark, {"a": "c", "b": "a", "c": "b", "d": "c", "ok": None, "kid": "ok"})
    got = {x.experiment_id: x.in_cycle for x in G.lineage(r).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": True, "ok": False, "kid": False}
    asked = spark.createDataFrame([("a",), ("kid",)], "experiment_id string")
    assert rows(G.lineage_of(r, asked), "origin_id", "distance") == [("a", "a", 0), ("kid", "kid", 0), ("kid", "ok", 1)]
    assert {x.experiment_id: x.n_descendants for x in G.descendant_counts(r).collect()} == {"a": 0, "b": 0, "c": 0, "d": 0, "ok": 1, "kid": 0}


def base(spark, items):
    schema = ("experiment_id string, status string, status_reason string, created_at timestamp_ntz, exact_hash string, logged_at timestamp_ntz, n_periods bigint, rebalance_count bigint, ruined boolean, "
              "metrics map<string,double>, warnings array<string>, result_warnings array<string>, tags array<string>, backtest_config map<string,string>, datasets array<struct<dataset_id:string,symbols:array<string>>>")
    full = [(i, s, None, dt.datetime(2024, 1, 1), x, dt.datetime(2024, 1, 1, k), 10, 2, False, m, ["PROXY_DATA"], ["RUINED"], ["t"], cfg, [("d1", ["BTC"])]) for k, (i, s, x, m, cfg) in enumerate(items)]
    return spark.createDataFrame(full, schema)


def changes(spark, *items):
    return spark.createDataFrame([(i, s, "status_change", t, "why") for i, s, t in items], "experiment_id string, seq bigint, event string, to_status string, reason string")


def test_fold_keeps_the_last_status_and_remembers_bad_ones(spark):
    r = base(spark, [("a", "COMPLETED", "h", {}, {}), ("b", "FAILED", "h", {}, {})])
    f = {x.experiment_id: x for x in X.fold_status(r, changes(spark, ("a", 2, "COMPLETED"), ("a", 1, "INVALID"))).collect()}
    assert (f["a"].folded_status, f["a"].ever_invalid, f["a"].n_status_changes, f["a"].folded_reason) == ("COMPLETED", True, 2, "why")
    assert f["b"].ever_failed and not f["b"].ever_completed
    t = X.experiment_table(X.fold_status(r, changes(spark, ("a", 1, "INVALID"))).withColumns({c: F.lit("x") for c in ("experiment_type", "strategy_name", "recorded_via")}))
    assert {x.experiment_id: x.n_warnings for x in t.collect()} == {"a": 3, "b": 3}


def test_reproducibility(spark):
    nan = float("nan")
    r = base(spark, [("a0", "COMPLETED", "a", {"sharpe": 1.0, "calmar": nan}, {}), ("a1", "COMPLETED", "a", {"calmar": nan, "sharpe": 1.0}, {}), ("a2", "COMPLETED", "a", {"sharpe": 1.5}, {}), ("a3", "FAILED", "a", None, {}), ("b0", "COMPLETED", "b", {}, {})])
    d = X.reproducibility(X.run_numbers(X.fold_status(r, changes(spark, ("b0", 1, "COMPLETED")))))
    got = {x.experiment_id: (x.run_seq, x.rerun_of, x.reproducibility_status, x.divergence) for x in d.collect()}
    assert got == {"a0": (0, None, "UNIQUE", None), "a1": (1, "a0", "REPRODUCED", None), "a2": (2, "a0", "DIVERGED", ["metrics.calmar", "metrics.sharpe"]), "a3": (3, "a0", "NOT_COMPARABLE", None), "b0": (0, None, "UNIQUE", None)}


def test_search(spark):
    r = X.fold_status(base(spark, [("a", "COMPLETED", "h", {}, {"funding_mode": "disabled"}), ("b", "COMPLETED", "h", {}, {"funding_mode": "required"}), ("c", "FAILED", "h", {}, {})]), changes(spark, ("b", 1, "INVALID")))
    ids = lambda **f: sorted(x.experiment_id for x in X.find_experiments(r, **f).collect())
    assert ids(funding_disabled=False) == ["b"] and ids(funding_disabled=True) == ["a"]  # no setting: no match
    assert ids(status=["COMPLETED", "INVALID"]) == ["a", "b"] and ids(ever_status="COMPLETED") == ["a", "b"]
    assert ids(symbol="BTC") == ["a", "b", "c"] and ids(symbol="BT") == []  # whole names only
    assert ids(warning_token="WAS_INV") == ["b"] and ids() == ["a", "b", "c"]
    with pytest.raises(ValueError, match="unknown filter"):
        X.find_experiments(r, colour="red")


def log(spark, lines):
    out, prev = [], None
    for i, text in enumerate(lines, 1):
        out.append((i, text, prev))
        prev = hashlib.sha256(text.encode()).hexdigest()
    return out, "seq bigint, line string, prev_line_sha256 string"


@pytest.mark.parametrize("block", [2, 1000])
def test_chain_of_hashes(spark, block):
    good, schema = log(spark, [f"line {i}" for i in range(9)])
    find = lambda items: rows(X.chain_breaks(spark.createDataFrame(items, schema), block).select("code", "seq"), "code", "seq")
    assert find(good) == []
    forged = [(s, "forged" if s == 4 else t, p) for s, t, p in good]
    assert find(forged) == [("HISTORY_CHAIN_BROKEN", 5)]
    assert find([x for x in good if x[0] != 4]) == [("BAD_SEQ", 5), ("HISTORY_CHAIN_BROKEN", 5)]


def test_hashes_travel_as_bytes_and_texts_that_are_none_are_breaks(spark):
    good, schema = log(spark, [f"line {i}" for i in range(5)])
    odd = {2: str.upper, 3: lambda p: "no hash", 4: lambda p: p + "\n", 5: lambda p: ""}
    found = X.chain_breaks(spark.createDataFrame([(s, t, odd.get(s, lambda p: p)(p)) for s, t, p in good], schema), 1000)
    assert rows(found.select("code", "seq"), "seq") == [("HISTORY_CHAIN_BROKEN", i) for i in (2, 3, 4, 5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(sha2(" in plan and "unhex(prev_line_sha256" in plan


@pytest.mark.parametrize("width", [1, 2, 4, 1000])
def test_chain_in_blocks_that_the_lines_are_shuffled_by(spark, width):
    """Numbers, stored hashes and the check by one column of blocks: lost, forged and first lines at the edges of blocks."""
    log_ = spark.range(1, 25).select(F.col("id").alias("seq"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    lines = with_previous(log_, [], ["seq"], F.floor(F.col("seq") / width), {"_p": "line"}, placed="block")
    lines = lines.where("seq not in (1, 8, 9, 10, 20)").select("seq", "block", F.when(F.col("seq") % 6 == 0, "forged").otherwise(F.col("line")).alias("line"), F.sha2("_p", 256).alias("prev_line_sha256"))
    found = X.chain_breaks(lines, placed="block")
    assert rows(found.select("code", "seq"), "code", "seq") == [("BAD_SEQ", i) for i in (2, 11, 21)] + [("HISTORY_CHAIN_BROKEN", i) for i in (2, 7, 11, 13, 19, 21)]
    plain = rows(X.chain_breaks(lines.drop("block"), width).select("code", "seq"), "code", "seq")
    assert rows(found.select("code", "seq"), "code", "seq") == plain


def test_hashes_as_bytes_are_told_apart_from_other_texts(spark):
    h = hashlib.sha256(b"x").hexdigest()
    texts = [h, h.upper(), h[:63], h + "\n", "", "x", " " * 33, "é", h[:31], None, hashlib.sha256(b"y").hexdigest()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", hash_bytes("t").alias("b"))
    assert [x.u for x in df.select("i", hash_text("b").alias("u")).orderBy("i").collect()] == texts
    assert df.where("t is not null").select("b").distinct().count() == len(texts) - 1 and df.where("octet_length(b) = 32").count() == 2


def test_endless_chains_are_those_that_lineage_marks(spark):
    import random

    draw = random.Random(5)
    ids = [f"e{i}" for i in range(200)]
    r = tree(spark, {x: draw.choice([None, "gone", x] if draw.random() < 0.1 else ids) for x in ids})
    marked = {x.experiment_id for x in G.lineage(r).where("in_cycle").collect()}
    assert marked and {x.experiment_id for x in G.endless(r).where("in_cycle").collect()} == marked
    assert {x.experiment_id for x in G.endless(r.unionByName(r)).collect()} == marked  # rows that come twice
    assert G.endless(tree(spark, {"a": None, "b": "a", "c": "gone"})).count() == 0


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    counted = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.max("id").alias("m"))
    stored = cut_lineage(counted, "released", release=True)
    assert not shuffled() - before and stored.count() == counted.count() == 1000
    assert spark.conf.get(RELEASE_SHUFFLES) == "false"


def test_the_report_joins_nothing_when_it_is_read(spark):
    """Each part is stored by its own job, so the files of one part's shuffles are on disk at a time; only findings are left."""
    from tapeledger.plans.catalogue import QUERIES

    report = QUERIES["integrity_report"](spark, "/root/testdata/sf0.001")
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Aggregate") == 1


def test_integrity_findings(spark):
    r = spark.createDataFrame([("a", "s1", "p" * 16 + "1", 0, None, "ok"), ("b", "s1", "p" * 16 + "2", 0, "zz", "ok"), ("c", "s0", "q", 0, None, "ok"), ("d", "s1", "r", 0, None, "ok"), ("e", "s1", "r", 2, None, "ok")],
                              "experiment_id string, schema_version string, exact_hash string, run_seq int, parent_experiment_id string, record_sha256 string")
    c = spark.createDataFrame([("a", "ok", 1), ("b", "other", 2), ("d", "ok", 3), ("gone", "x", 4)], "experiment_id string, record_sha256 string, seq int")
    assert rows(X.registry_findings(r, c, "s1"), "code", "subject") == [
        ("DANGLING_PARENT", "b"), ("MISSING_RECORD", "gone"), ("ORPHAN_RECORD", "e"), ("PREFIX_COLLISION", "p" * 16), ("RECORD_MODIFIED", "b"), ("RUN_SEQ_GAP", "r"), ("SCHEMA_VERSION_UNKNOWN", "c")]


def test_overlap_counts_against_all_pairs(spark):
    """Counts without pairs, against the pairs themselves: a crowded search space, forests, several and missing windows."""
    import random

    rnd, day = random.Random(5), dt.timedelta(days=1)
    items = []
    for i in range(160):
        s = dt.datetime(2020, 1, 1) + rnd.randint(0, 300) * day
        parent = None if i % 40 == 0 else f"e{i - 1:03d}" if i < 80 else f"e{rnd.randrange(i):03d}"
        windows = [(s, s + rnd.randint(0, 40) * day)] + ([(s + 100 * day, s + 110 * day)] if i % 5 == 0 else [])
        items.append((f"e{i:03d}", parent if i != 90 else "unknown", "st", "hot" if i % 3 else None, "out_of_sample" if i % 2 else "in_sample", dt.datetime(2021, 1, 1) + rnd.randint(0, 30) * day, windows if i % 11 else [(None, None)]))
    items += [("c1", "c2", "st", "hot", "out_of_sample", dt.datetime(2021, 1, 1), [(dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1))]), ("c2", "c1", "st", "hot", "out_of_sample", dt.datetime(2021, 1, 1), [(dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1))])]
    r = spark.createDataFrame(items, "experiment_id string, parent_experiment_id string, strategy_name string, search_space_id string, research_stage string, logged_at timestamp_ntz, datasets array<struct<eval_start:timestamp_ntz,eval_end:timestamp_ntz>>")
    got = {x.experiment_id: (x.n_ancestors, x.first_ancestor, x.n_space_windows) for x in X.oos_overlaps(r).collect()}
    by = {x[0]: x for x in items}
    for eid, parent, _, space, stage, logged, ws in items:
        if stage != "out_of_sample" or not parent:
            continue
        ws = [w for w in ws if w[0]]
        meets = lambda o: [1 for a in ws for b in o[6] if b[0] and a[0] <= b[1] and b[0] <= a[1]]  # noqa: B023, E731
        line, at = [], parent
        while at in by and at not in ("c1", "c2"):  # records of a cycle have no ancestors
            line.append(at)
            at = by[at][1]
        hits = [x for x in line if meets(by[x])]
        near = sum(len(meets(o)) for o in items if space and o[3] == space and (o[5], o[0]) < (logged, eid))
        assert got[eid] == (len(hits), min(hits, default=None), near), eid


def test_overlaps_of_a_very_long_chain(spark):
    """A hundred thousand records, each the child of the one before, all on nearly the same window."""
    n = 100_000
    at = lambda d: F.timestamp_seconds(F.lit(1_500_000_000) + d).cast("timestamp_ntz")
    r = spark.range(n).select(
        F.format_string("e%06d", "id").alias("experiment_id"), F.when(F.col("id") > 0, F.format_string("e%06d", F.col("id") - 1)).alias("parent_experiment_id"), F.lit("st").alias("strategy_name"), F.lit(None).cast("string").alias("search_space_id"),
        F.when(F.col("id") % 1000 == 999, "out_of_sample").otherwise("in_sample").alias("research_stage"), at(F.col("id")).alias("logged_at"),
        F.array(F.struct(at(F.when(F.col("id") % 5000 == 7, 9_000_000).otherwise(F.col("id") % 50)).alias("eval_start"), at(F.when(F.col("id") % 5000 == 7, 9_000_001).otherwise(100_000)).alias("eval_end"))).alias("datasets"))
    got = {x.experiment_id: x.n_ancestors for x in X.oos_overlaps(r).collect()}
    assert len(got) == 100 and all(m == (i := int(e[1:])) - len([x for x in range(7, i, 5000)]) for e, m in got.items())


def test_counts_before(spark):
    import random

    from tapeledger.operators.ordered import counts_before

    rnd = random.Random(3)
    points = [(k, i, rnd.randrange(20)) for k in "ab" for i in range(37)]
    queries = [(rnd.choice("ab"), rnd.randrange(12), rnd.randrange(38), rnd.randrange(22)) for _ in range(60)]
    got = {r.q: r.n for r in counts_before(spark.createDataFrame(points, "k string, position bigint, value bigint"), spark.createDataFrame(queries, "k string, q bigint, upto bigint, value bigint"), ["k"], "q").collect()}
    for q in {x[1] for x in queries}:
        assert got.get(q, 0) == sum(1 for k, i, u, v in queries if i == q for p in points if p[0] == k and p[1] < u and p[2] < v)


def test_custom_results_and_listing(spark):
    schema = "experiment_id string, exact_hash string, run_seq int, folded_status string, n_periods int, rebalance_count int, ruined boolean, result_warnings array<string>, metrics map<string,double>, custom map<string,int>"
    same = ("COMPLETED", 5, 1, False, ["A", "B"], {"s": 1.0})
    r = spark.createDataFrame([("a", "h", 0, *same, {"x": 1, "y": 2}), ("b", "h", 1, *same, {"y": 2, "x": 1}), ("c", "h", 2, *same, {"x": 3, "z": 1}), ("d", "h", 3, *same, None), ("e", "g", 0, *same, None), ("f", "g", 1, *same, None)], schema)
    got = {x.experiment_id: (x.reproducibility_status, x.divergence) for x in X.reproducibility(r).collect()}
    assert got == {"a": ("UNIQUE", None), "b": ("REPRODUCED", None), "c": ("DIVERGED", ["custom.x", "custom.y", "custom.z"]), "d": ("DIVERGED", ["custom.x", "custom.y"]), "e": ("UNIQUE", None), "f": ("REPRODUCED", None)}


def test_rules_of_code_and_artifacts(spark):
    code = "struct<git_commit:string,code_fingerprint:string,code_fingerprint_n_files:int,contract_versions:map<string,string>>"
    four = {"registry_schema": "s1", "data_contract": "1", "backtest_contract": "1", "data_processing_version": "1"}
    rows_ = [("ok", "s1", (None, "f" * 64, 1, four)), ("ok2", "s1", ("a" * 40, "f" * 64, 1, four)), ("commit", "s1", ("A" * 40, "f" * 64, 1, four)), ("print", "s1", (None, None, None, four)), ("keys", "s1", (None, "f" * 64, 1, {"registry_schema": "s1"})), ("schema", "s2", (None, "f" * 64, 1, four)), ("none", "s1", (None, "f" * 64, 1, None))]
    got = sorted((x.experiment_id, x.code) for x in X.code_findings(spark.createDataFrame(rows_, f"experiment_id string, schema_version string, code {code}")).collect())
    assert got == [("commit", "BAD_GIT_COMMIT"), ("keys", "CONTRACTS_REQUIRED"), ("none", "CONTRACTS_REQUIRED"), ("print", "EMPTY_FINGERPRINT"), ("print", "FINGERPRINT_REQUIRED"), ("schema", "SCHEMA_CONTRACT_MISMATCH")]
    files = [("e", "a", "log", "x/y"), ("e", "", "log", "x"), ("e", "b", "picture", "/x"), ("e", "c", None, "C:x"), ("e", "d", "log", "x\\y"), ("e", "f", "log", None)]
    got = sorted((x.name, x.code) for x in X.artifact_findings(spark.createDataFrame(files, "experiment_id string, name string, kind string, path string")).collect())
    assert got == [("", "NAME_REQUIRED"), ("b", "ABSOLUTE_PATH"), ("b", "BAD_KIND"), ("c", "ABSOLUTE_PATH"), ("c", "BAD_KIND"), ("d", "BACKSLASH_IN_PATH"), ("f", "PATH_REQUIRED")]


def test_digest_trees(spark):
    from tapeledger.functions.digest import digest_diff, digest_tree

    base = [(s, d, i, float(i)) for s in "ab" for d in (1, 2, 3) for i in range(4)]
    frame = lambda data: spark.createDataFrame(data, "s string, d int, i int, x double")
    tree = lambda data: digest_tree(frame(data).repartition(3), ["i", "x"], ["s", "d"])
    find = lambda a, b: sorted(tuple(r) for r in digest_diff(tree(a), tree(b), ["s", "d"]).collect())
    assert tree(base)[0].first()["n_rows"] == 24 and find(base, list(reversed(base))) == []
    other = [(s, d, i, x + 1 if (s, d, i) == ("b", 2, 3) else x) for s, d, i, x in base if (s, d) != ("a", 3)] + [("c", 1, 0, 0.0)]
    assert find(base, other) == [("a", 3, "removed"), ("b", 2, "changed"), ("c", 1, "added")]
    moved = [(s, {1: 2, 2: 1}.get(d, d) if s == "a" else d, i, x) for s, d, i, x in base]
    assert find(base, moved) == []  # equal content under exchanged days


def test_verdicts_need_no_join_with_the_first_run(spark):
    r = spark.createDataFrame(
        [("a", "h", dt.datetime(2024, 1, 1), "COMPLETED", 1, 1, False, ["x", "y"], {"s": 1.0}), ("b", "h", dt.datetime(2024, 1, 2), "COMPLETED", 1, 1, False, ["y", "x"], {"s": 2.0})],
        "experiment_id string, exact_hash string, logged_at timestamp_ntz, folded_status string, n_periods int, rebalance_count int, ruined boolean, result_warnings array<string>, metrics map<string,double>")
    got = X.reproducibility(X.run_numbers(r, first_run=X.result_columns(r)))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in got.orderBy("run_seq").select("reproducibility_status", "divergence").collect()] == [("UNIQUE", None), ("DIVERGED", ["metrics.s"])]
