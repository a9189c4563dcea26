"""Queries on the log of experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.operators import experiments as X
from tapeledger.operators import lineage
from tapeledger.plans import views as V
from tapeledger.plans.registry import query
from tapeledger.session import cut_lineage


def folded(spark, sf):
    return X.fold_status(V.records(spark, sf), V.changes(spark, sf))


def reruns(folded, *more):
    """Folded records with the number and the first of their repeats, cut down to what verdicts need and ``more``. They are
    stored narrow, once, and shuffled by their hash, as its bytes: ``exact_hash`` is binary here."""
    results = X.result_columns(folded)
    stored = cut_lineage(folded.select("experiment_id", F.unhex("exact_hash").alias("exact_hash"), "logged_at", *results, *more), "numbered", release=True)
    return X.run_numbers(stored, first_run=results)


@query("status_fold", "SELECT experiment_id, status, folded_status, folded_reason, n_status_changes, ever_completed, ever_failed, ever_rejected, ever_invalid FROM folded", ("folded",))
def status_fold(spark, sf):
    return folded(spark, sf).select("experiment_id", "status", "folded_status", "folded_reason", "n_status_changes", "ever_completed", "ever_failed", "ever_rejected", "ever_invalid")


@query("status_history", """SELECT experiment_id, 0 AS seq, created_at AS "at", status AS to_status FROM records UNION ALL SELECT experiment_id, seq, "at", to_status FROM history""", ("records", "history"))
def status_history(spark, sf):
    return X.status_history(V.records(spark, sf), V.history(spark, sf)).select("experiment_id", "seq", "at", "to_status")


@query("run_seq", """SELECT experiment_id, row_number() OVER w - 1 AS run_seq, CASE WHEN row_number() OVER w > 1 THEN first(experiment_id) OVER w END AS rerun_of FROM records
  WINDOW w AS (PARTITION BY exact_hash ORDER BY logged_at, experiment_id)""", ("records",))
def run_seq(spark, sf):
    return X.run_numbers(V.records(spark, sf)).select("experiment_id", "run_seq", "rerun_of")


def _groups_sql(h):
    return f"SELECT {h}, experiment_id, n_members, first_id FROM (SELECT *, count(*) OVER (PARTITION BY {h}) AS n_members, min(experiment_id) OVER (PARTITION BY {h}) AS first_id FROM records) WHERE n_members >= 2"


@query("exact_rerun_groups", _groups_sql("exact_hash").replace("n_members >= 2", "n_members >= 1"), ("records",))
def exact_rerun_groups(spark, sf):
    return X.hash_groups(V.records(spark, sf), "exact_hash", 1)


@query("semantic_duplicates", _groups_sql("semantic_hash"), ("records",))
def semantic_duplicates(spark, sf):
    return X.hash_groups(V.records(spark, sf), "semantic_hash")


@query("near_duplicates", _groups_sql("config_family_hash"), ("records",))
def near_duplicates(spark, sf):
    return X.hash_groups(V.records(spark, sf), "config_family_hash")


@query("sibling_count", "SELECT experiment_id, search_space_id, CASE WHEN search_space_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY search_space_id) - 1 END AS n_siblings FROM records", ("records",))
def sibling_count(spark, sf):
    return X.sibling_counts(V.records(spark, sf))


@query("search_space_summary", """SELECT search_space_id, count(*) AS n_records, coalesce(sum(n_configs_evaluated), 0)::BIGINT AS n_configs_total, count(*) FILTER (WHERE n_configs_evaluated IS NULL) AS n_unknown,
  count(*) FILTER (WHERE n_configs_evaluated IS NULL) > 0 AS is_lower_bound, string_agg(DISTINCT folded_status, ',' ORDER BY folded_status) AS statuses, max(sharpe) FILTER (WHERE folded_status = 'COMPLETED') AS best_sharpe,
  min(sharpe) FILTER (WHERE folded_status = 'COMPLETED') AS worst_sharpe FROM folded WHERE search_space_id IS NOT NULL GROUP BY search_space_id""", ("folded",))
def search_space_summary(spark, sf):
    return X.search_space_summary(folded(spark, sf))


@query("failed_or_rejected", "SELECT experiment_id, folded_status FROM folded WHERE folded_status IN ('FAILED', 'REJECTED', 'INVALID')", ("folded",))
def failed_or_rejected(spark, sf):
    return X.with_status(folded(spark, sf)).select("experiment_id", "folded_status")


@query("find_experiments", """SELECT experiment_id, folded_status, strategy_name FROM folded WHERE folded_status IN ('COMPLETED', 'INVALID') AND research_stage = 'out_of_sample' AND native_or_proxy = 'proxy'
  AND coalesce(funding_mode = 'required', false) AND ever_failed AND survivorship_safe IS NULL AND dataset_symbol IN ('S1', 'S3', 'S5')""", ("folded",))
def find_experiments(spark, sf):
    """Seven filters at once, on the record, its datasets, its settings and its folded history."""
    found = X.find_experiments(
        folded(spark, sf), status=["COMPLETED", "INVALID"], research_stage="out_of_sample", native_or_proxy="proxy", funding_disabled=False, ever_status="FAILED", survivorship_safe="unknown", symbol=["S1", "S3", "S5"])
    return found.select("experiment_id", "folded_status", "strategy_name")


@query("find_by_warning", "SELECT experiment_id, folded_status FROM folded WHERE (ever_failed OR ever_invalid OR ever_rejected OR ruined) AND n_configs_evaluated IS NULL AND created_at >= TIMESTAMP '1996-01-01' AND tag IN ('tag1', 'tag2', 'tag3')", ("folded",))
def find_by_warning(spark, sf):
    import datetime as dt

    found = X.find_experiments(folded(spark, sf), warning_token=["WAS_", "RUINED"], n_configs_unknown=True, created_after=dt.datetime(1996, 1, 1), tag=["tag1", "tag2", "tag3"])
    return found.select("experiment_id", "folded_status")


@query("find_by_annotation_tag", "SELECT experiment_id FROM records WHERE key % 7 = 0", ("records",))
def find_by_annotation_tag(spark, sf):
    """A tag that was not given at creation but added by an annotation."""
    r = V.records(spark, sf)
    notes = r.where("bigint(substring(experiment_id, 2)) % 7 = 0").select("experiment_id", F.lit("annotation").alias("event"), F.array(F.lit("late"), F.lit("late")).alias("tags_added"))
    return X.find_experiments(X.with_annotation_tags(folded(spark, sf), notes), tag="late").select("experiment_id")


@query("experiment_table", """SELECT experiment_id, created_at, folded_status AS status, experiment_type, strategy_name, recorded_via, ever_failed::BIGINT + ever_invalid::BIGINT + ever_rejected::BIGINT + ruined::BIGINT AS n_warnings
  FROM folded ORDER BY created_at, experiment_id""", ("folded",))
def experiment_table(spark, sf):
    return X.experiment_table(folded(spark, sf)).orderBy("created_at", "experiment_id")


@query("experiment_children", "SELECT p.experiment_id, c.experiment_id AS child_id FROM records p JOIN records c ON c.parent_experiment_id = p.experiment_id", ("records",))
def experiment_children(spark, sf):
    return lineage.children(V.records(spark, sf))


_LINE = """WITH RECURSIVE up AS (SELECT experiment_id, experiment_id AS node, parent_experiment_id AS next, 0 AS depth FROM records UNION ALL
  SELECT up.experiment_id, r.experiment_id, r.parent_experiment_id, depth + 1 FROM up JOIN records r ON r.experiment_id = up.next)"""


@query("experiment_lineage", _LINE + " SELECT experiment_id, last(node ORDER BY depth) AS root_id, max(depth) AS depth, false AS in_cycle FROM up GROUP BY experiment_id", ("records",))
def experiment_lineage(spark, sf):
    """Root and depth of every record; a handful of joins whatever the length of the chains."""
    return lineage.lineage(V.records(spark, sf))


@query("experiment_descendants", _LINE + """ SELECT r.experiment_id, (SELECT count(*) FROM records c WHERE c.parent_experiment_id = r.experiment_id) AS n_children, coalesce(n, 0) AS n_descendants
  FROM records r LEFT JOIN (SELECT node, count(*) AS n FROM up WHERE depth > 0 GROUP BY node) d ON d.node = r.experiment_id""", ("records",))
def experiment_descendants(spark, sf):
    return lineage.descendant_counts(V.records(spark, sf))


@query("oos_relabel", """SELECT o.experiment_id, o.config_family_hash, count(*) AS n_others, min(x.experiment_id) AS first_other FROM records o JOIN records x ON x.config_family_hash = o.config_family_hash
  AND x.research_stage <> 'out_of_sample' AND (x.logged_at < o.logged_at OR (x.logged_at = o.logged_at AND x.experiment_id < o.experiment_id)) WHERE o.research_stage = 'out_of_sample' GROUP BY ALL""", ("records",))
def oos_relabel(spark, sf):
    return X.oos_relabels(V.records(spark, sf))


_OOS = _LINE + """, o AS (SELECT * FROM records WHERE research_stage = 'out_of_sample' AND parent_experiment_id IS NOT NULL),
  line AS (SELECT o.experiment_id, a.experiment_id AS other FROM o JOIN up ON up.experiment_id = o.experiment_id AND depth > 0 JOIN records a ON a.experiment_id = up.node WHERE o.eval_start <= a.eval_end AND a.eval_start <= o.eval_end),
  mates AS (SELECT o.experiment_id, a.experiment_id AS other FROM o JOIN records a ON a.strategy_name = o.strategy_name AND a.search_space_id = o.search_space_id AND (a.logged_at < o.logged_at OR (a.logged_at = o.logged_at AND a.experiment_id < o.experiment_id)) WHERE o.eval_start <= a.eval_end AND a.eval_start <= o.eval_end),
  ov AS (SELECT o.experiment_id, coalesce(l.n, 0) AS n_ancestors, l.f AS first_ancestor, coalesce(m.n, 0) AS n_space_windows FROM o LEFT JOIN (SELECT experiment_id, count(*) AS n, min(other) AS f FROM line GROUP BY 1) l USING (experiment_id)
  LEFT JOIN (SELECT experiment_id, count(*) AS n FROM mates GROUP BY 1) m USING (experiment_id))"""


@query("oos_overlap", _OOS + " SELECT * FROM ov", ("records",))
def oos_overlap(spark, sf):
    return X.oos_overlaps(V.records(spark, sf))


@query("record_warnings", _OOS + """ SELECT r.experiment_id, list_aggregate(list_sort(list_filter([CASE WHEN native_or_proxy = 'proxy' THEN 'PROXY_DATA' END, CASE WHEN survivorship_safe IS NULL THEN 'SURVIVORSHIP_UNKNOWN' WHEN NOT survivorship_safe THEN 'SURVIVORSHIP_UNSAFE' END,
  CASE WHEN dirty_worktree THEN 'DIRTY_WORKTREE' END, CASE WHEN NOT git_available THEN 'GIT_UNAVAILABLE' END, CASE WHEN untracked THEN 'UNTRACKED_CODE_AT_RECORD_TIME' END, CASE WHEN logged_at - created_at > INTERVAL 1 HOUR THEN 'BACKDATED_CREATED_AT' END,
  CASE WHEN recorded_via = 'manual' THEN 'UNVERIFIED_MANUAL_RESULTS' END, CASE WHEN n_configs_evaluated IS NULL THEN 'N_CONFIGS_UNKNOWN' END,
  CASE WHEN research_stage = 'out_of_sample' AND spec <> frozen_spec_blob_sha THEN 'SPEC_CHANGED_SINCE_PARENT' END, CASE WHEN n_others > 0 THEN 'OOS_RELABEL_OF:' || first_other || ':' || n_others END,
  CASE WHEN processing_version <> 'v2' THEN 'PROCESSING_VERSION_MISMATCH:' || dataset_id END, CASE WHEN content_hash IS NULL THEN 'CONTENT_HASH_UNAVAILABLE:' || dataset_id END, CASE WHEN artifact_sha IS NULL THEN 'MISSING_ARTIFACT:curve' END,
  CASE WHEN n_ancestors > 0 THEN 'OOS_WINDOW_OVERLAP:' || first_ancestor || ':' || n_ancestors END, CASE WHEN n_space_windows > 0 THEN 'OOS_WINDOW_OVERLAP:search_space:' || n_space_windows END], lambda x: x IS NOT NULL)), 'string_agg', ',') AS warnings
  FROM records r LEFT JOIN ov USING (experiment_id) LEFT JOIN (SELECT experiment_id AS pid, frozen_spec_blob_sha AS spec FROM records) p ON p.pid = r.parent_experiment_id
  LEFT JOIN (SELECT o.experiment_id AS h, count(*) AS n_others, min(x.experiment_id) AS first_other FROM records o JOIN records x ON x.config_family_hash = o.config_family_hash
  AND x.research_stage <> 'out_of_sample' AND (x.logged_at < o.logged_at OR (x.logged_at = o.logged_at AND x.experiment_id < o.experiment_id)) WHERE o.research_stage = 'out_of_sample' GROUP BY 1) x ON x.h = r.experiment_id""", ("records",))
def record_warnings(spark, sf):
    r = V.records(spark, sf)
    w = X.record_warnings(r, cut_lineage(X.oos_overlaps(r), "overlaps"))
    return w.select("experiment_id", F.when(F.size("warnings") > 0, F.concat_ws(",", "warnings")).alias("warnings"))


@query("inconsistent_hash", "SELECT dataset_id, data_start, data_end, count(*) AS n_records FROM records WHERE content_hash IS NOT NULL GROUP BY ALL HAVING count(DISTINCT content_hash) > 1", ("records",))
def inconsistent_hash(spark, sf):
    return X.inconsistent_hashes(V.records(spark, sf))


@query("dup_result_diff", """WITH p AS (SELECT semantic_hash, sharpe, cust % 100 AS t, count(*) AS n_members, min(experiment_id) AS first_id FROM records GROUP BY ALL)
  SELECT semantic_hash, n_members, first_id, n_results, n_records::BIGINT AS n_records, n_differing_pairs FROM p JOIN (SELECT semantic_hash, count(*) AS n_results, sum(n_members) AS n_records,
  ((sum(n_members) * sum(n_members) - sum(n_members * n_members)) // 2)::BIGINT AS n_differing_pairs FROM p GROUP BY 1 HAVING count(*) > 1) USING (semantic_hash)""", ("records",))
def dup_result_diff(spark, sf):
    """Groups of one configuration with different results, without listing every pair."""
    return X.differing_results(V.records(spark, sf)).drop("result_digest")


@query("reproducibility", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY logged_at, experiment_id) - 1 AS run_seq FROM folded)
  SELECT n.experiment_id, n.run_seq, CASE WHEN n.run_seq = 0 THEN 'UNIQUE' WHEN n.folded_status <> 'COMPLETED' OR b.folded_status <> 'COMPLETED' THEN 'NOT_COMPARABLE' WHEN n.sharpe <> b.sharpe THEN 'DIVERGED' ELSE 'REPRODUCED' END AS reproducibility_status,
  CASE WHEN n.run_seq > 0 AND n.folded_status = 'COMPLETED' AND b.folded_status = 'COMPLETED' AND n.sharpe <> b.sharpe THEN 'metrics.sharpe' END AS divergence FROM n JOIN n b ON b.exact_hash = n.exact_hash AND b.run_seq = 0""", ("folded",))
def reproducibility(spark, sf):
    d = X.reproducibility(reruns(folded(spark, sf)))
    return d.select("experiment_id", "run_seq", "reproducibility_status", F.when(F.col("divergence").isNotNull(), F.concat_ws(",", "divergence")).alias("divergence"))


_WINDOWS = "(VALUES ('W1', TIMESTAMP '1995-06-01', TIMESTAMP '1995-08-15', 'SEALED'), ('W2', TIMESTAMP '1997-12-31', TIMESTAMP '1998-02-01', 'SEALED'), ('W3', TIMESTAMP '2000-01-10', TIMESTAMP '2000-01-10', 'SEALED'), ('W4', TIMESTAMP '1996-01-01', TIMESTAMP '1999-01-01', 'OPEN')) AS w(window_id, evaluation_start, evaluation_end, status)"
_WINDOW_JSON = [
    '{"window_id":"W1","status":"SEALED","evaluation_start":"1995-06-01T00:00:00+00:00","evaluation_end":"1995-08-15T00:00:00+00:00"}',
    '{"window_id":"W2","status":"SEALED","evaluation_start":"1997-12-31T00:00:00+00:00","evaluation_end":"1998-02-01T00:00:00+00:00"}',
    '{"window_id":"W3","status":"SEALED","evaluation_start":"2000-01-10T00:00:00+00:00","evaluation_end":"2000-01-10T00:00:00+00:00"}',
    '{"window_id":"W4","status":"OPEN","evaluation_start":"1996-01-01T00:00:00+00:00","evaluation_end":"1999-01-01T00:00:00+00:00"}',
]


def sealed(spark):
    from tapeledger.sources.records import sealed_windows

    text = spark.createDataFrame([(t,) for t in _WINDOW_JSON], "value string")
    return sealed_windows(text).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("evaluation_start", "evaluation_end")})


@query("sealed_overlap", f"SELECT r.experiment_id, window_id FROM records r JOIN {_WINDOWS} ON r.data_start <= evaluation_end AND r.data_end >= evaluation_start WHERE w.status = 'SEALED'", ("records",))
def sealed_overlap(spark, sf):
    runs = V.records(spark, sf).select("experiment_id", F.col("datasets")[0]["data_start"].alias("window_start"), F.col("datasets")[0]["data_end"].alias("window_end"))
    return X.window_overlaps(runs, sealed(spark)).select("experiment_id", "window_id")


@query("sealed_windows", f"SELECT window_id, count(*) AS n_orders FROM orders JOIN {_WINDOWS} ON o_orderdate BETWEEN evaluation_start AND evaluation_end WHERE status = 'SEALED' GROUP BY window_id")
def sealed_windows(spark, sf):
    """Sealed windows read from their JSON form, with the number of orders placed inside each."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("window_start"), F.col("o_orderdate").alias("window_end"))
    return X.window_overlaps(o, sealed(spark)).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_orders"))


@query("prior_use_scan", f"""SELECT window_id, r.experiment_id, r.experiment_type, r.dataset_id AS first_dataset, 1 AS n_datasets, CASE r.experiment_type WHEN 'alpha_research' THEN 'REFUSE' WHEN 'infrastructure' THEN 'DISCLOSE' ELSE 'IGNORE' END AS action
  FROM records r JOIN {_WINDOWS} ON r.data_start <= evaluation_end AND r.data_end >= evaluation_start WHERE w.status = 'SEALED'""", ("records",))
def prior_use_scan(spark, sf):
    return X.prior_uses(V.records(spark, sf), sealed(spark).select("window_id", "evaluation_start", "evaluation_end"), ["alpha_research"], ["infrastructure"])


@query("window_containment", """WITH f AS (SELECT 'C' || o_custkey AS run_id, 'ds.' || (o_custkey % 20) AS dataset_id, min(o_orderdate) AS data_start, max(o_orderdate) AS data_end, min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS eval_start, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS eval_end FROM orders GROUP BY ALL),
  u AS (SELECT 'C' || o_custkey AS run_id, 'ds.' || (o_custkey % 20) AS dataset_id, min(o_orderdate) AS frame_start, max(o_orderdate) AS frame_end FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
  SELECT coalesce(f.run_id, u.run_id) AS run_id, coalesce(f.dataset_id, u.dataset_id) AS dataset_id, CASE WHEN frame_start IS NULL THEN 'NOT_USED' WHEN data_start IS NULL THEN 'NOT_DECLARED' WHEN data_start > frame_start OR data_end < frame_end THEN 'FRAME_OUTSIDE_DATA'
  WHEN eval_start <> frame_start OR eval_end <> frame_end THEN 'EVALUATION_DIFFERS' WHEN data_start > eval_start THEN 'EVALUATION_OUTSIDE_DATA' ELSE 'OK' END AS code FROM f FULL JOIN u ON f.run_id = u.run_id AND f.dataset_id = u.dataset_id""")
def window_containment(spark, sf):
    o = V.table(spark, sf, "orders")
    keys = [F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("run_id"), F.concat(F.lit("ds."), (F.col("o_custkey") % 20).cast("string")).alias("dataset_id")]
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    declared = o.groupBy(*keys).agg(F.min("o_orderdate").alias("data_start"), F.max("o_orderdate").alias("data_end"), F.min(done).alias("eval_start"), F.max(done).alias("eval_end"))
    used = o.where("o_orderpriority <> '5-LOW'").groupBy(*keys).agg(F.min("o_orderdate").alias("frame_start"), F.max("o_orderdate").alias("frame_end"))
    return X.window_containment(declared, used)


_CODES = [
    ("status <> 'COMPLETED' AND status_reason IS NULL", "STATUS_REASON_REQUIRED"), ("experiment_type = 'alpha_research' AND hypothesis_id IS NULL", "HYPOTHESIS_REQUIRED"),
    ("parent_experiment_id IS NOT NULL AND change_from_parent IS NULL", "CHANGE_FROM_PARENT_REQUIRED"), ("research_stage = 'out_of_sample' AND (frozen_spec_ref IS NULL OR frozen_spec_blob_sha IS NULL OR parent_experiment_id IS NULL)", "FROZEN_SPEC_REQUIRED"),
    ("experiment_type IN ('alpha_research', 'robustness') AND search_space_id IS NULL", "SEARCH_SPACE_REQUIRED"), ("n_configs_evaluated < 1", "BAD_N_CONFIGS"), ("recorded_via = 'manual' AND manual_results_justification IS NULL", "JUSTIFICATION_REQUIRED"),
    ("n_periods < 1", "BAD_N_PERIODS"), ("native_or_proxy = 'proxy' AND proxy_for IS NULL", "PROXY_FOR_REQUIRED"), ("content_hash IS NOT NULL AND content_hash_method IS NULL", "HASH_METHOD_REQUIRED"), ("eval_start IS NULL", "EVALUATION_WINDOW_REQUIRED"),
]


@query("experiment_record_findings", " UNION ALL ".join(f"SELECT experiment_id, '{code}' AS code FROM records WHERE {rule}" for rule, code in _CODES), ("records",))
def experiment_record_findings(spark, sf):
    r = V.records(spark, sf).withColumns({"run_seq": F.lit(0), "rerun_of": F.lit(None).cast("string")})
    return X.record_findings(r)


@query("artifact_status", """SELECT experiment_id, 'curve' AS name, CASE WHEN artifact_sha IS NULL THEN 'UNVERIFIABLE' WHEN cust % 16 = 0 THEN 'MISSING' WHEN cust % 18 = 0 THEN 'MODIFIED' ELSE 'OK' END AS artifact_status FROM records""", ("records",))
def artifact_status(spark, sf):
    """Artifacts against the files that are there: some are gone, some were changed."""
    files = V.table(spark, sf, "orders").where(F.col("o_custkey") % 16 != 0).select(
        F.concat(F.lit("a/E"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("path"),
        F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 18 == 0, "x").otherwise("")), 256).alias("file_sha256"))
    manifest = V.records(spark, sf).select("experiment_id", F.explode("artifacts").alias("a")).select("experiment_id", "a.*")
    return X.artifact_status(manifest, files)


_REG = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY logged_at, experiment_id) - 1 AS run_no FROM records),
  r AS (SELECT *, CASE WHEN cust % 25 = 3 AND run_no > 0 THEN run_no + 1 ELSE run_no END AS run_seq, CASE WHEN cust % 27 = 0 THEN 'E-none' ELSE parent_experiment_id END AS parent2, CASE WHEN cust % 29 = 0 THEN 'schema-0' ELSE 'schema-1' END AS schema_version FROM n),
  c AS (SELECT 'E' || lpad(o_orderkey::VARCHAR, 12, '0') AS experiment_id, CASE WHEN o_custkey % 31 = 0 THEN 'x' ELSE sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus)) END AS sha FROM orders WHERE o_custkey % 33 <> 0 UNION ALL
    SELECT 'Z' || c_custkey, 'y' FROM customer WHERE c_acctbal < -900), cur AS (SELECT * FROM r WHERE schema_version = 'schema-1')"""


@query("registry_findings", _REG + """ SELECT 'SCHEMA_VERSION_UNKNOWN' AS code, experiment_id AS subject FROM r WHERE schema_version <> 'schema-1' UNION ALL SELECT 'ORPHAN_RECORD', experiment_id FROM cur WHERE experiment_id NOT IN (SELECT experiment_id FROM c)
  UNION ALL SELECT 'MISSING_RECORD', experiment_id FROM c WHERE experiment_id NOT IN (SELECT experiment_id FROM cur) UNION ALL SELECT 'RECORD_MODIFIED', cur.experiment_id FROM cur JOIN c USING (experiment_id) WHERE sha <> record_sha256
  UNION ALL SELECT 'DANGLING_PARENT', experiment_id FROM cur WHERE parent2 IS NOT NULL AND parent2 NOT IN (SELECT experiment_id FROM cur) UNION ALL SELECT 'RUN_SEQ_GAP', exact_hash FROM cur GROUP BY exact_hash HAVING max(run_seq) - min(run_seq) + 1 <> count(*)""", ("records",))
def registry_findings(spark, sf):
    """Integrity of a log with defects: unknown schema, altered and missing records, gaps and dangling parents."""
    r = V.records(spark, sf, F.col("o_custkey").alias("cust")).select("experiment_id", "exact_hash", "logged_at", "parent_experiment_id", "record_sha256", "cust")
    r = X.run_numbers(r).withColumns({
        "run_seq": F.when((F.col("cust") % 25 == 3) & (F.col("run_seq") > 0), F.col("run_seq") + 1).otherwise(F.col("run_seq")),
        "parent_experiment_id": F.when(F.col("cust") % 27 == 0, "E-none").otherwise(F.col("parent_experiment_id")),
        "schema_version": F.when(F.col("cust") % 29 == 0, "schema-0").otherwise("schema-1")})
    c = V.table(spark, sf, "orders").where(F.col("o_custkey") % 33 != 0).select(
        F.concat(F.lit("E"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("experiment_id"),
        F.when(F.col("o_custkey") % 31 == 0, "x").otherwise(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256)).alias("record_sha256"))
    z = V.table(spark, sf, "customer").where("c_acctbal < -900").select(F.concat(F.lit("Z"), F.col("c_custkey").cast("string")).alias("experiment_id"), F.lit("y").alias("record_sha256"))
    created = c.unionByName(z).withColumn("seq", F.lit(1))
    r = cut_lineage(r.select("experiment_id", "schema_version", "exact_hash", "run_seq", "parent_experiment_id", "record_sha256"), "registry")
    return X.registry_findings(r, created, "schema-1")


_LOG = """SELECT seq, experiment_id || '|' || to_status || '|' || seq AS line FROM history"""


@query("hash_chain_check", f"""WITH l AS ({_LOG}), c AS (SELECT seq, line, CASE WHEN seq > 1 THEN sha256(CASE WHEN (seq - 1) % 1009 = 0 THEN 'forged' ELSE lag(line) OVER (ORDER BY seq) END) END AS prev FROM l)
  SELECT 'HISTORY_CHAIN_BROKEN' AS code, seq FROM c WHERE prev IS DISTINCT FROM (SELECT NULL) AND seq > 1 AND (seq - 1) % 1009 = 0""", ("history",))
def hash_chain_check(spark, sf):
    """The log as lines with the hash of the line before; every 1009th line was replaced after the fact."""
    from tapeledger.operators.ordered import with_previous

    log = V.history(spark, sf).select("seq", F.concat_ws("|", "experiment_id", "to_status", F.col("seq").cast("string")).alias("line"))
    log = with_previous(cut_lineage(log, "log", release=True), [], ["seq"], F.floor(F.col("seq") / 1_000_000), {"_p": "line"}, placed="block").withColumn("prev_line_sha256", F.sha2("_p", 256))
    forged = log.withColumn("line", F.when(F.col("seq") % 1009 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return X.chain_breaks(forged.select("seq", "line", "prev_line_sha256", "block"), placed="block")


_JSON = lambda *names: "'{' || " + " || ',' || ".join(f"""'"{n}":' || coalesce(to_json({n}::VARCHAR)::VARCHAR, 'null')""" for n in names) + " || '}'"


@query("config_hashes", f"""SELECT key, semantic_hash, config_family_hash, sha256({_JSON("dirty_worktree", "semantic_hash")}) AS exact_hash FROM (
  SELECT key, dirty_worktree, sha256({_JSON("data_start", "recorded_via", "strategy_name")}) AS semantic_hash, sha256({_JSON("recorded_via", "strategy_name")}) AS config_family_hash
  FROM (SELECT * REPLACE (CASE WHEN key % 3 = 0 THEN NULL ELSE strategy_name || '|recorded_via="x' END AS strategy_name) FROM records))""", ("records",))
def config_hashes(spark, sf):
    r = V.records(spark, sf).select(F.expr("bigint(substring(experiment_id, 2))").alias("key"), F.date_format(F.col("datasets")[0]["data_start"].cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("data_start"), "recorded_via", F.concat("strategy_name", F.lit('|recorded_via="x')).alias("strategy_name"), F.col("code.dirty_worktree").alias("dirty_worktree"))
    r = r.withColumn("strategy_name", F.when(F.col("key") % 3 != 0, F.col("strategy_name")))  # delimiters in a value, and missing values
    h = X.configuration_hashes(r, ["data_start", "recorded_via", "strategy_name"], ["data_start"], ["dirty_worktree"])
    return h.select("key", "semantic_hash", "config_family_hash", "exact_hash")


_REPORT = _REG.replace("cur AS (", """r2 AS (SELECT * REPLACE (CASE WHEN key % 101 = 7 THEN left(exact_hash, 16) || 'x' ELSE exact_hash END AS exact_hash, CASE WHEN cust % 37 = 4 THEN experiment_id ELSE parent2 END AS parent2) FROM r), cur AS (""").replace("SELECT * FROM r WHERE", "SELECT * FROM r2 WHERE")
_REPORT = _REPORT.replace("WITH n AS", "WITH RECURSIVE n AS") + f""", cyc AS (SELECT experiment_id FROM cur WHERE parent2 = experiment_id UNION SELECT cur.experiment_id FROM cur JOIN cyc ON cur.parent2 = cyc.experiment_id),
  l AS ({_LOG}), stored AS (SELECT seq, line, sha256(lag(line) OVER (ORDER BY seq)) AS prev FROM l), kept AS (SELECT seq, prev, CASE WHEN seq % 1009 = 0 THEN line || '!' ELSE line END AS line FROM stored WHERE seq % 2003 <> 5),
  seen AS (SELECT seq, prev, lag(seq) OVER (ORDER BY seq) AS before_seq, sha256(lag(line) OVER (ORDER BY seq)) AS before FROM kept), nf AS (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY logged_at, experiment_id) - 1 AS k FROM folded)"""


@query("integrity_report", _REPORT + """ SELECT 'SCHEMA_VERSION_UNKNOWN' AS code, experiment_id AS subject FROM r2 WHERE schema_version <> 'schema-1' UNION SELECT 'ORPHAN_RECORD', experiment_id FROM cur WHERE experiment_id NOT IN (SELECT experiment_id FROM c)
  UNION SELECT 'MISSING_RECORD', experiment_id FROM c WHERE experiment_id NOT IN (SELECT experiment_id FROM cur) UNION SELECT 'RECORD_MODIFIED', cur.experiment_id FROM cur JOIN c USING (experiment_id) WHERE sha <> record_sha256
  UNION SELECT 'DANGLING_PARENT', experiment_id FROM cur WHERE parent2 IS NOT NULL AND parent2 NOT IN (SELECT experiment_id FROM cur) UNION SELECT 'RUN_SEQ_GAP', exact_hash FROM cur GROUP BY exact_hash HAVING max(run_seq) - min(run_seq) + 1 <> count(*)
  UNION SELECT 'PREFIX_COLLISION', left(exact_hash, 16) FROM cur GROUP BY 2 HAVING count(DISTINCT exact_hash) > 1 UNION SELECT 'PARENT_CYCLE', experiment_id FROM cyc
  UNION SELECT 'INCONSISTENT_CONTENT_HASH', dataset_id FROM cur WHERE content_hash IS NOT NULL GROUP BY dataset_id, data_start, data_end HAVING count(DISTINCT content_hash) > 1
  UNION SELECT 'SEMANTIC_DUP_RESULT_DIFF', semantic_hash FROM cur GROUP BY semantic_hash HAVING count(DISTINCT (sharpe, cust % 100)) > 1
  UNION SELECT 'HISTORY_CHAIN_BROKEN', seq::VARCHAR FROM seen WHERE prev IS DISTINCT FROM before UNION SELECT 'BAD_SEQ', seq::VARCHAR FROM seen WHERE seq <> coalesce(before_seq, 0) + 1
  UNION SELECT CASE WHEN cust % 16 = 0 THEN 'ARTIFACT_MISSING' ELSE 'ARTIFACT_MODIFIED' END, experiment_id || ':curve' FROM records WHERE artifact_sha IS NOT NULL AND (cust % 16 = 0 OR cust % 18 = 0)
  UNION SELECT 'DIVERGED', a.experiment_id FROM nf a JOIN nf b ON b.exact_hash = a.exact_hash AND b.k = 0 WHERE a.k > 0 AND a.folded_status = 'COMPLETED' AND b.folded_status = 'COMPLETED' AND a.sharpe <> b.sharpe
  UNION SELECT 'UNPARSEABLE_RECORD', 'f/' || o_orderkey FROM orders WHERE o_orderkey % 50 = 1""", ("records", "history", "folded"))
def integrity_report(spark, sf):
    """One report with every code, over a log spoilt in every way."""
    from tapeledger.operators.ordered import with_previous

    o = V.table(spark, sf, "orders")
    eid = F.concat(F.lit("E"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    schema = F.when(F.col("cust") % 29 == 0, "schema-0").otherwise("schema-1")
    every = V.records(spark, sf, F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("key"))
    # the records are read from the orders by each part, which makes only the columns it needs; what has to be numbered is stored
    r = every.withColumns({"schema_version": schema, "parent_experiment_id": F.when(F.col("cust") % 37 == 4, F.col("experiment_id")).when(F.col("cust") % 27 == 0, "E-none").otherwise(F.col("parent_experiment_id"))})
    r = r.select("experiment_id", "semantic_hash", "parent_experiment_id", "record_sha256", "metrics", "datasets", "schema_version")
    history = cut_lineage(V.history(spark, sf).select("experiment_id", "seq", "event", "to_status", "reason"), "log", release=True)
    again = cut_lineage(X.reproducibility(reruns(X.fold_status(every, history), "cust", "key")).select("experiment_id", "exact_hash", "run_seq", "reproducibility_status", "cust", "key"), "runs", release=True)
    exact = F.lower(F.hex("exact_hash"))
    runs = again.select(
        F.when((F.col("cust") % 25 == 3) & (F.col("run_seq") > 0), F.col("run_seq") + 1).otherwise(F.col("run_seq")).alias("run_seq"), schema.alias("schema_version"),
        F.when(F.col("key") % 101 == 7, F.concat(F.left(exact, F.lit(16)), F.lit("x"))).otherwise(exact).alias("exact_hash"))
    sha = F.when(F.col("o_custkey") % 31 == 0, "x").otherwise(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256))
    made = o.where(F.col("o_custkey") % 33 != 0).select(eid.alias("experiment_id"), sha.alias("record_sha256"))
    z = V.table(spark, sf, "customer").where("c_acctbal < -900").select(F.concat(F.lit("Z"), F.col("c_custkey").cast("string")).alias("experiment_id"), F.lit("y").alias("record_sha256"))
    log = history.select("seq", F.concat_ws("|", "experiment_id", "to_status", F.col("seq").cast("string")).alias("line"))
    log = with_previous(log, [], ["seq"], F.floor(F.col("seq") / 1_000_000), {"_p": "line"}, placed="block").where("seq % 2003 <> 5")
    lines = log.select("seq", F.when(F.col("seq") % 1009 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("line"), F.sha2("_p", 256).alias("prev_line_sha256"), "block")
    files = o.where(F.col("o_custkey") % 16 != 0).select(F.concat(F.lit("a/"), eid).alias("path"), F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 18 == 0, "x").otherwise("")), 256).alias("file_sha256"))
    artifacts = X.artifact_status(V.records(spark, sf).select("experiment_id", F.explode("artifacts").alias("a")).select("experiment_id", "a.*"), files)
    unreadable = o.where("o_orderkey % 50 = 1").select(F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("file"), F.lit("UNPARSEABLE_RECORD").alias("code"))
    return X.integrity_report(r, made.unionByName(z).withColumn("seq", F.lit(1)), "schema-1", lines, artifacts, again, unreadable, lineage.endless(r.where("schema_version = 'schema-1'")), runs)


@query("rerun_results", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY logged_at, experiment_id) - 1 AS run_seq FROM folded),
  d AS (SELECT n.experiment_id, n.run_seq, n.folded_status, b.folded_status AS base_status, n.key % 2 <> b.key % 2 AS custom_differs, (n.key % 5 = 0) <> (b.key % 5 = 0) AS warnings_differ FROM n JOIN n b ON b.exact_hash = n.exact_hash AND b.run_seq = 0)
  SELECT experiment_id, CASE WHEN run_seq = 0 THEN 'UNIQUE' WHEN folded_status <> 'COMPLETED' OR base_status <> 'COMPLETED' THEN 'NOT_COMPARABLE' WHEN custom_differs OR warnings_differ THEN 'DIVERGED' ELSE 'REPRODUCED' END AS reproducibility_status,
  CASE WHEN run_seq > 0 AND folded_status = 'COMPLETED' AND base_status = 'COMPLETED' AND (custom_differs OR warnings_differ) THEN concat_ws(',', CASE WHEN custom_differs THEN 'custom.seed' END, CASE WHEN warnings_differ THEN 'result_warnings' END) END AS divergence FROM d""", ("folded",))
def rerun_results(spark, sf):
    """Repeats that differ in results of their own or in their result warnings; their metrics are alike."""
    key = F.expr("bigint(substring(experiment_id, 2))")
    f = folded(spark, sf).withColumns({
        "metrics": F.create_map(F.lit("sharpe"), F.lit(1.0)), "custom": F.create_map(F.lit("seed"), key % 2, F.lit("fixed"), F.lit(1).cast("bigint")),
        "result_warnings": F.when(key % 5 == 0, F.array(F.lit("LEVERAGE_BREACH"))).otherwise(F.array().cast("array<string>"))})
    d = X.reproducibility(reruns(f))
    return d.select("experiment_id", "reproducibility_status", F.when(F.col("divergence").isNotNull(), F.concat_ws(",", "divergence")).alias("divergence"))


@query("code_findings", """WITH r AS (SELECT 'E' || o_orderkey AS experiment_id, o_custkey AS c FROM orders) SELECT experiment_id, 'BAD_GIT_COMMIT' AS code FROM r WHERE c % 7 = 1 UNION ALL SELECT experiment_id, 'FINGERPRINT_REQUIRED' FROM r WHERE c % 11 IN (0, 1)
  UNION ALL SELECT experiment_id, 'EMPTY_FINGERPRINT' FROM r WHERE c % 13 = 0 UNION ALL SELECT experiment_id, 'CONTRACTS_REQUIRED' FROM r WHERE c % 17 = 0 UNION ALL SELECT experiment_id, 'SCHEMA_CONTRACT_MISMATCH' FROM r WHERE c % 19 = 0""")
def code_findings(spark, sf):
    """Code identities made from orders, broken by rules on the customer's number."""
    c, t = F.col("o_custkey"), lambda x: F.lit(x)
    commit = F.when(c % 7 == 1, "main").when(c % 7 != 2, F.left(F.sha2(c.cast("string"), 256), F.lit(40)))
    print_ = F.when(c % 11 == 0, F.lit(None).cast("string")).when(c % 11 == 1, "abc").otherwise(F.sha2(c.cast("string"), 256))
    versions = F.create_map(t("registry_schema"), F.when(c % 19 == 0, "s0").otherwise("s1"), t("data_contract"), t("1"), t("backtest_contract"), t("1"), F.when(c % 17 == 0, "other").otherwise("data_processing_version"), t("v2"))
    code = F.struct(commit.alias("git_commit"), print_.alias("code_fingerprint"), F.when(c % 13 == 0, 0).otherwise(5).alias("code_fingerprint_n_files"), versions.alias("contract_versions"))
    return X.code_findings(V.table(spark, sf, "orders").select(F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("experiment_id"), F.lit("s1").alias("schema_version"), code.alias("code")))


_ARTIFACTS = """a AS (SELECT experiment_id, 'curve' AS name, 'a/' || experiment_id AS path, artifact_sha AS sha256 FROM records UNION ALL
  SELECT 'E' || lpad(l_orderkey::VARCHAR, 12, '0'), 'log' || l_linenumber, CASE l_suppkey % 7 WHEN 0 THEN '/abs/' WHEN 1 THEN 'C:\\x' WHEN 2 THEN 'a\\b' WHEN 3 THEN '' ELSE 'logs/' END || CASE WHEN l_suppkey % 7 = 3 THEN '' ELSE l_linenumber::VARCHAR END, NULL FROM lineitem WHERE l_linenumber = 1)"""


def _artifacts(spark, sf):
    mode, n = F.col("l_suppkey") % 7, F.col("l_linenumber").cast("string")
    path = F.when(mode == 3, "").otherwise(F.concat(F.when(mode == 0, "/abs/").when(mode == 1, "C:\\x").when(mode == 2, "a\\b").otherwise("logs/"), n))
    added = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(
        F.concat(F.lit("E"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("experiment_id"), F.lit("artifact_added").alias("event"), F.struct(F.concat(F.lit("log"), n).alias("name"), path.alias("path"), F.lit(None).cast("string").alias("sha256")).alias("artifact"))
    return X.all_artifacts(V.records(spark, sf), added)


@query("experiment_artifacts", f"WITH {_ARTIFACTS} SELECT * FROM a", ("records",))
def experiment_artifacts(spark, sf):
    """Artifacts of records and those that later events added."""
    return _artifacts(spark, sf)


@query("artifact_rule_findings", f"""WITH {_ARTIFACTS} SELECT experiment_id, name, 'BAD_KIND' AS code FROM a WHERE name = 'curve' AND sha256 IS NULL UNION ALL SELECT experiment_id, name, 'ABSOLUTE_PATH' FROM a WHERE path LIKE '/%' OR path LIKE 'C:%'
  UNION ALL SELECT experiment_id, name, 'BACKSLASH_IN_PATH' FROM a WHERE contains(path, '\\') UNION ALL SELECT experiment_id, name, 'PATH_REQUIRED' FROM a WHERE path = ''""", ("records",))
def artifact_rule_findings(spark, sf):
    kind = F.when((F.col("name") == "curve") & F.col("sha256").isNull(), "picture").when(F.col("name") == "curve", "equity_curve").otherwise("log")
    return X.artifact_findings(_artifacts(spark, sf).withColumn("kind", kind))


@query("tags_and_notes", """SELECT experiment_id, 'tag' AS kind, NULL::BIGINT AS seq, tag AS text FROM records UNION SELECT experiment_id, 'tag', NULL, 'late' || seq % 3 FROM history WHERE seq % 4 = 0
  UNION ALL SELECT experiment_id, 'note', seq, reason || seq FROM history WHERE seq % 4 = 0 UNION ALL SELECT experiment_id, 'note', 0, 'made by hand' FROM records WHERE cust % 6 = 0""", ("records", "history"))
def tags_and_notes(spark, sf):
    """Tags and notes of records and of annotations, folded into rows."""
    h = V.history(spark, sf).where("seq % 4 = 0")
    notes = h.select("experiment_id", "seq", F.lit("annotation").alias("event"), F.array(F.concat(F.lit("late"), (F.col("seq") % 3).cast("string"))).alias("tags_added"), F.concat("reason", F.col("seq").cast("string")).alias("note"))
    r = V.records(spark, sf).withColumn("notes", F.when(F.col("recorded_via") == "manual", "made by hand"))
    return X.tags_and_notes(r, cut_lineage(notes, "annotations"))


@query("experiment_listing", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY logged_at, experiment_id) - 1 AS run_seq FROM folded)
  SELECT n.experiment_id, n.folded_status AS status, CASE WHEN n.run_seq = 0 THEN 'UNIQUE' WHEN n.folded_status <> 'COMPLETED' OR b.folded_status <> 'COMPLETED' THEN 'NOT_COMPARABLE' WHEN n.sharpe <> b.sharpe THEN 'DIVERGED' ELSE 'REPRODUCED' END AS reproducibility_status
  FROM n JOIN n b ON b.exact_hash = n.exact_hash AND b.run_seq = 0""", ("folded",))
def experiment_listing(spark, sf):
    """The listing with the verdict on each repeat."""
    listed = reruns(folded(spark, sf), "created_at", "experiment_type", "strategy_name", "recorded_via", "warnings", *(f"ever_{s.lower()}" for s in X.STATUSES))
    return X.experiment_table(X.reproducibility(listed)).select("experiment_id", "status", "reproducibility_status")
