"""Experiment records, their event log and protected windows as files of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRAPPED = "struct<`$ts`:string>"
DATASET_DDL = (
    f"struct<dataset_id:string,source_venue:string,field_type:string,native_or_proxy:string,proxy_for:string,processing_version:string,dataset_version:string,"
    f"data_start:{_WRAPPED},data_end:{_WRAPPED},eval_start:{_WRAPPED},eval_end:{_WRAPPED},symbols:array<string>,symbol_mapping:string,"
    f"content_hash:string,content_hash_method:string,provenance_notes:string>"
)
RECORD_DDL = (
    f"experiment_id string, schema_version string, semantic_hash string, exact_hash string, config_family_hash string, run_seq bigint, rerun_of string, created_at {_WRAPPED}, "
    f"experiment_type string, status string, status_reason string, research_stage string, hypothesis_id string, parent_experiment_id string, change_from_parent string, reason_for_run string, "
    f"frozen_spec_ref string, frozen_spec_sha256 string, frozen_spec_commit string, frozen_spec_blob_sha string, universe_policy string, survivorship_safe boolean, uses_proxy_data boolean, "
    f"no_datasets_reason string, recorded_via string, manual_results_justification string, search_space_id string, n_configs_evaluated bigint, notes string, tags array<string>, warnings array<string>, "
    f"datasets array<{DATASET_DDL}>, strategy struct<name:string,version:string,params:map<string,string>,frequency:string,target_execution_venue:string>, backtest_config map<string,string>, "
    f"code struct<git_commit:string,git_available:boolean,dirty_worktree:boolean,untracked_code_files:bigint,code_fingerprint:string,contract_versions:map<string,string>>, "
    f"results struct<metrics:map<string,double>,n_periods:bigint,rebalance_count:bigint,ruined:boolean,result_warnings:array<string>>, "
    f"artifacts array<struct<name:string,kind:string,path:string,sha256:string,size_bytes:bigint>>"
)
EVENT_DDL = (
    f"seq bigint, at {_WRAPPED}, logged_at {_WRAPPED}, event string, experiment_id string, prev_line_sha256 string, "
    f"payload struct<`from`:string,`to`:string,reason:string,note:string,tags_added:array<string>,name:string,path:string,sha256:string,record_sha256:string,exact_hash:string,run_seq:bigint,status:string>"
)


def _ts(column) -> F.Column:
    return column.getField("$ts").cast("timestamp")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per record, with the digest of the stored bytes beside it: the files are read once as text."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    d = files.select("file", F.sha2("value", 256).alias("record_sha256"), F.from_json("value", RECORD_DDL).alias("r")).select("file", "record_sha256", "r.*")
    zoned = F.transform("datasets", lambda x: x.withField("data_start", _ts(x["data_start"])).withField("data_end", _ts(x["data_end"])).withField("eval_start", _ts(x["eval_start"])).withField("eval_end", _ts(x["eval_end"])))
    code = F.col("code").withField("data_processing_version", F.col("code.contract_versions")["data_processing_version"])
    return d.withColumns({
        "created_at": _ts(F.col("created_at")), "datasets": zoned, "code": code, "strategy_name": F.col("strategy.name"), "metrics": F.col("results.metrics"),
        "n_periods": F.col("results.n_periods"), "rebalance_count": F.col("results.rebalance_count"), "ruined": F.col("results.ruined"), "result_warnings": F.col("results.result_warnings"),
        "sharpe": F.col("results.metrics")["sharpe"],
    }).drop("results", "strategy")


def unparseable_records(records: DataFrame) -> DataFrame:
    """Files whose text gave no record."""
    return records.where("experiment_id is null").select("file", F.lit("UNPARSEABLE_RECORD").alias("code"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their raw text, for the fold and for the check of the hash chain."""
    d = spark.read.text(path).withColumn("e", F.from_json("value", EVENT_DDL)).select(F.col("value").alias("line"), "e.*")
    p = F.col("payload")
    return d.withColumns({
        "at": _ts(F.col("at")), "logged_at": _ts(F.col("logged_at")), "from_status": p["from"], "to_status": p["to"], "reason": p["reason"], "note": p["note"], "tags_added": p["tags_added"],
        "artifact": F.struct(p["name"].alias("name"), p["path"].alias("path"), p["sha256"].alias("sha256")), "record_sha256": p["record_sha256"],
    }).drop("payload")


def history_line_findings(history: DataFrame) -> DataFrame:
    """Log lines that are not empty and gave no event; the digest names the line."""
    unread = F.col("event").isNull() & F.col("experiment_id").isNull() & (F.trim("line") != "")
    return history.where(unread).select(F.sha2("line", 256).alias("line_sha256"), F.lit("UNPARSEABLE_LINE").alias("code"))


def created_events(history: DataFrame) -> DataFrame:
    return history.where(F.col("event").isin("created", "created_backfilled")).select("experiment_id", "record_sha256", "seq")


def sealed_windows(text: DataFrame) -> DataFrame:
    """Protected windows with status SEALED from JSON text (column ``value``, one window per row). Anything that
    does not parse, lacks a field or has a time without a zone fails the job: an unreadable seal must not look
    like no seal."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("window_id", "status", "evaluation_start", "evaluation_end")])
    d = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("w")).select("w.*")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    zoneless = lambda c: ~F.col(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    broken = blank("window_id") | blank("status") | blank("evaluation_start") | blank("evaluation_end") | zoneless("evaluation_start") | zoneless("evaluation_end")
    checked = F.when(broken, F.raise_error(F.concat(F.lit("malformed protected window: "), F.coalesce(F.to_json(F.struct("*")), F.lit("null"))))).otherwise(F.col("window_id"))
    d = d.withColumns({"window_id": checked, "evaluation_start": F.col("evaluation_start").cast(T.TimestampType()), "evaluation_end": F.col("evaluation_end").cast(T.TimestampType())})
    return d.where(F.col("window_id").isNotNull() & (F.col("status") == "SEALED"))


def read_protected_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows file: one JSON array of objects."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<map<string,string>>", {"mode": "FAILFAST"})
    return sealed_windows(whole.select(F.explode(items).alias("m")).select(F.to_json("m").alias("value")))
