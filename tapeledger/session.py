"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Spark's setting for deleting the shuffle files of a job that has ended.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "tapeledger", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on: UTC time and adaptive execution."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. The cluster names it in ``spark.checkpoint.dir``;
    a scratch folder is made only when that is unset and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-tapeledger-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "tapeledger", spark.sparkContext.applicationId)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder. Results that still read it must be written before."""
    jvm, root = spark.sparkContext._jvm, _scratch_root(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so a plan that uses it many times,
    or an iteration that grows it round by round, starts from stored rows that outlive executors.

    With ``release`` the shuffle files of that job are deleted as soon as it has ended; else they stay until the driver
    forgets its plan. The job shares them with no other."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if release:
        before = spark.conf.get(RELEASE_SHUFFLES, "false")
        spark.conf.set(RELEASE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(RELEASE_SHUFFLES, before)
    else:
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by ``cut_lineage`` from the shared folder. Only for tables whose every reader was itself
    stored since: a plan that still reads one would fail. Other frames are left alone."""
    for df in frames:
        stored_at = vars(df).get("_stored_at")
        if stored_at:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(stored_at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
