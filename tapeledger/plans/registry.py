"""Registry of runnable queries and, where SQL can say the same, of their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeledger.plans.views import with_views
from tapeledger.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain_zero_sql(sql: str) -> str:
    """Add 0.0 to every named ``round(...) AS name``, which turns -0.0 into 0.0."""
    out, at = [], 0
    for found in re.finditer(r"\bround\(", sql):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if end > at and sql[end:].startswith(" AS "):
            out += [sql[at:end], " + 0.0"]
            at = end
    return "".join([*out, sql[at:]])


def _plain_zeros(df: DataFrame) -> DataFrame:
    """Turn -0.0 into 0.0, so that results compare by value; the SQL side does the same to rounded columns."""
    signed = {f.name: F.col(f.name) + F.lit(0.0) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(signed) if signed else df


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), **replace: str):
    """Register ``build(spark, sf_dir)`` under ``name``; ``sql`` may use the named views, and ``replace`` puts other
    texts in place of some of them."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain_zeros(build(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _plain_zero_sql(with_views(sql, views, **replace))
        return build

    return register
