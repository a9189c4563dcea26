"""Order-free table digests and configuration hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LANES = 4
_HEX_PER_LANE = 15


def canonical_text(*cols: Column) -> Column:
    """One text per row: each field as text, NULL written as a mark no field can hold, fields split by U+001F."""
    return F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])


def row_sha(*cols: Column) -> Column:
    return F.sha2(canonical_text(*cols), 256)


def hash_bytes(c: Column | str) -> Column:
    """A text that is a hash as its 32 bytes, for shuffles; any other text as more bytes than those. Equal texts, and no
    others, have equal bytes; they are ordered otherwise than the texts."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(c)).otherwise(F.encode(F.concat(F.lit(" " * 33), c), "UTF-8"))


def hash_text(c: Column | str) -> Column:
    """The text that ``hash_bytes`` packed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(F.decode(c, "UTF-8"), 34, 2147483647))


def table_digest(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Digest of the multiset of rows per group: the row hashes are cut into lanes and summed, and the sums
    are hashed together with the row count. Sums combine on the map side, so no group is ever gathered, and
    the order in which rows are stored or read does not matter. It detects change; it is not a signature."""
    sha = row_sha(*[F.col(c) for c in sorted(columns)])
    lanes = [
        F.conv(F.substring("_sha", 1 + i * _HEX_PER_LANE, _HEX_PER_LANE), 16, 10).cast("decimal(38,0)")
        for i in range(_LANES)
    ]
    sums = [F.sum(lane).alias(f"_lane{i}") for i, lane in enumerate(lanes)]
    out = df.select(*group, sha.alias("_sha")).groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    text = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"_lane{i}").cast("string") for i in range(_LANES)])
    return out.select(*group, "n_rows", F.sha2(text, 256).alias("digest"))


def digest_tree(df: DataFrame, columns: list[str], levels: list[str]) -> list[DataFrame]:
    """Digests of a dataset at every level, root first: the whole, then by ``levels[0]``, by the first two levels, and so on.

    Only the leaves read the rows; a branch is the digest of its sorted children, so it is made from one row per child."""
    trees = [table_digest(df, columns, levels)]
    for depth in range(len(levels) - 1, -1, -1):
        keys, child = levels[:depth], levels[depth]
        below = trees[0]
        # children are summed like rows: the order in which they come does not matter
        named = below.select(*levels[:depth + 1], "n_rows", "digest")
        rolled = table_digest(named.withColumn("_child", F.col(child).cast("string")), ["_child", "digest"], keys)
        totals = named.groupBy(*keys).agg(F.sum("n_rows").alias("_total"))
        joined = rolled.join(totals, on=keys) if keys else rolled.withColumn("_total", totals.select("_total").scalar())
        trees.insert(0, joined.select(*keys, F.col("_total").alias("n_rows"), "digest"))
    return trees


def digest_diff(old: list[DataFrame], new: list[DataFrame], levels: list[str]) -> DataFrame:
    """Leaves of two digest trees that differ: ``levels, change`` (added, removed or changed).

    The trees are compared from the root down; children of equal branches are not read further."""
    changed = None
    for depth in range(len(levels) + 1):
        keys = levels[:depth]
        a, b = old[depth].select(*keys, F.col("digest").alias("_a")), new[depth].select(*keys, F.col("digest").alias("_b"))
        if depth == 0:
            if a.first()["_a"] == b.first()["_b"]:
                return old[-1].limit(0).select(*levels, F.lit("").alias("change"))
            continue
        if changed is not None:
            a, b = (d.join(changed.select(*levels[:depth - 1]), on=levels[:depth - 1], how="left_semi") for d in (a, b))
        both = a.join(b, on=keys, how="full_outer")
        kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
        changed = both.withColumn("change", kind).where("change is not null").select(*keys, "change")
    return changed


def config_hash(fields: dict[str, Column]) -> Column:
    """Hash of named settings as JSON text: names are sorted, values are quoted text, a missing one is null, so no two
    different settings share a text."""
    settings = F.struct(*[col.cast("string").alias(name) for name, col in sorted(fields.items())])
    return F.sha2(F.to_json(settings, {"ignoreNullFields": "false"}), 256)
