"""Parent chains of experiments: root, depth, cycles, ancestors and descendants.

All of it uses doubling: after round k every record knows its 2^k-th ancestor, so a chain of any length takes
log2(length) rounds of one equality join each. Every round holds one row per record (or per answer); ancestor
pairs of the whole table, which grow with the square of a chain, are never built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.session import cut_lineage, drop_stored


def _links(records: DataFrame) -> DataFrame:
    """Parent links whose target exists; a link to an unknown parent ends the chain."""
    ids = records.select(F.col("experiment_id").alias("parent_experiment_id"))
    return records.select("experiment_id", "parent_experiment_id").where("parent_experiment_id is not null").join(ids, on="parent_experiment_id", how="left_semi")


def lineage(records: DataFrame) -> DataFrame:
    """Root and depth (0 for a root) of every record; ``in_cycle`` for records whose chain never ends."""
    links = _links(records)
    d = records.select("experiment_id").join(links, on="experiment_id", how="left").select(
        "experiment_id", F.col("parent_experiment_id").alias("jump"), F.coalesce("parent_experiment_id", "experiment_id").alias("root"),
        F.when(F.col("parent_experiment_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
    )
    d, done, before, k = cut_lineage(d, "lineage-0"), None, None, 0
    while True:
        ended, active = d.where("jump is null"), d.where("jump is not null")
        done = ended if done is None else done.unionByName(ended)
        left = active.count()
        if left == 0 or left == before:  # some record of every depth ends in a round, unless only cycles are left
            break
        before, k = left, k + 1
        far = done.unionByName(active).select(F.col("experiment_id").alias("jump"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        d = cut_lineage(active.join(far, on="jump", how="left").select(
            "experiment_id", F.col("_jump").alias("jump"), F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        ), f"lineage-{k}")
    d = done.unionByName(active)
    cyclic = F.col("jump").isNotNull()
    return d.select("experiment_id", F.when(~cyclic, F.col("root")).alias("root_id"), F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("in_cycle"))


def endless(records: DataFrame) -> DataFrame:
    """Records whose chain of parents never ends, as (experiment_id, in_cycle): what ``lineage`` marks, without roots and depths.
    A record goes as soon as its chain ends, so every round reads and stores fewer rows, and only the last two rounds are kept."""
    d, left, before, k = cut_lineage(_links(records).select("experiment_id", F.col("parent_experiment_id").alias("jump")).distinct(), "endless-0", release=True), None, None, 0
    while True:
        left = d.count()
        if left == 0 or left == before:  # some record of every depth ends in a round, unless only cycles are left
            return d.select("experiment_id", F.lit(True).alias("in_cycle"))
        before, k, last = left, k + 1, d
        far = last.select(F.col("experiment_id").alias("jump"), F.col("jump").alias("_jump"))
        d = cut_lineage(last.join(far, on="jump").select("experiment_id", F.col("_jump").alias("jump")), f"endless-{k}", release=True)
        drop_stored(last)


def _jumps(records: DataFrame) -> list[DataFrame]:
    """Tables of 2^k-th ancestors, k = 0, 1, ..., until no record has one. Records whose chain never ends are left
    out: they have no ancestors here, and ``lineage`` marks them."""
    tables = [cut_lineage(_links(records).select("experiment_id", F.col("parent_experiment_id").alias("ancestor")), "jump-0")]
    left = tables[0].count()
    while left:
        last = tables[-1]
        nxt = last.select("experiment_id", F.col("ancestor").alias("_mid")).join(last.select(F.col("experiment_id").alias("_mid"), "ancestor"), on="_mid")
        nxt = cut_lineage(nxt.select("experiment_id", "ancestor"), f"jump-{len(tables)}")
        after = nxt.count()
        if after == left:
            endless = nxt.select("experiment_id")
            return [cut_lineage(t.join(endless, on="experiment_id", how="left_anti"), f"jump-ended-{k}") for k, t in enumerate(tables)]
        if after:
            tables.append(nxt)
        left = after
    return tables


def lineage_of(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Each given id with all its ancestors and itself: origin_id, experiment_id, distance."""
    found = ids.select(F.col("experiment_id").alias("origin_id"), "experiment_id", F.lit(0).cast("bigint").alias("distance"))
    for k, table in enumerate(_jumps(records)):
        step = found.join(table, on="experiment_id").select("origin_id", F.col("ancestor").alias("experiment_id"), (F.col("distance") + (1 << k)).alias("distance"))
        found = cut_lineage(found.unionByName(step), f"ancestors-{k}")
    return found


def _hulls(records: DataFrame, windows: DataFrame) -> list[DataFrame]:
    """Table k holds for every record with a parent what its next 2^k ancestors span: ``n`` of them with windows, the hull
    of these (``low`` to ``high``), what all of them reach (``late``, the latest start, and ``early``, the earliest end, of one window
    each), the smallest id, and ``mid``, the record 2^(k-1) above. ``windows(experiment_id, spans)`` has arrays of (s, e)."""
    links = _links(records)
    starts = windows.select(F.col("experiment_id").alias("parent_experiment_id"), "spans")
    longest = F.array_max(F.transform("spans", lambda w: F.struct((w["e"].cast("timestamp") - w["s"].cast("timestamp")).alias("d"), w["s"].alias("s"), w["e"].alias("e"))))
    has = F.col("spans").isNotNull()
    first = links.join(starts, on="parent_experiment_id", how="left").withColumn("_l", longest).select(
        "experiment_id", F.col("parent_experiment_id").alias("jump"), F.lit(None).cast("string").alias("mid"), has.cast("bigint").alias("n"),
        F.array_min(F.transform("spans", lambda w: w["s"])).alias("low"), F.array_max(F.transform("spans", lambda w: w["e"])).alias("high"), F.col("_l.s").alias("late"), F.col("_l.e").alias("early"),
        F.when(has, F.col("parent_experiment_id")).alias("first"), "spans")
    tables = [cut_lineage(first, "hull-0")]
    after = tables[0].where("jump is not null").count()
    while True:
        last, left = tables[-1], after
        above = last.select(F.col("experiment_id").alias("jump"), *(F.col(c).alias(f"_{c}") for c in ("jump", "n", "low", "high", "late", "early", "first")))
        both = last.where("jump is not null").join(above, on="jump", how="left")
        nxt = both.select("experiment_id", F.col("_jump").alias("jump"), F.col("jump").alias("mid"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"),
                          F.greatest("late", "_late").alias("late"), F.least("early", "_early").alias("early"), F.least("first", "_first").alias("first"), F.lit(None).cast(first.schema["spans"].dataType).alias("spans"))
        ended = last.where("jump is null").select("experiment_id", "jump", F.lit(None).cast("string").alias("mid"), "n", "low", "high", "late", "early", "first", F.lit(None).cast(first.schema["spans"].dataType).alias("spans"))
        nxt = cut_lineage(nxt.unionByName(ended), f"hull-{len(tables)}")
        after = nxt.where("jump is not null").count()
        if after == left and after:  # only cycles are left: those records have no ancestors here
            endless = nxt.where("jump is not null").select("experiment_id")
            return [cut_lineage(t.join(endless, on="experiment_id", how="left_anti"), f"hull-ended-{k}") for k, t in enumerate(tables)]
        tables.append(nxt)
        if not after:
            return tables


def ancestor_overlaps(records: DataFrame, windows: DataFrame, origins: DataFrame) -> DataFrame:
    """Per record of ``origins(experiment_id)``: number of ancestors with a window that meets one of its own, and the
    smallest id of these; records without any are left out. ``windows(experiment_id, spans)``, closed at both ends.

    No ancestor pairs are built. A record starts at the stretch of all its ancestors; a stretch whose hull misses the
    record's windows goes, one all of whose records meet them counts as a whole, and any other is halved. The stretches come
    from doubling, so a chain of any length takes a logarithmic number of rounds up and down."""
    tables = _hulls(records, windows)
    own = origins.join(windows, on="experiment_id").select(F.col("experiment_id").alias("origin"), F.col("experiment_id").alias("node"), F.col("spans").alias("own"))
    front, found = own, None
    for k in range(len(tables) - 1, -1, -1):
        met = front.join(tables[k].withColumnRenamed("experiment_id", "node"), on="node").where("n > 0")
        met = met.where(F.exists("own", lambda w: (F.col("low") <= w["e"]) & (F.col("high") >= w["s"])))
        sure = F.exists("own", lambda w: (F.col("late") <= w["e"]) & (F.col("early") >= w["s"]))
        if k == 0:
            sure = sure | F.exists("own", lambda w: F.exists("spans", lambda a: (a["s"] <= w["e"]) & (a["e"] >= w["s"])))
        met = cut_lineage(met.select("origin", "node", "mid", "own", "n", "first", sure.alias("sure")), f"descent-{k}")
        hits = met.where("sure").groupBy("origin").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        found = hits if found is None else found.unionByName(hits)
        if k:
            open_ = met.where("not sure")
            front = open_.select("origin", "node", "own").unionByName(open_.where("mid is not null").select("origin", F.col("mid").alias("node"), "own"))
    return found.groupBy(F.col("origin").alias("experiment_id")).agg(F.sum("n").cast("bigint").alias("n_ancestors"), F.min("first").alias("first_ancestor"))


def descendants_of(records: DataFrame, ids: DataFrame) -> DataFrame:
    """All records below each given id: origin_id, experiment_id, distance."""
    found = ids.select(F.col("experiment_id").alias("origin_id"), "experiment_id", F.lit(0).cast("bigint").alias("distance"))
    for k, table in enumerate(_jumps(records)):
        below = table.select(F.col("ancestor").alias("experiment_id"), F.col("experiment_id").alias("_below"))
        step = found.join(below, on="experiment_id").select("origin_id", F.col("_below").alias("experiment_id"), (F.col("distance") + (1 << k)).alias("distance"))
        found = cut_lineage(found.unionByName(step), f"descendants-{k}")
    return found.where("distance > 0")


def descendant_counts(records: DataFrame) -> DataFrame:
    """Number of children and of all descendants of every record, without listing them: a record's count within
    2^(k+1) steps is its count within 2^k plus the counts of the records exactly 2^k below it."""
    tables = _jumps(records)
    counts = records.select("experiment_id", F.lit(1).cast("bigint").alias("n"))
    for k, table in enumerate(tables):
        gained = table.join(counts, on="experiment_id").groupBy(F.col("ancestor").alias("experiment_id")).agg(F.sum("n").alias("_gain"))
        counts = counts.join(gained, on="experiment_id", how="left").select("experiment_id", (F.col("n") + F.coalesce("_gain", F.lit(0))).alias("n"))
        counts = cut_lineage(counts, f"descendant-counts-{k}")
    children = tables[0].groupBy(F.col("ancestor").alias("experiment_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return counts.join(children, on="experiment_id", how="left").select("experiment_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("n") - 1).alias("n_descendants"))


def children(records: DataFrame) -> DataFrame:
    """Direct children with their parent's row key."""
    child = records.where("parent_experiment_id is not null").select(F.col("parent_experiment_id").alias("experiment_id"), F.col("experiment_id").alias("child_id"))
    return child.join(records.select("experiment_id"), on="experiment_id", how="left_semi")
