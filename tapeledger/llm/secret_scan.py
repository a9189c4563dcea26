"""Secret scan: credential-like spans of whole texts and how widely each value is spread over the corpus.

Every value found is hashed; the hashes are counted by distinct repositories and owners. A value that several
owners share is a copied example; one that a single owner holds looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices, spare_names, texts_of
from tapeledger.session import cut_lineage

# Kinds in their order, pattern, least length, group measured.
KINDS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
    ("pat", r"gh[opsur]_[A-Za-z0-9]{36,}", 40, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 64, 0),
]
BASE = ("assign", "access", "hex")
#: Owners from which on a value counts as a copied example.
SHARED_OWNERS = 3
#: Repositories from which on it counts as one even if a single owner holds them: a template copied along.
SHARED_REPOS = 10

#: A maximal run of at least the least length is what the plain pattern finds, and is found faster.
_FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
_COMPILED = [(kind, re.compile(_FAST.get(kind, p), re.A | (re.I if kind == "assign" else 0)), least, group) for kind, p, least, group in KINDS]
#: A cheap test that every match of the kind passes.
_NEEDS = {"assign": re.compile(r"[:=]"), "access": re.compile("AKIA"), "pat": re.compile("gh[opsur]_"), "jwt": re.compile("eyJ"), "pem": re.compile("-----BEGIN")}

FOUND = "array<struct<kind:string,start:int,end:int,value:string>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def find_secrets(text: str) -> list[dict]:
    """The spans of one text (code points, end exclusive) by start, then kind as listed; ``value`` is the hash of the secret part."""
    found = []
    for order, (kind, pattern, least, group) in enumerate(_COMPILED):
        if kind in _NEEDS and not _NEEDS[kind].search(text):
            continue
        for m in pattern.finditer(text):
            secret = m[group]
            if len(secret) >= least:
                found.append((m.start(), order, kind, m.end(), hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()))
    return [{"kind": kind, "start": start, "end": end, "value": value} for start, _, kind, end, value in sorted(found)]


def scan_texts(documents: DataFrame, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``documents`` without the text and with the spans of every whole text; a null text has none."""
    bound_batches(documents.sparkSession)
    rest = [c for c in documents.columns if c not in (text_col, found_col)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = pa.array([find_secrets(t) for t in texts_of(batch, text_col).to_pylist()], _FOUND_TYPE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found], [*rest, found_col])

    kept = documents.select(*rest, text_col)
    return kept.mapInArrow(scan, kept.select(*rest, F.lit(None).cast(FOUND).alias(found_col)).schema)


def ownership(found: DataFrame, repo_col: str, owner_col: str, shared_owners: int = SHARED_OWNERS, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """Per value hash: distinct repositories and owners, and whether it looks live: few owners hold it, in few repositories.

    Repeats within a repository are combined before the shuffle, so a value copied into a third of all rows
    costs one row per task and repository. A null repository or owner counts as one more, unnamed one.
    """
    values = found.select(F.explode("found.value").alias("value"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner")).distinct()
    owners = values.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")).withColumn("live", (F.col("n_owners") < shared_owners) & (F.col("n_repos") < shared_repos))


def scan_secrets(documents: DataFrame, repo_col: str = "source", owner_col: str = "source", text_col: str = "text", shared_owners: int = SHARED_OWNERS, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """One row per document: its other columns, ``found`` (spans with value hashes), ``n_live``, ``n_example``,
    ``most_repos`` and ``most_owners`` (columns of these names are replaced).

    ``n_live`` counts the spans whose value fewer than ``shared_owners`` owners hold in fewer than ``shared_repos``
    repositories, ``n_example`` the others; ``most_repos`` and ``most_owners`` are those of its most spread value.
    Null and empty texts give empty ``found`` and zeros; repeated rows stay repeated; an empty table stays empty.
    """
    added = ["n_live", "n_example", "most_repos", "most_owners"]
    documents = documents.drop("found", *added)
    (row,) = spare_names(documents, "row")
    found = cut_lineage(scan_texts(documents.withColumn(row, F.expr("uuid()")), text_col), "secrets_found")
    states = ownership(found, repo_col, owner_col, shared_owners, shared_repos)
    counts = found.select(row, F.explode("found.value").alias("value")).join(states, "value").groupBy(row).agg(
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_example"), F.max("n_repos").alias("most_repos"), F.max("n_owners").alias("most_owners"))
    return found.join(counts, row, "left").na.fill(0, added).drop(row)


def spans_text(found, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined; those of ``kinds`` only, if given."""
    kept = F.filter(found, lambda x: x["kind"].isin(*kinds)) if kinds else found
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_live(documents: DataFrame, repo_col: str = "source", owner_col: str = "source", text_col: str = "text", mask: str = "[secret]", shared_owners: int = SHARED_OWNERS, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """``documents`` with every live-looking span of the text replaced by ``mask``; nothing else changes.

    Rows, their number and all other columns stay. Overlapping live spans are masked as one. Null texts stay null.
    """
    digest = F.md5(F.col(text_col).cast("binary"))
    key, cut = spare_names(documents, "digest", "cuts")
    keyed = documents.withColumn(key, digest)
    found = cut_lineage(scan_texts(documents.select(digest.alias("digest"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text")).filter("text is not null")).filter(F.size("found") > 0), "secrets_found")
    live = ownership(found, "repo", "owner", shared_owners, shared_repos).filter("live").select("value")
    spans = found.select(F.col("digest").alias(key), F.explode("found").alias("s")).distinct().withColumn("value", F.col("s.value")).join(live, "value", "left_semi")
    cuts = spans.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end")))).alias(cut))
    # left to right: a span that begins within the last one lengthens it; substring() counts code points from 1
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, c: F.when(c["end"] <= a["at"], a).otherwise(F.struct(
        F.when((c["start"] < a["at"]) & (a["at"] > 0), a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, c["start"] - a["at"]), F.lit(mask))).alias("out"), c["end"].alias("at")))
    masked = F.aggregate(cut, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return keyed.join(cuts, key, "left").withColumn(text_col, F.when(F.col(cut).isNull(), text).otherwise(masked)).select(*documents.columns)
