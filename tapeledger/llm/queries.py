"""Registered queries of the training-data operators and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm import cross_polytope, divergence, factor_machine, id_files, license_scan, line_crf, mixing, ngram_join, packing, secret_scan, simhash, url_filter, whitening
from tapeledger.session import cut_lineage

#: shares of the mixed tokens by domain of the labelled table
MIX_DOMAINS = {"clean": 0.90, "toxic": 0.05, "junk": 0.04, "junk_toxic": 0.01}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def domains_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of the labelled rows: clean or junk by quality, with or without ``toxic``."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return labels.filter("quality in (0, 1) and toxic in (0, 1)").select("doc_id", F.when(good & ~toxic, "clean").when(good, "toxic").when(~toxic, "junk").otherwise("junk_toxic").alias("domain"))


URL_SQL = r"""
WITH RECURSIVE base AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM base),
keyed AS (
  SELECT page_id, html, host, path, CASE WHEN rest = '' THEN NULL ELSE host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) END AS node FROM parts),
found AS (
  SELECT node, regexp_extract(regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical[^>]*>'), '(?is)href\s*=\s*["'']?([^"''\s>]*)', 1) AS target FROM keyed),
split AS (
  SELECT node, substr(target, instr(target, '://') + 3) AS rest FROM found WHERE instr(target, '://') > 0 AND node IS NOT NULL),
edge AS (
  SELECT DISTINCT node AS u, lower(regexp_extract(rest, '^([^/?#]*)', 1)) || CASE WHEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END
         || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS v FROM split),
both_ways AS (SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v),
reach AS (SELECT u AS a, u AS b FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON e.u = r.b),
rules(rule_host, rule_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ruled AS (
  SELECT node_host, node_path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host AS node_host, path AS node_path FROM keyed
        UNION SELECT DISTINCT regexp_extract(b, '^([^/?#]*)', 1), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM reach)
  JOIN rules ON (node_host = rule_host OR node_host LIKE '%.' || rule_host) AND starts_with(node_path, rule_path) GROUP BY 1, 2),
hit AS (
  SELECT DISTINCT a AS node FROM reach JOIN ruled ON regexp_extract(b, '^([^/?#]*)', 1) = node_host AND regexp_extract(b, '^[^/?#]*([^?#]*)', 1) = node_path WHERE action = 'block')
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hit.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM keyed LEFT JOIN ruled ON host = node_host AND path = node_path LEFT JOIN hit ON keyed.node = hit.node
"""


@query(URL_SQL)
def op8_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query()
def op6_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in secret_scan.BASE), F.sha2(secret_scan.spans_text(F.col("found"), secret_scan.BASE).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.spans_text(F.col("found")).alias("spans"), "n_live", "n_example", "most_repos", "most_owners")


@query()
def op9_quality_classifier(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = factor_machine.train(docs, table(spark, sf_dir, "labels").filter(~held_out), metadata=("n_chars",))
    scored = factor_machine.score_documents(docs.select("doc_id", "text", "n_chars"), model, metadata=("n_chars",))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op1_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train_domains(docs, domains_of(table(spark, sf_dir, "labels")), list(MIX_DOMAINS))
    mixed = mixing.mix(docs, model, MIX_DOMAINS, anchor="clean", keep_text=False)
    return mixed.select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)), "rate", "copies", "n_steps", "residual", "converged")


@query()
def op7_token_id_files(spark, sf_dir):
    return id_files.encode_corpus(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query()
def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


@query()
def op3_simhash(spark, sf_dir):
    prints = simhash.fingerprint_with_next(table(spark, sf_dir, "documents"))
    prints = cut_lineage(prints.withColumn("fp", F.conv("fingerprint", 16, -10).cast("long")), "simhash_prints")
    return prints.join(simhash.count_within(prints.select("fp")).select("fp", "n_near"), "fp").drop("fp")


@query()
def simhash_links(spark, sf_dir):
    """The near neighbours that ``n_near`` of ``op3_simhash`` counts, between its different fingerprints."""
    prints = simhash.fingerprint_with_next(table(spark, sf_dir, "documents")).select(F.conv("fingerprint", 16, -10).cast("long").alias("fp"))
    named = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return simhash.links_within(prints).select(named("fp").alias("fingerprint"), named("near_fp").alias("near_fingerprint"), "distance")


@query()
def op4_cross_polytope(spark, sf_dir):
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query()
def op5_license_scan(spark, sf_dir):
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_sort("licenses", lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).otherwise(F.when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(a["start"] - b["start"])))
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.try_element_at(best, F.lit(1))["license"].alias("license"), F.try_element_at(best, F.lit(1))["dice"].alias("dice"), spans.alias("spans"))


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
held AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM held GROUP BY ALL HAVING sum(docs) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
voc AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
total AS (
  SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS n FROM groups g LEFT JOIN (SELECT held.* FROM held SEMI JOIN kept USING (lang, term)) h USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (t.n + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN voc v USING (lang) JOIN total t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query(DIVERGENCE_SQL)
def op11_source_divergence(spark, sf_dir):
    return divergence.divergences(table(spark, sf_dir, "documents"))


@query()
def op12_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_crf.train_field(docs, table(spark, sf_dir, "labels"))
    return line_crf.label_lines(docs, field, keep_text=False).select("doc_id", *line_crf.STATS, "base_failed", "kept", "n_content_words", "line_labels")


@query()
def op13_embedding_whitening(spark, sf_dir):
    return whitening.component_rows(whitening.whiten(table(spark, sf_dir, "embeddings")))
