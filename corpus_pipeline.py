"""The corpus pipeline: quality, near duplicates, secrets, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` applies them to ``documents``; each stage's rows are stored before the next stage reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm import factor_machine, mixing, ngram_join, packing, secret_scan
from tapeledger.llm.queries import domains_of, table, tokenizer
from tapeledger.session import cut_lineage

#: Documents scored lower are rejected.
LEAST_QUALITY = 0.7
#: Shares of the mixed tokens. The clean domain keeps its own amount. Rates are at most 1 here: nothing is doubled.
SHARES = {"clean": 0.998, "toxic": 0.002, "junk": 0.0, "junk_toxic": 0.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier takes for quality 1; it is fitted on the labelled documents."""
    model = factor_machine.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return factor_machine.score_documents(docs, model, score_col="_score").filter(F.col("_score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest ``doc_id`` of each group."""
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the values that look live; ``n_chars`` follows the text."""
    masked = secret_scan.redact_live(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin the documents to the target shares: by their rates, and once if they are likeliest clean.

    Null and empty texts are taken by their rate like others, repeated rows alike; an empty table stays empty.
    """
    model = mixing.train_domains(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), list(SHARES))
    return mixing.mixed_corpus(docs, model, SHARES, anchor="clean", keep=("clean",), most=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("secret_scans", secrets), ("mixing", mixture), ("packing", pack)]
#: The stages fit models and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, name)
    return docs
