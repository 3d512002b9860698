"""Cleaning documents for training: stages over whole tables, each written before the next.

Stages take the columns of documents and drop others, also such that bear names the operators use. In any
of them a row with a null id is a row like others, a null or empty text is clean, and an empty table gives
an empty one. Rows that are repeated stay repeated, but for the near-copies stage, which keeps one row of
each group: the one with the smallest id, of equal ids the first, of null ids the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagewell.llm import bpe, common, decontam, registry, secrets, simhash, toxicity

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = "[SECRET]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose expected severity stays below the rejection mark."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_clean(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each SimHash group."""
    return simhash.keep_first(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window of a benchmark item."""
    return decontam.filter_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets found in every document; all documents stay."""
    return secrets.mask_secrets(docs.select(*COLUMNS), MASK)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode_decode(docs, registry.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("bpe", encode_tokens)]

#: The stages hold models and hashes that SQL has no functions for; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
