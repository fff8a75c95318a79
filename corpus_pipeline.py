"""A training corpus from raw documents: each stage takes all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftlight.llm import crf_langid, packing, rule_ledger, secret_scan, simhash
from siftlight.llm.common import shared_dir, table
from siftlight.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the labelled ones show go."""
    return crf_langid.keep_known(docs, crf_langid.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ledger.keep(docs, rule_ledger.POLICIES["v2"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose shingles of five words are alike by 0.8 or more count as copies."""
    return simhash.keep_distinct(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; ``n_chars`` follows the text."""
    from pyspark.sql import functions as F

    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: Groups of near copies, the language model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and
    read again, so that no stage's loss of executors reaches back beyond its input."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
