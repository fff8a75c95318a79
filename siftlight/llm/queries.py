"""The registered queries of the training-data operators: each applies its operator, with
production parameters, to the whole of its table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.llm import (
    bpe_tree, cm_coder, conversation_trie, crf_langid, hard_negatives, hyper_shard, lattice_lm, license_scan, oracles, packing, rule_ledger, secret_scan, simhash, winnow,
)
from siftlight.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_union("base_labels", F.transform("matches", lambda m: m["label"]))
    return found.select(
        "doc_id", "n_words", F.size("base_words").cast("long").alias("n_base"),
        F.array_min("base_words").alias("first_word"), F.array_max("base_words").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), "score",
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("found")).alias("spans"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_tree.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_langid.identify(docs, crf_langid.fit(docs))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hyper_shard.shuffle_into_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm_coder.write_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents")), rule_ledger.POLICIES["v2"])
    base = F.col("failed").bitwiseAND(F.lit(rule_ledger.POLICIES["base"].mask)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edits(table(spark, sf_dir, "documents"))


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.with_shared_heads(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_packing, op2_license_scans, op3_secret_scans, op4_simhash, op5_bpe_tree, op6_language_id, op7_sharding, op8_token_files, op9_quality_rules,
        op10_fingerprints, op11_lattice_lm, op12_hard_negatives, op13_conversation_trie,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scans": oracles.secret_scans(), "op9_quality_rules": oracles.quality_rules(), "op12_hard_negatives": oracles.hard_negatives()}
