"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, chat, contamination, cotrain, lm, quality, sharding, simhash, substring, suffix
from quern.llm.common import table
from quern.llm.oracles import ORACLES
from quern.sources.shared import new_folder


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.transform("mask", lambda r: F.concat(r.n.cast("string"), F.when(r.train, "t").otherwise("-")))
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumns({"mask": F.array_join(runs, " "), "piece": F.array_join("piece", "/")})


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", "n_near")


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), order=3)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.records(table(spark, sf_dir, "documents"))
    loads = sharding.slot_bytes(found)
    maps = new_folder(spark)
    sharding.save_map(spark, maps, sharding.build_map(loads), 1)
    _, slot_map = sharding.load_map(spark, maps)
    out = sharding.assign(found, slot_map, loads)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_rotation": op1_chat_rotation,
        "op2_quality_rules": op2_quality_rules,
        "op3_decontamination": op3_decontamination,
        "op4_cotraining": op4_cotraining,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_bpe": op6_bpe,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_simhash": op8_simhash,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
