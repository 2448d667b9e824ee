"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import decontaminate, langid, licenses, lines, mix, neardup, pii, quality, resample, substrings, tokenstore, turns, urls
from tidebook.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row", "text_hash")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.train(docs))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).drop("row")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.rules(spark))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents")).drop("component")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents")).drop("row")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.encoded(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turns.repair_report(turns.damaged(rows), rows)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_decontamination": op1_decontamination, "op2_suffix_dedup": op2_suffix_dedup, "op3_language_id": op3_language_id, "op4_mix": op4_mix, "op5_license_scan": op5_license_scan, "op6_url_filter": op6_url_filter, "op7_near_dedup": op7_near_dedup, "op8_quality_rules": op8_quality_rules, "op9_pii": op9_pii, "op10_token_store": op10_token_store, "op11_conversation_repair": op11_conversation_repair, "op12_line_dedup": op12_line_dedup, "op13_importance_resampling": op13_importance_resampling}
ORACLES = {"op1_decontamination": decontaminate.ORACLE, "op6_url_filter": urls.oracle(), "op8_quality_rules": quality.oracle(), "op12_line_dedup": lines.ORACLE}
