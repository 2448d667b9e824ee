"""A corpus run through the training-data operators, one stage after another.

Language ID drops what has no language, near-dedup keeps one document of each group, decontamination drops
what holds a benchmark passage, mixing repeats and drops documents towards the target weights of their
sources, and the last stage writes token ids into a store and returns what it reads back from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import decontaminate, entries, langid, mix, neardup, tokenstore
from tidebook.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.languages_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenstore.encoded(docs, entries.tokenizer_path())


STAGES = [
    ("language ID", language), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing), ("token-ID output", token_output),
]
#: SuperMinHash banding, a trained classifier and a tokenizer aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
