"""The corpus pipeline: five stages from raw documents to a mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontamination, mixing, neardup, pii, quality
from weftline.llm.storage import removed, shared_dir

#: Jaccard similarity, in percent, from which documents count as near duplicates.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go. Null and empty texts fail the rules, so
    those rows go; a null source is a host like others; repeated rows are judged each. An empty table
    stays empty."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; of repeated rows
    one. Rows with a null id or without words are in no group and stay."""
    return neardup.one_of_each(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go. Null and empty texts have none and stay; without items all stay."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data in the texts gives way to surrogates; n_chars follows the new text where it changes.
    Null and empty texts stay as they are, and so does every row."""
    return pii.pseudonymised(docs, pii.key_of(spark), length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, by its source's target. Null texts have size 0; a
    null source is one of its own; rows that tie in id and size exchange their shares only."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("private data", private_data),
    ("mixing", mix_sources),
]

#: Several stages can't be put in SQL (permutations, keyed surrogates); tests hold them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
    return docs
