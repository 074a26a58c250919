"""The corpus pipeline: language ID, quality, near duplicates, packing.

Each stage takes what the one before kept. The first three drop documents and keep the columns of documents as they are;
the last returns the pieces of packed sequences. Nulls: a null text has no language and goes at the first stage; a null
id, language or source changes nothing. Repeated rows stay until near duplicates, which keep one row of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, neardup, packing, quality
from lodestone.llm.common import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or like no known language, go."""
    return langid.keep_known(docs, langid.fit_on_fold(docs), least=0.05)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; learned from the labels of the stage's own documents."""
    return quality.keep_good(docs, quality.fit_on_fold(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at a similarity of 0.8 of five-word shingles."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Learned models, MinHash and the tokenizer can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
