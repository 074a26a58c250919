"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, fit_on_fold

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_on_fold(docs, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_on_fold, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_on_fold(docs))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    return judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 24)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"))


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import link

    return link(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exacttopk import search

    return search(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .sql import EXACT_TOPK, HOST_RULES, IMPORTANCE, NEAR_DUPLICATES, PREFIX_TRIE

    return {"op4_near_duplicates": NEAR_DUPLICATES, "op6_host_rules": HOST_RULES, "op11_exact_topk": EXACT_TOPK, "op12_prefix_trie": PREFIX_TRIE, "op13_importance": IMPORTANCE}
