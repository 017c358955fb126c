"""Registered queries of this subpackage; each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prismcube.llm import bpe, embed_dedup, licenses, media, near_dedup, packing, suffix_dedup, toxicity, urls, word_dedup
from prismcube.llm.common import importable
from prismcube.llm.sql import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes_digest(table(spark, sf_dir, "documents"))


#: The rules that the registered url query judges by.
RULES = [urls.Rule.of("allow", "com/"), urls.Rule.of("block", "example.com/en/"), urls.Rule.of("allow", "www.example.com/en/"), urls.Rule.of("block", "net/es/"), urls.Rule.of("block", "net/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` drawn as an image: near vectors are edited copies."""
    return media.image_copies(media.drawn(table(spark, sf_dir, "embeddings")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup.repeated_words_digest(table(spark, sf_dir, "documents"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_near_dedup": op3_near_dedup,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_media": op6_media,
    "op7_bpe": op7_bpe,
    "op8_word_dedup": op8_word_dedup,
    "op9_embed_dedup": op9_embed_dedup,
    "op10_packing": op10_packing,
}

__all__ = ["QUERIES", "SQL"]
