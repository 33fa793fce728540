"""Registered queries of the operators, ``opN_<name>(spark, sf_dir)``, and their
DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (ann, collocations, embed_dedup, html_extract, langid, merkle, mixing, ngram_join, pii, sentencepiece,
                         sharding, substring_dedup, wavelet)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    found = langid.identify_language(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.near_duplicate_passages(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows.where("vec_id % 100 = 0"), rows, k=10)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), sharding.SHARD_LIMIT)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"), tampered=tampered)


def op12_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_substring_dedup, op3_pii, op4_ngram_jaccard_join, op5_html_extraction, op6_nearest_neighbours,
        op7_sentencepiece, op8_sharding, op9_embedding_dedup, op10_mixing, op11_merkle_manifest, op12_wavelet_tokens, op13_phrase_collocations)}

ORACLE: dict[str, str] = {"op6_nearest_neighbours": ann.ANN_SQL, "op8_sharding": sharding.SHARDING_SQL,
                          "op11_merkle_manifest": merkle.MERKLE_SQL,
                          "op13_phrase_collocations": collocations.COLLOCATIONS_SQL}
