"""The queries of this subpackage by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import align, ann, bpe, conversations, decontaminate, language_id, line_dedup, lm_score, near_dup, pii, planes, quality, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.predict(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), 2)


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(every), every)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


OPERATORS = (
    op1_line_dedup,
    op2_decontaminate,
    op3_language_id,
    op4_ann_search,
    op5_token_counts,
    op6_lm_score,
    op7_byte_bpe,
    op8_near_dedup,
    op9_token_planes,
    op10_quality,
    op11_conversation_repair,
    op12_token_alignment,
    op13_personal_data,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict:
    return {"op1_line_dedup": line_dedup.SQL, "op2_decontaminate": decontaminate.SQL}
