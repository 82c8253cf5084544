"""A corpus pipeline over the documents table: five stages, each written as Parquet and read again by the next.

The stages, in order: language identification (texts without a language go), line dedup (runs of 50 words
or more that occurred before are cut), near-duplicate removal (five-word shingles at 0.8; one document of each
group stays), benchmark decontamination, and byte-level BPE ids. Each takes all that the one before it kept.
A null or blank text has no language and ends at the first stage; null keys, ties and repeated rows are handled
as the operators say. All stages but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import bpe, decontaminate, language_id, line_dedup, near_dup
from recordmill.llm.shared import materialize

#: A text stays if one language has this share of its letters.
LANGUAGE_SHARE = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"

#: The last stage's ids are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language has most letters; the model is fitted on their own labels."""
    found = language_id.label(docs, language_id.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines, n_chars with them; documents of which nothing is left go."""
    found = line_dedup.line_dedup(docs)
    found = found.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n\f\x0b")) != ""))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest key, null keys last; of equal rows, any one."""
    return near_dup.one_of_each(docs, 5)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves. A null text, or one without words, has no hits and stays; null items
    take no part; repeated rows are each judged."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items).where(~F.col("contaminated")).select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source as far as they are there, n_tokens, ids, and whether the ids decode to the text's bytes.

    A null text has no ids and decodes to no bytes; a row with a null key is encoded like any other.
    """
    found = bpe.encode(docs, public_tokenizers.path(RANKS))
    return found.select(*(c for c in ("doc_id", "lang", "source") if c in docs.columns), F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", cut_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate_documents),
    ("byte_bpe", encode_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
