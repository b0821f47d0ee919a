"""The operators over their whole tables, as queries, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, language, lines, middle, packing, shards, simhash, substrings, topk, toxicity, vectors, warc, whitening
from tallyforge.llm.common import table

#: Vocabulary files; every executor has them.
WORD_VOCABULARY = os.environ.get("WORD_VOCABULARY", public_tokenizers.path("word_bpe_49k.json"))
BYTE_VOCABULARY = os.environ.get("BYTE_VOCABULARY", public_tokenizers.path("byte_bpe_50k.json"))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(table(spark, sf_dir, "embeddings"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), WORD_VOCABULARY, digests_only=True)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op7_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed whole, under limits on tokens, segments and the assistant's tokens."""
    return packing.packed_examples(packing.instruction_sizes(table(spark, sf_dir, "conversations"), BYTE_VOCABULARY))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.manifest(table(spark, sf_dir, "documents"), shards.balanced(shards.SHARDS))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substrings, op2_embeddings, op3_lines, op4_warc, op5_bpe, op6_topk, op7_packing, op7_instructions, op8_simhash, op9_toxicity, op10_language, op11_whitening, op12_middle, op13_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": lines.sql(), "op4_warc": warc.sql(), "op6_topk": topk.sql(), "op12_middle": middle.sql(), "op13_shards": shards.sql()}
