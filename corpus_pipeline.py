"""A training corpus from documents: language, repeated lines, near copies, repeated passages, packing.

Each stage works on all documents that the stage before kept, as written; all but the last return the columns
of documents. ORACLE_SQL is None: SQL has no context trees, fingerprints or tokenizers; the stages are tested
against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import language, lines, packing, simhash_sets, substrings
from tallyforge.llm.catalog import BYTE_VOCABULARY
from tallyforge.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and Jaccard similarity of the near-duplicate stage.
SHINGLE, SIMILARITY = 5, 0.8


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; null texts and texts without a letter, which have none, go.

    Where no row tells a language to learn from, lang stays as it is.
    """
    docs = docs.select(*COLUMNS)
    model = language.fitted(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = language.predicted(docs, model, COLUMNS).filter(F.col("lang_pred") != language.UNDETERMINED)
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id has go; the documents stay."""
    return _counted(lines.deduplicated(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near copies the document with the smallest id stays."""
    return simhash_sets.deduplicated(docs.select(*COLUMNS), SHINGLE, SIMILARITY)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 50 that a document with a smaller id has go; the documents stay."""
    return _counted(substrings.deduplicated(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, BYTE_VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("passages", drop_repeated_passages),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
