"""Five stages that clean and pack the documents table; each one's rows are written and read again by the next.

All stages but the last return COLUMNS, those of the documents table; other columns of their input are left out, so none can
clash with names that operators use. Rows with null or empty texts, equal and repeated rows are judged like any other; rows without a
doc_id pass the deduplicating stages, as no other row can stand for them. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeworks.llm.common import table, written
from galeworks.llm.entries import BYTE_BPE, vocabulary
from galeworks.llm.exact import dedup_exact
from galeworks.llm.minhash import near_duplicates
from galeworks.llm.packing import pack_documents
from galeworks.llm.quality import fit_quality, keep_good
from galeworks.llm.secrets import redact

#: Columns of documents, kept by every stage but the last.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject."""
    return keep_good(docs.select(*COLUMNS), fit_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id."""
    return _only_kept(docs, dedup_exact(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): the one with the smallest doc_id."""
    return _only_kept(docs, near_duplicates(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced, and n_chars follows the text."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and the sequences that they fill."""
    return pack_documents(docs, vocabulary(BYTE_BPE))


def _only_kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of docs that judged keeps; the ids are unique in documents, and rows without one are kept."""
    gone = judged.where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("gone"), "left_anti")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("secret scan", secrets), ("packing", packing)]

#: SQL cannot express the classifier and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage{k}") if k < len(STAGES) - 1 else docs
    return docs
