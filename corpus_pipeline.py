"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder as Parquet and reads it
again, so a lost executor never repeats an earlier stage. All but the last return the columns of documents, whatever further columns there
are. Repeated rows count as often as they come, ties go to the smaller id, and an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import common
from mercato.llm.language import keep_identified
from mercato.llm.minhash import near_duplicates
from mercato.llm.packing import pack_documents
from mercato.llm.quality import keep_good
from mercato.llm.suffix_dedup import cut_rows

#: EM and merged n-gram models, hashes and packing have no SQL form; tests hold near_dedup, suffix_dedup and the packing of ``run`` against
#: brute force, the two stages before against the verdicts of their operators.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the weighed rules reject go. A null or empty text has no words and fails the base test."""
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a language that holds half of their words go; null texts have no letters."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Documents without words and those with a null id link with nothing and stay. Rows that share the kept id stay together.
    """
    name = common.unused(docs, "_kept_id")
    kept = near_duplicates(docs, percent=80).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name))).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that an earlier document has are cut out; a text cut to nothing is empty.

    A cut within a character leaves the bytes of a part of it, which are dropped; U+FFFD of the text itself stays. n_chars is counted again.
    Equal rows are one document and stay equal; different texts of one id are documents of their own.
    """
    put = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return cut_rows(docs, decode=True).select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 2048 ids. A null or empty text is its end id."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return docs
