"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm import decontaminate, line_suffixes, packing, quality_qda, simhash_similar
from quernstone.llm.common import read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go, each by its own text: null and repeated ids, nulls and extra columns need no rule."""
    return quality_qda.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document of which nothing is left goes. n_chars follows the text.

    Null text stays; null doc_id comes last; rows equal in doc_id and text are one document. A column n_lines or n_deleted of docs gets the counts."""
    cleaned = line_suffixes.dedup_lines(docs).filter("not (n_deleted > 0 and text = '')")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity of at least 0.8) stays, the one with the smallest doc_id.

    Rows are told apart by content: different texts of one doc_id, or without, are documents of their own (null doc_id last)."""
    return simhash_similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a benchmark item leaks into go, each by its own text: null and repeated ids, nulls and extra columns need no rule."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. Null text: empty; each row is a document of its own."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
#: Classifier, similarity search and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
