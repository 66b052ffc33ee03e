"""The queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import chat_snapshots, decontaminate, html_layout, line_suffixes, packing, quality_qda, secret_index, simhash_vptree, toxicity_zstd, winnowing
from quernstone.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "group_size")


QUERIES["op1_simhash_vptree"] = op1_simhash_vptree


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_pairs(read(spark, sf_dir, "documents"))


QUERIES |= {"op8_best_fit_packing": op8_best_fit_packing, "op9_winnowing": op9_winnowing}


def op5_secret_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_index.report(read(spark, sf_dir, "documents"))


QUERIES["op5_secret_trigram_index"] = op5_secret_trigram_index


def op10_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_suffixes.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op10_line_suffixes"] = op10_line_suffixes


def op6_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES["op6_decontaminate_cgk"] = op6_decontaminate_cgk


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op4_quality_qda"] = op4_quality_qda


def op7_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_zstd.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op7_toxicity_zstd"] = op7_toxicity_zstd


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.collapse(read(spark, sf_dir, "conversations"))


QUERIES["op2_chat_snapshots"] = op2_chat_snapshots
ORACLE_SQL["op2_chat_snapshots"] = chat_snapshots.ORACLE_SQL


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(read(spark, sf_dir, "pages"))


QUERIES["op3_html_layout"] = op3_html_layout
