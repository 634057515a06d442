"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .alignment import align_documents
from .common import table
from .decontaminate import leaks
from .exact_copies import exact_duplicates
from .exact_copies import oracle_sql as copies_sql
from .html_text import main_texts
from .near_text import near_duplicates
from .near_vectors import near_vectors
from .packing import pack, with_crc
from .ppm import language_scores
from .prefix_trie import oracle_sql as trie_sql
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .secrets import digest, scan
from .secrets import oracle_sql as secrets_sql
from .token_files import read_token_files, write_token_files
from .toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(pack(table(spark, sf_dir, "documents", "doc_id", "text")))


@register
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents", "doc_id", "text")))


@register
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@register
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


@register
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents", "doc_id", "text"))[0])


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op5_secrets"] = secrets_sql()
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@register
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


@register
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


@register
def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


ORACLES["op11_exact_duplicates"] = copies_sql()


@register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = trie_sql()


@register
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
