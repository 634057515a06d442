"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns it was given. Toxic documents go; of each group of near duplicates the
smallest doc_id stays; documents that hold benchmark items go; secrets are replaced by a mark and ``n_chars`` follows;
what is left is packed. Null and empty texts, repeated rows, empty tables and extra columns have the results that the
operators define. The second and third stage decide by row, not by doc_id: rows are the same only if doc_id (null is one value) and
text are equal, and of those one row stays after the second stage. Rows without a doc_id come after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm.common import stored, table
from cellframe.llm.decontaminate import leaks
from cellframe.llm.near_text import near_duplicates
from cellframe.llm.packing import pack, with_crc
from cellframe.llm.secrets import redact, scan
from cellframe.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``__key``, the sha256 of doc_id and text, and ``__node``, 64 bits of it for operators that take numbers."""
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "?").otherwise(":"), F.coalesce("text", F.lit("")))
    return docs.withColumn("__key", F.sha2(said, 256)).withColumn("__node", F.xxhash64("__key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = near_duplicates(keyed.select(F.col("__node").alias("doc_id"), "text")).select(F.col("doc_id").alias("__node"), "component_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    kept = keyed.select("doc_id", "__key", "__node").distinct().join(found, "__node").groupBy("component_id").agg(F.min_by("__key", rank).alias("__key"))
    # one row for equal doc_id and text: the one whose other columns come first
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    sortable = F.struct(*[f.name for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()], F.lit(0))
    own = keyed.groupBy("__key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min_by(rest, sortable).alias("__rest"))
    return own.join(kept, "__key", "left_semi").select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = leaks(keyed.select(F.col("__node").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__node")).distinct()
    return keyed.join(found, "__node", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned, _ = scan(docs, address="__address", spans="__spans")
    clean = redact(scanned, spans="__spans")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_crc(pack(docs))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
