"""Exact duplicates by a stream whose keyed state never expires.

A file stream reads the table in micro-batches. Its keyed state lies on disk (RocksDB, checkpointed to the shared
folder) and holds one entry per digest of a normalised text: the digest, the stable identifier and the locator (file and
row number) of the row that stays, and the number of rows. Entries are minima and counts, so they combine before the
shuffle and a text that a third of all rows share costs no more than any other. A later run over the same state reads
only files it has not seen.

The state alone never decides. A digest met more than once is a hit: the content its locator points to is fetched, and
the whole bytes of every row of that digest are compared with it. Rows of a digest under which two contents met are
grouped anew by their full texts. Texts move once for the fetch and once for the comparison; both are plain joins of
two shuffled sides, which adaptive execution splits where one key is hot.

Defined results: a null text is empty, and empty texts (after white space is taken out) are one group; of equal texts
the row with the most code points stays, then the smallest doc_id (null after all others), then file and row number, so
of repeated rows one is kept; a null doc_id that stays gives a null ``keep_id``; an empty table gives no rows; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import WORD_SEPARATORS, stored

#: The store of the state, and the memory that all state on one executor shares.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``sha`` (hex), ``digest``, ``rank`` (least stays; holds doc_id and locator) and ``body``, the normalised text."""
    text = F.coalesce(docs["text"], F.lit(""))
    place = docs.metadataColumn("_metadata")
    rank = F.struct(
        (-F.length(text)).alias("longest"), docs["doc_id"].isNull().alias("nameless"), docs["doc_id"].alias("doc_id"),
        F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"),
    )
    body = F.regexp_replace(text, WORD_SEPARATORS, "")
    rows = docs.select(rank.alias("rank"), body.alias("body")).withColumn("sha", F.sha2(F.col("body").cast("binary"), 256))
    return rows.withColumn("digest", digest(F.col("sha")))


def update_state(spark: SparkSession, path: str, state: str, batch_bytes: int, digest: Callable[[Column], Column] = F.unhex) -> DataFrame:
    """Stream the files not yet seen into the state and return it: ``digest``, ``rank`` of the row that stays, ``n``."""
    one = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be a single file; a stream takes plain paths for folders
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(one)
    entries = _rows(stream, digest).groupBy("digest").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, STATE_STORE):
        query = entries.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        held = spark.read.format("statestore").load(state)
    return held.select("key.digest", F.col("value")["min"].alias("rank"), F.col("value")["count"].alias("n"))


def exact_duplicates(
    spark: SparkSession, path: str, state: str | None = None, batches: int = 2, batch_bytes: int | None = None, digest: Callable[[Column], Column] = F.unhex
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row of a Parquet table.

    ``state`` is the folder of the keyed state, a fresh one in the scratch folder if none is given. ``batch_bytes`` bounds
    a micro-batch (whole files, one at least); by default the input is cut into about ``batches`` of them, so that a lost
    driver repeats no more than one. ``digest`` makes the key of the state from the hex digest.
    """
    path = path.rstrip("/")
    docs = spark.read.parquet(path)
    if batch_bytes is None:
        place = docs.metadataColumn("_metadata")
        files = docs.select(place["file_path"].alias("file"), place["file_size"].alias("size")).distinct()
        batch_bytes = max(1, (files.agg(F.sum("size")).first()[0] or 0) // batches + 1)
    held = stored(update_state(spark, path, state or scratch_dir(spark, "copies-state"), batch_bytes, digest), "copies-held")

    rows = _rows(docs, digest)
    hits = held.where("n > 1").select(F.col("rank.file").alias("file"), F.col("rank.row").alias("row"), "digest", "rank", "n")
    fetched = rows.select(F.col("rank.file").alias("file"), F.col("rank.row").alias("row"), "body").join(hits, ["file", "row"])
    contents = stored(fetched.select("digest", F.col("rank").alias("best"), "n", F.col("body").alias("content")), "copies-content")
    once = held.where("n = 1").select("digest", F.col("rank").alias("best"), "n", F.lit(None).cast("string").alias("content"))

    compared = rows.join(contents.unionByName(once), "digest", "left")
    same = F.col("content").isNull() | (F.col("content") == F.col("body"))
    checked = stored(compared.select("rank", "best", "n", "sha", "digest", same.alias("same")), "copies-checked")
    mixed = checked.where(~F.col("same")).select("digest").distinct()
    if not mixed.limit(1).count():
        return _result(checked)
    mixed = stored(mixed, "copies-mixed")
    apart = rows.join(mixed, "digest", "left_semi")
    groups = apart.groupBy("body").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))
    return _result(checked.join(mixed, "digest", "left_anti")).unionByName(_result(apart.join(groups, "body")))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("rank.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL, over doc_ids that occur once."""
    return r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
        FROM d WINDOW best AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)"""
