"""Tag events, tallies and the tile index kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pool, ranking
from ..operators.tags import fold_tag_events
from ..sources.tile_store import read_partitions, replace_partitions, write_partitions


def tag_states(events: DataFrame) -> DataFrame:
    """Streaming twin of ``fold_tag_events``, which is the very same expression.

    State is two small records per tile, pre-aggregated in each map task, so a
    tile with a burst of events costs no more than any other. Use output mode
    ``complete``; for ``update`` keep ``tag_state_records`` and settle on read,
    since a tile whose tag was cleared has no row here to say so.
    """
    return fold_tag_events(events)


def tag_state_records(events: DataFrame) -> DataFrame:
    """(tile, last human event, last model event), for update mode."""
    at = F.struct("ts", "event_id", "category", "confidence")
    return events.groupBy("tile").agg(
        F.max(F.when(F.col("actor") == "human", at)).alias("h"),
        F.max(F.when(F.col("actor") == "ai", at)).alias("a"),
    )


def start_tag_table(events: DataFrame, path: str, checkpoint: str, buckets: int = 256, **trigger):
    """Keep a table of tag states: each micro-batch rewrites only the hash buckets it touches."""
    spark = events.sparkSession

    def merge(batch: DataFrame, _epoch: int):
        changed = batch.withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(buckets)).cast("int"))
        merge_states(spark, changed, path)

    writer = tag_state_records(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(merge).trigger(**(trigger or {"availableNow": True})).start()


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``; None before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merge_states(spark: SparkSession, changed: DataFrame, path: str) -> None:
    stored = _stored(spark, path, changed.schema)
    if stored is None:
        write_partitions(changed, path, ["tile"], by=("bucket",))
        return
    touched = changed.select("bucket").distinct()
    # At most as many rows as there are buckets.
    old = stored.join(F.broadcast(touched), "bucket", "left_semi")
    kept = old.join(changed.select("tile"), "tile", "left_anti")
    replace_partitions(kept.select(*changed.columns).unionByName(changed), path, ["tile"], by=("bucket",))


def start_tally_refresh(
    spark: SparkSession, tags_path: str, tiles_path: str, out_path: str, checkpoint: str, tag_schema, tile_schema, **trigger
):
    """Re-count only the fields of view whose tag files are new since the last run.

    A field whose tags were all cleared is among them when it was written as
    touched (``write_partitions``). Read the tallies with ``read_partitions``
    and key ``n_tiles``: a field without tiles any more has none.
    """
    arrivals = spark.readStream.schema(tag_schema).parquet(tags_path).select("project", "fov_id")

    def refresh(batch: DataFrame, _epoch: int):
        fovs = batch.distinct()
        tiles = read_partitions(spark, tiles_path, tile_schema, "cell_id").join(fovs, ["project", "fov_id"], "left_semi")
        tags = read_partitions(spark, tags_path, tag_schema, "cell_id").join(fovs, ["project", "fov_id"], "left_semi")
        write_partitions(pool.fov_tally(tiles, tags), out_path, [], touched=fovs)

    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(refresh)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_index_growth(records: DataFrame, index_path: str, checkpoint: str, export: str | None, **trigger):
    """Upsert the tile index as fields of view finish; replaying a batch changes nothing.

    ``records`` streams rows of the index, which is partitioned by field of
    view. ``export`` names a whole-number column that grows with each export of
    a field (NULL counts as 0): rows of one export add up over any number of
    micro-batches, a newer export replaces older ones, and late rows of an older
    one are left out. An export without cells is one row with a NULL ``cell_id``;
    read the index with ``read_partitions`` and key ``cell_id``.

    With ``export=None``, which a caller has to say, each batch replaces the fields it names, so a field must
    arrive in one batch.
    """
    spark = records.sparkSession

    def replace(batch: DataFrame, _epoch: int):
        new = ranking.keep_last(batch, ["cell_id"], ["label", "fov_id", "crop_path"])
        write_partitions(new, index_path, ["label"], by=("fov_id",))

    def merge(batch: DataFrame, _epoch: int):
        rows = batch.withColumn(export, F.coalesce(F.col(export).cast("long"), F.lit(0).cast("long")))
        before = _stored(spark, index_path, rows.schema)
        if before is not None:
            named = batch.select("fov_id").distinct()
            rows = before.join(named, "fov_id", "left_semi").select(*rows.columns).unionByName(rows)
        newest = rows.groupBy("fov_id").agg(F.max(export).alias(export))
        current = rows.where("cell_id is not null").join(newest, ["fov_id", export], "left_semi")
        now = ranking.keep_last(current, ["cell_id"], ["label", "fov_id", "crop_path"])
        replace_partitions(now, index_path, ["label"], by=("fov_id",), touched=newest)

    upsert = merge if export else replace

    return (
        records.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(upsert)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
