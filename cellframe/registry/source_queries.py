"""Round trips through files, and JSON records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tags import settle_tag_state
from ..schemas import TAGS, TILE_INDEX
from ..session import scratch_dir
from ..sources import json_meta, manifest, tags_text, tile_store
from ..streaming import jobs
from .core import REGISTRY, Views, query, r6

KEY = ["project", "fov_id", "cell_id"]


@query(
    "tags_text_roundtrip",
    """SELECT project, fov_id, cell_id, category, round(confidence, 4) AS confidence FROM fx_tags
       WHERE fov_id <> 'src3'""",
)
def _(v: Views):
    # All tags are written; then those of one field are cleared and it is written again.
    path = scratch_dir(v.spark, "tags")
    tags_text.write_tags(v.tags, path)
    cleared = v.tags.where("fov_id = 'src3'")
    tags_text.write_tags(cleared.where("false"), path, touched=cleared)
    return tags_text.read_tags(v.spark, path).withColumn("confidence", F.round("confidence", 4))


@query(
    "parse_tag_lines",
    """WITH e AS (SELECT user_id % 7 AS p, user_id, event_id, event_type, value FROM events WHERE event_type <> 'error'),
       l AS (SELECT p, user_id, arg_max(event_type, event_id) AS category FROM e GROUP BY 1, 2),
       c AS (SELECT p, user_id, arg_max(round(value / 990, 4), event_id) AS confidence FROM e WHERE event_type IN ('view', 'click') AND event_id % 5 > 0 GROUP BY 1, 2)
       SELECT concat('p', l.p) AS project, 'f' AS fov_id, concat('c', l.user_id) AS cell_id, category, confidence FROM l LEFT JOIN c USING (user_id)""",
)
def _(v: Views):
    e = v.table("events")
    cell = F.concat(F.lit("c"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".tif").otherwise(""))
    number = F.when(F.col("event_id") % 5 > 0, F.format_string("%.4f", F.col("value") / 990)).otherwise("n/a")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("# note\t"), "event_type"))
        .when(F.col("event_type").isin("view", "click"), F.concat_ws("\t", cell, "event_type", number))
        .otherwise(F.concat_ws("\t", cell, "event_type"))
    )
    lines = e.select(
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"),
        F.lit("f").alias("fov_id"),
        line.alias("value"),
        F.col("event_id").alias("at"),
    )
    return tags_text.parse_tag_lines(lines).withColumn("confidence", F.round("confidence", 4))


@query(
    "vocab_roundtrip",
    """SELECT concat('n', n_regionkey) AS project, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position, n_name AS category FROM nation""",
)
def _(v: Views):
    path = scratch_dir(v.spark, "vocab")
    n = v.table("nation").select(
        F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("project"), F.col("n_nationkey").alias("position"),
        F.concat(F.lit(" "), F.col("n_name")).alias("category"),
    )
    notes = n.select("project", (F.col("position") + 1000).alias("position"), F.lit("# note").alias("category"))
    tags_text.write_vocab(n.unionByName(notes), path)
    return tags_text.read_vocab(v.spark, path)


@query(
    "tile_index_roundtrip",
    """SELECT cell_id, CAST(label % 20 AS VARCHAR) AS fov_id, label, concat('t/', cell_id) AS crop_path FROM fx_tiles""",
)
def _(v: Views):
    path = scratch_dir(v.spark, "index")
    rows = v.tiles.select(
        "cell_id", (F.col("label") % 20).cast("string").alias("fov_id"), "label", F.concat(F.lit("t/"), "cell_id", F.lit(".tif")).alias("crop_path")
    )
    tile_store.write_tile_index(rows, path)
    return tile_store.read_tile_index(v.spark, path)


@query(
    "report_roundtrip",
    """SELECT cell_id, category, CAST(confidence AS VARCHAR) AS confidence FROM (SELECT cell_id, category, printf('%.4f', confidence) AS confidence FROM fx_tags)""",
)
def _(v: Views):
    path = scratch_dir(v.spark, "report")
    shown = F.when(F.col("confidence").isNotNull(), F.format_string("%.4f", "confidence")).alias("confidence")
    tile_store.write_report(v.tags.select("cell_id", "category", shown), path)
    return v.spark.read.schema("cell_id string, category string, confidence string").option("header", True).csv(path)


@query(
    "tile_store_roundtrip",
    """SELECT project, fov_id, cell_id, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM fx_vecs
       WHERE (vec_id % 20 <> 3 OR vec_id % 40 = 3) AND fov_id <> 'src4'""",
)
def _(v: Views):
    # All rows are written; one field is thinned out, another one emptied.
    path = scratch_dir(v.spark, "tiles")
    rows = v.vecs.select(*KEY, "vec_id", "embedding")
    tile_store.write_partitions(rows, path, ["vec_id"])
    again = v.spark.read.schema(rows.schema).parquet(path).where("fov_id = 'src3' and vec_id % 40 = 3")
    tile_store.replace_partitions(again, path, ["vec_id"])
    emptied = v.spark.read.schema(rows.schema).parquet(path).where("fov_id = 'src4'")
    tile_store.replace_partitions(emptied.where("false"), path, ["vec_id"], touched=emptied.select("project", "fov_id"))
    back = tile_store.read_tiles(v.spark, path, rows.schema, key="vec_id")
    return back.select(*KEY, "vec_id", r6(F.get("embedding", F.lit(0))).alias("first"))


@query(
    "load_configs",
    """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'unreadable' ELSE 'ok' END AS status,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 2 = 0 THEN c_mktsegment ELSE '*.ims' END AS raw_pattern,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 3 = 0 THEN CAST(c_nationkey AS BIGINT) ELSE 64 END AS tile_size,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 3 = 0 THEN round(c_acctbal, 6) ELSE 0.1 END AS contrast_lo_pct,
         CAST(CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 3 = 0 AND c_custkey % 17 <> 0 THEN 77 ELSE 50 END AS BIGINT) AS num_iter, CAST(99.9 AS DOUBLE) AS contrast_hi_pct, '2,2' AS poly_degree
       FROM customer""",
)
def _(v: Views):
    k = F.col("c_custkey")
    js = F.to_json(F.struct(
        F.when(k % 2 == 0, F.col("c_mktsegment")).alias("raw_pattern"),
        F.when(k % 3 == 0, F.struct(F.col("c_nationkey").alias("size"), F.col("c_acctbal").cast("string").alias("contrast_lo_pct"))).alias("tile_params"),
        F.struct(F.when(k % 17 == 0, "many").when(k % 3 == 0, "77").alias("num_iter")).alias("deconvolve_params"),
    ))
    text = F.when(k % 13 == 0, F.substring(js, 1, 4)).otherwise(js)
    out = json_meta.parse_configs(v.table("customer").select("c_custkey", text.alias("value")))
    return out.select(
        "c_custkey", "status", "raw_pattern", "tile_size", r6("contrast_lo_pct").alias("contrast_lo_pct"), "num_iter", "contrast_hi_pct",
        F.array_join(F.transform("poly_degree", lambda d: d.cast("string")), ",").alias("poly_degree"),
    )


@query(
    "model_catalog",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'backbone' ELSE 'classifier' END AS kind,
         CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN concat('trained 2024-05-06; self-supervised on ', p_size, ' tiles')
           ELSE concat('trained ', CASE WHEN p_partkey % 2 = 0 THEN '2024-05-06' ELSE 'unknown da' END, '; ',
             CASE WHEN p_partkey % 5 = 0 THEN printf('validation accuracy %.3f on %d tiles; ', p_size / 67.0, p_size) ELSE '' END,
             'categories: ', CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE concat(p_name, ' (', p_size, '), ', p_type) END) END AS description FROM part""",
)
def _(v: Views):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("long")
    js = F.to_json(F.struct(
        F.when((k % 3 != 0) & (k % 7 != 0), F.array("p_name", "p_type")).alias("categories"),
        F.when(k % 3 != 0, F.create_map(F.col("p_name"), size)).alias("category_counts"),
        F.when((k % 3 != 0) & (k % 5 == 0), F.struct((F.col("p_size") / 67.0).alias("accuracy"), size.alias("n"))).alias("validation"),
        F.when(k % 3 == 0, "same crop twice").alias("pairing"),
        F.when(k % 3 == 0, size).alias("tile_count"),
        F.when((k % 2 == 0) | (k % 3 == 0), "2024-05-06T07:08:09+00:00").alias("last_trained"),
    ))
    text = F.when(k % 11 == 0, F.substring(js, 1, 7)).otherwise(js)
    return json_meta.model_catalog(v.table("part").select("p_partkey", text.alias("value")))


@query(
    "file_manifest",
    "SELECT source AS field, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source",
)
def _(v: Views):
    # The texts of each source are written as lines; the listing must show every byte of them.
    path = scratch_dir(v.spark, "listed")
    v.table("documents").select(F.col("text").alias("value"), "source").write.partitionBy("source").text(path)
    files = manifest.file_manifest(v.spark, path, "*.txt")
    field = F.regexp_extract("path", r"/source=([^/]+)/[^/]+$", 1)
    return files.groupBy(field.alias("field")).agg(F.sum("size").alias("bytes"))


# --- incremental forms: a stream over the same rows ends where the batch job does -----


@query("tag_stream", REGISTRY["fold_tag_events"].sql)
def _(v: Views):
    raw = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    table, checkpoint = scratch_dir(v.spark, "states"), scratch_dir(v.spark, "offsets")
    jobs.start_tag_table(v.as_tag_events(raw), table, checkpoint, buckets=8).awaitTermination()
    return settle_tag_state(v.spark.read.parquet(table)).withColumn("confidence", r6("confidence"))


@query("tally_stream", REGISTRY["fov_tally"].sql.replace("JOIN fx_tags g", "JOIN (SELECT * FROM fx_tags WHERE fov_id <> 'src3') g"))
def _(v: Views):
    tiles_at, tags_at, out, checkpoint = (scratch_dir(v.spark, n) for n in ("tiles", "tags", "tallies", "offsets"))
    tiles = v.tiles.select(*KEY)
    tile_store.write_partitions(tiles, tiles_at, ["cell_id"])
    tile_store.write_partitions(v.tags, tags_at, ["cell_id"])
    # All fields are counted; then the tags of one are cleared, and it is counted again.
    for cleared in (None, v.tags.where("fov_id = 'src3'")):
        if cleared is not None:
            tile_store.write_partitions(cleared.where("false"), tags_at, ["cell_id"], touched=cleared.select("project", "fov_id"))
        jobs.start_tally_refresh(v.spark, tags_at, tiles_at, out, checkpoint, TAGS, tiles.schema).awaitTermination()
    schema = "n_tiles long, n_tagged long, n_human long, untagged long, project string, fov_id string"
    return tile_store.read_partitions(v.spark, out, schema, "n_tiles").select("project", "fov_id", "n_tiles", "n_tagged", "n_human", "untagged")


@query("index_stream", "SELECT cell_id, CAST(label % 20 AS VARCHAR) AS fov_id, label, concat('t/', cell_id) AS crop_path FROM fx_tiles")
def _(v: Views):
    feed, index, checkpoint = (scratch_dir(v.spark, n) for n in ("feed", "index", "offsets"))
    rows = v.tiles.select(
        "cell_id", (F.col("label") % 20).cast("string").alias("fov_id"), "label", F.concat(F.lit("t/"), "cell_id").alias("crop_path")
    ).withColumn("export", F.lit(2).cast("long"))
    # Rows of an older export come between those of the newer one; every file is a batch, so each field is split.
    older = rows.where("label % 3 = 0").withColumn("cell_id", F.concat("cell_id", F.lit("_old"))).withColumn("export", F.lit(1).cast("long"))
    rows.unionByName(older).repartition(3, "cell_id").write.parquet(feed)
    stream = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    jobs.start_index_growth(stream, index, checkpoint, export="export").awaitTermination()
    return tile_store.read_partitions(v.spark, index, TILE_INDEX, "cell_id").select(*TILE_INDEX.names)
