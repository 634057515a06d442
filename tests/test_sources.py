"""Files in and out, and the streaming jobs against their batch twins."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import lineage
from cellframe.operators.tags import fold_tag_events, settle_tag_state
from cellframe.schemas import TAGS, TILE_INDEX
from cellframe.sources import json_meta, manifest, tags_text, tile_store
from cellframe.sources.celltiles import CellTilesSource
from cellframe.streaming import jobs


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def container(path, cells, codec="zlib"):
    index, blobs, at = [], [], 0
    for cell_id, label, arr, extra in cells:
        raw = arr.tobytes()
        blob = zlib.compress(raw) if codec == "zlib" else raw
        index.append({"cell_id": cell_id, "label": label, "offset": at, "nbytes": len(blob), "shape": list(arr.shape),
                      "dtype": str(arr.dtype), "codec": codec, **extra})
        blobs.append(blob)
        at += len(blob)
    head = json.dumps({"cells": index}).encode()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"YTLC1\n" + struct.pack("<Q", len(head)) + head + b"".join(blobs))


@pytest.mark.parametrize("codec", ["zlib", "raw"])
def test_container_import(spark, tmp_path, codec):
    rng = np.random.default_rng(0)
    tiles = {f"f_cell{i:05d}": rng.integers(0, 256, (3, 4, 4), dtype=np.uint8) for i in range(1, 6)}
    cells = [(c, i, a, {"centroid": [1.5, i]} if i % 2 else {}) for i, (c, a) in enumerate(tiles.items(), 1)]
    container(str(tmp_path / "p/05_tiles/f.tiles"), cells, codec)
    container(str(tmp_path / "p/05_tiles/empty.tiles"), [], codec)
    write(str(tmp_path / "p/05_tiles/._f.tiles"), "junk")
    spark.dataSource.register(CellTilesSource)
    # Slices far smaller than the file: every cell still comes exactly once.
    df = spark.read.format("celltiles").option("slice_bytes", 64).load(str(tmp_path / "p"))
    rows = df.collect()
    assert sorted(r.cell_id for r in rows) == sorted(tiles)
    for r in rows:
        assert (np.frombuffer(r.pixels, r.dtype).reshape(r["shape"]) == tiles[r.cell_id]).all()
        assert r.centroid == ([1.5, float(r.label)] if r.label % 2 else None)
    meta = spark.read.format("celltiles").option("metadata_only", "true").load(str(tmp_path / "p/05_tiles/f.tiles"))
    assert meta.where("pixels is null").count() == 5


def test_bad_magic_fails(spark, tmp_path):
    write(str(tmp_path / "x.tiles"), "not a container at all")
    spark.dataSource.register(CellTilesSource)
    with pytest.raises(Exception, match="bad magic"):
        spark.read.format("celltiles").load(str(tmp_path)).collect()


def test_sidecar_rules(spark, tmp_path):
    text = (
        "#categories\tsingle\ttwo\n#channel_colors\t0=#ff0000:additive:1.0\n\nc1\tdead\nc2.tif\ttwo\t0.7500\nc1\tbudding\t0.5\n"
        "c3\tx\tnot a number\n\tno key\nc4\ta\t1\textra\nonly one\nc5\tkept\t0.25\nc5\tlater\n"
    )
    write(str(tmp_path / "pool/proj/05_tiles/fov 1.txt"), text)
    got = {r.cell_id: (r.project, r.fov_id, r.category, r.confidence) for r in tags_text.read_tags(spark, str(tmp_path / "pool"), partitioned=False).collect()}
    assert got == {
        "c1": ("proj", "fov 1", "budding", 0.5),
        "c2": ("proj", "fov 1", "two", 0.75),
        "c3": ("proj", "fov 1", "x", None),
        "c5": ("proj", "fov 1", "later", 0.25),
    }
    words = tags_text.read_header_vocabulary(spark, str(tmp_path / "pool"), partitioned=False).orderBy("position").collect()
    assert [r.category for r in words] == ["single", "two"]


def test_later_lines_win_across_splits(spark, tmp_path):
    lines = [f"c{i % 50}\tk{i}" for i in range(20000)]
    write(str(tmp_path / "p/05_tiles/f.txt"), "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = {r.cell_id: r.category for r in tags_text.read_tags(spark, str(tmp_path), partitioned=False).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"c{i % 50}": f"k{i}" for i in range(20000 - 50, 20000)}


def test_manifest_and_stages(spark, tmp_path):
    root = tmp_path / "lab"
    for f in ("p1/a.ims", "p1/b.ims", "p1/._a.ims", "p1/notes.txt", "p1/01_reduced/a.tiff", "p1/01_reduced/.cellpose_bf/a_seg.npy",
              "p1/05_tiles/a.tiles", "p1/05_tiles/tiles.csv", "p2/01_reduced/c.tiff"):
        write(str(root / f), "x")
    m = manifest.file_manifest(spark, str(root))
    files = manifest.stage_files(m)
    got = sorted((r.project, r.stage, r.stem) for r in files.collect())
    assert got == [("p1", "01_reduced", "a"), ("p1", "05_tiles", "a"), ("p1", "raw", "a"), ("p1", "raw", "b"), ("p2", "01_reduced", "c")]
    assert [(r.project, r.stem) for r in lineage.pending_files(files, "raw", "01_reduced").collect()] == [("p1", "b")]
    assert "content" not in m.columns


def test_three_state_freshness(spark):
    rows = [("p", "raw", "a", 5), ("p", "01_reduced", "a", 6), ("p", "01_reduced", "b", 9), ("p", "02_denoised", "a", 5), ("q", "01_reduced", "z", 1)]
    files = spark.createDataFrame(rows, "project string, stage string, stem string, mtime long")
    got = {(r.project, r.stage, r.stem): (r.up_to_date, r.upstream_available) for r in lineage.stage_file_status(files).collect()}
    assert got == {
        ("p", "01_reduced", "a"): (True, True),
        ("p", "01_reduced", "b"): (False, True),
        ("p", "02_denoised", "a"): (False, True),
        ("q", "01_reduced", "z"): (True, False),
    }
    masks = spark.createDataFrame([("p", "a", 1)], "project string, stem string, mtime long")
    states = {(r.project, r.stage): (r.status, r.active) for r in lineage.stage_status(files, masks).collect()}
    assert states["p", "01_reduced"] == ("stale", False)
    assert states["p", "02_denoised"] == ("stale", True)
    assert states["q", "01_reduced"] == ("archived", True)
    assert states["p", "segmentation"][0] == "done" and states["q", "segmentation"][0] == "empty"


def test_configs(spark, tmp_path):
    write(str(tmp_path / "a/config.json"), '{"tile_params": {"size": "48"}, "stage_runs": {"01_reduced": {"last_run": "t", "files": ["a"]}}}')
    write(str(tmp_path / "b/config.json"), "{broken")
    write(str(tmp_path / "c/config.json"), '{"denoise_params": {"channels": [1], "steps": "lots"}}')
    good, bad = json_meta.load_configs(spark, str(tmp_path))
    r = good.first()
    assert (r.tile_size, r.num_tiles_y, r.poly_degree, r.remove_edge_masks) == (48, 8, [2, 2], True)
    assert r.stage_runs["01_reduced"].files == ["a"]
    assert sorted(x.path.split("/")[-2] for x in bad.collect()) == ["b", "c"]


def test_tag_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    ai = F.col("event_type").isin("view", "error")
    events = spark.read.parquet(src).select(
        F.col("user_id").alias("tile"), "ts", "event_id", F.when(ai, "ai").otherwise("human").alias("actor"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.col("event_type")).alias("category"),
        F.when(ai, F.col("value")).alias("confidence"),
    )
    feed, table, ckpt = (str(tmp_path / d) for d in ("feed", "table", "ckpt"))
    want = sorted(map(tuple, fold_tag_events(events).collect()))
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        jobs.start_tag_table(stream, table, ckpt, buckets=4).awaitTermination()
    got = settle_tag_state(spark.read.parquet(table))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_tallies_follow_only_changed_fields(spark, tmp_path):
    tiles_path, tags_path, out, ckpt = (str(tmp_path / d) for d in ("tiles", "tags", "out", "ckpt"))
    tiles = spark.createDataFrame([("p", f, f"{f}_{i}") for f in "ab" for i in range(3)], "project string, fov_id string, cell_id string")
    tile_store.write_partitions(tiles, tiles_path, ["cell_id"])

    def tag(rows):
        tile_store.write_partitions(spark.createDataFrame(rows, TAGS), tags_path, ["cell_id"])

    def run():
        jobs.start_tally_refresh(spark, tags_path, tiles_path, out, ckpt, TAGS, tiles.schema).awaitTermination()
        return {r.fov_id: (r.n_tiles, r.n_tagged, r.n_human) for r in spark.read.parquet(out).collect()}

    tag([("p", "a", "a_0", "x", None), ("p", "b", "b_0", "x", 0.5)])
    assert run() == {"a": (3, 1, 1), "b": (3, 1, 0)}
    before = {f for f in os.listdir(f"{out}/project=p/fov_id=b") if f.endswith("parquet")}
    tag([("p", "a", "a_0", "x", None), ("p", "a", "a_1", "y", 0.1)])
    assert run() == {"a": (3, 2, 1), "b": (3, 1, 0)}
    assert {f for f in os.listdir(f"{out}/project=p/fov_id=b") if f.endswith("parquet")} == before


def test_index_grows_by_field(spark, tmp_path):
    feed, index, ckpt = (str(tmp_path / d) for d in ("feed", "index", "ckpt"))

    def arrive(fov, labels):
        rows = [(f"{fov}_cell{n:05d}", fov, n, "x") for n in labels]
        spark.createDataFrame(rows, TILE_INDEX).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(TILE_INDEX).parquet(feed)
        jobs.start_index_growth(stream, index, ckpt, export=None).awaitTermination()
        return sorted((r.fov_id, r.label) for r in spark.read.schema(TILE_INDEX).parquet(index).collect())

    assert arrive("001", [1, 2, 3]) == [("001", 1), ("001", 2), ("001", 3)]
    assert arrive("002", [1]) == [("001", 1), ("001", 2), ("001", 3), ("002", 1)]
    assert arrive("001", [1, 2]) == [("001", 1), ("001", 2), ("002", 1)]


def test_index_keeps_fields_split_over_batches(spark, tmp_path):
    feed, index, ckpt = (str(tmp_path / d) for d in ("feed", "index", "ckpt"))
    schema = "cell_id string, fov_id string, label long, crop_path string, export long"

    def arrive(*files):
        for rows in files:
            made = [(None if n is None else f"{fov}_{n}", fov, n, "x", export) for fov, n, export in rows]
            spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        jobs.start_index_growth(stream, index, ckpt, export="export").awaitTermination()
        return sorted((r.fov_id, r.label) for r in tile_store.read_partitions(spark, index, schema, "cell_id").collect())

    assert arrive([("a", 1, 1)], [("a", 2, 1), ("b", 1, None)], [("a", 3, 1)]) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert arrive([("a", 1, 2)], [("a", 9, 1)]) == [("a", 1), ("b", 1)]
    # An export without cells empties the field, and late rows of the older one do not fill it again.
    assert arrive([("a", None, 3)], [("a", 1, 2)]) == [("b", 1)]


def test_emptied_fields_lose_their_rows(spark, tmp_path):
    text, tiles_path, tags_path, out, ckpt = (str(tmp_path / d) for d in ("text", "tiles", "tags", "out", "ckpt"))
    tags = spark.createDataFrame([("p", "a", "a_0", "x", None), ("p", "b", "b_0", "x", 0.5)], TAGS)
    both, none = tags.select("project", "fov_id"), tags.where("false")
    tags_text.write_tags(tags, text)
    tags_text.write_tags(tags.where("fov_id = 'b'"), text, touched=both)
    assert [r.cell_id for r in tags_text.read_tags(spark, text).collect()] == ["b_0"]
    tags_text.write_tags(none, text, touched=both)
    assert tags_text.read_tags(spark, text).count() == 0

    tiles = tags.select("project", "fov_id", "cell_id")
    tile_store.write_partitions(tiles, tiles_path, ["cell_id"])
    tile_store.write_partitions(tags, tags_path, ["cell_id"])

    def tallies():
        jobs.start_tally_refresh(spark, tags_path, tiles_path, out, ckpt, TAGS, tiles.schema).awaitTermination()
        return {r.fov_id: (r.n_tiles, r.n_tagged) for r in spark.read.parquet(out).where("n_tiles is not null").collect()}

    assert tallies() == {"a": (1, 1), "b": (1, 1)}
    tile_store.replace_partitions(none, tags_path, ["cell_id"], touched=both.where("fov_id = 'a'"))
    assert tallies() == {"a": (1, 0), "b": (1, 1)}
    assert [r.cell_id for r in tile_store.read_partitions(spark, tags_path, TAGS, "cell_id").collect()] == ["b_0"]
