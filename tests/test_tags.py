"""Merge rules, reports and vocabularies by example."""

import pytest
from pyspark.sql import functions as F

from cellframe.functions import names as nm
from cellframe.functions import pixels as px
from cellframe.operators import analytics, pool, predictions, tags, vocab
from cellframe.plans import export
from cellframe.schemas import TAGS
from cellframe.sources import manifest, tile_store


def make(spark, rows):
    return spark.createDataFrame([("p", "f", c, k, s) for c, k, s in rows], TAGS)


def shown(df):
    return {r.cell_id: (r.category, r.confidence) for r in df.collect()}


def tiles_of(spark, sizes):
    rows = [("p", f, f"{f}_cell{i:05d}", i) for f, n in sizes.items() for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "project string, fov_id string, cell_id string, label long")


def test_a_prediction_never_replaces_a_human(spark):
    now = make(spark, [("c1", "dead", None), ("c2", "two", 0.4), ("c4", "bud", 0.9)])
    new = make(spark, [("c1", "single", 0.99), ("c2", "single", 0.5), ("c3", "single", 0.6), ("c4", "", 0.0)])
    assert shown(tags.apply_predictions(now, new)) == {"c1": ("dead", None), "c2": ("single", 0.5), "c3": ("single", 0.6)}
    only = tags.apply_predictions(now, new, "untagged_only")
    assert shown(only) == {"c1": ("dead", None), "c2": ("two", 0.4), "c3": ("single", 0.6), "c4": ("bud", 0.9)}
    twice = new.withColumn("seq", F.lit(1)).unionByName(make(spark, [("c3", "two", 0.7)]).withColumn("seq", F.lit(2)))
    assert shown(tags.apply_predictions(now, twice, order="seq"))["c3"] == ("two", 0.7)


def test_human_edits(spark):
    now = make(spark, [("c1", "dead", None), ("c2", "two", 0.4), ("c3", "two", 0.3)])
    edits = spark.createDataFrame(
        [("p", "f", "c1", "", 1), ("p", "f", "c2", "x", 2), ("p", "f", "c2", "two", 3), ("p", "f", "c9", "new", 4)],
        "project string, fov_id string, cell_id string, category string, seq long",
    )
    assert shown(tags.apply_human_tags(now, edits)) == {"c2": ("two", None), "c3": ("two", 0.3), "c9": ("new", None)}


def test_swapped_keys_do_not_overwrite_each_other(spark):
    now = make(spark, [("a", "x", None), ("b", "y", 0.2), ("c", "z", None), ("d", "w", None)])
    moves = spark.createDataFrame(
        [("p", "f", "a", "b"), ("p", "f", "b", "a"), ("p", "f", "c", "d"), ("p", "f", "gone", "q")],
        "project string, fov_id string, cell_id string, new_cell_id string",
    )
    assert shown(tags.remap_tags(now, moves)) == {"b": ("x", None), "a": ("y", 0.2), "d": ("z", None)}


def test_results_report(spark):
    tiles = tiles_of(spark, {"a": 4, "b": 2})
    rows = [("p", "a", "a_cell00001", "dead", None), ("p", "a", "a_cell00002", "two", None), ("p", "a", "a_cell00003", "two", 0.8),
            ("p", "b", "b_cell00001", "dead", 0.7), ("p", "b", "b_cell00002", "dead", 0.6), ("p", "b", "b_cell99999", "two", None)]
    t = spark.createDataFrame(rows, TAGS)
    out = pool.results_table(tiles, t, ["two", "single"])
    assert out.columns == ["project", "fov", "tiles", "two", "single", "dead", "unclassified", "human_set"]
    got = {r.fov: tuple(r)[2:] for r in out.collect()}
    assert got == {"a": (4, 2, 0, 1, 1, 2), "b": (2, 0, 0, 2, 0, 0), "All 2 FOV(s)": (6, 2, 0, 3, 1, 2)}
    # Tallies see the container's cells only; the tagged items keep the orphan.
    assert tags.tagged_items(t).count() == 6


def test_summary_of_parts_equals_the_whole(spark):
    tiles = tiles_of(spark, {"a": 4, "b": 3, "c": 2})
    rows = [("p", "a", "a_cell00001", "alive", None), ("p", "a", "a_cell00002", "alive", None), ("p", "b", "b_cell00001", "dead", None), ("p", "b", "b_cell00002", "dead", 0.5)]
    s = pool.pool_summary(tiles, spark.createDataFrame(rows, TAGS)).collect()
    total = {r.category: (r.n_tiles, r.n_human) for r in s if r.project is None}
    assert total == {None: (9, 3)}
    stats = {r.category: tuple(r)[1:4] for r in pool.annotation_stats(tiles, spark.createDataFrame(rows, TAGS), ["alive"]).collect()}
    assert stats == {"Un-annotated": (5, None, None), "alive": (2, 50.0, 2), "dead": (2, 50.0, 1)}


def test_variable_rules(spark):
    fovs = spark.createDataFrame(
        [("p", "t10_a", True, None, ""), ("p", "t20_b", True, None, "7"), ("p", "none", True, "i", "v"), ("p", "t30_c", False, None, "")],
        "project string, fov_id string, include boolean, index string, variable string",
    )
    got = {r.fov_id: (r["index"], r.variable) for r in analytics.extract_variable(fovs, r"t(\d+)").collect()}
    assert got == {"t10_a": ("10", "10"), "t20_b": ("20", "7"), "none": ("i", "v"), "t30_c": (None, "")}
    whole = {r.fov_id: r["index"] for r in analytics.extract_variable(fovs, r"t\d+").collect()}
    assert whole["t10_a"] == "t10"
    kind = lambda df: dict(analytics.coerce_variable(df).dtypes)["variable"]
    assert kind(fovs.where("variable in ('7')")) == "double"
    assert kind(fovs.where("variable in ('7', 'v')")) == "string"


def test_vocabulary_changes(spark):
    v = spark.createDataFrame([("p", 1, "single"), ("p", 2, "two")], "project string, position int, category string")
    t = make(spark, [("c1", "zeta", None), ("c2", "alpha", None)]).withColumn("project", F.lit("q"))
    listed = lambda df, who="p": [r.category for r in df.where(f"project = '{who}'").orderBy("position").collect()]
    more = vocab.add_category(v, t, " tetrad ")
    assert listed(more) == ["single", "two", "tetrad"] and listed(more, "q") == ["alpha", "zeta", "tetrad"]
    assert listed(vocab.add_category(v, t, "TWO ")) == ["single", "two"]
    assert listed(vocab.add_category(v, t, "  ")) == ["single", "two"]
    assert listed(vocab.rename_in_vocabulary(v, "single", "one")) == ["one", "two"]
    assert listed(vocab.rename_in_vocabulary(v, "single", "two")) == ["two"]
    assert listed(vocab.rename_in_vocabulary(v, "absent", "x")) == ["single", "two"]


@pytest.mark.parametrize(
    "line, names",
    [
        ("#categories", []),
        ("#categories\ta\tb c", ["a", "b c"]),
        ("#categories: a, b ,", ["a", "b"]),
        ("#categories a  b", ["a", "b"]),
        ("#categoriesX a", None),
        ("c1\ta", None),
    ],
)
def test_vocabulary_header(spark, line, names):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(nm.parse_vocab_header("l")).first()[0] == names


def test_natural_order_and_names(spark):
    df = spark.createDataFrame([("f10_b",), ("F2_b",), ("f2_a",), ("2x",), ("f010_a",), ("f12345678901234567890123_a",)], "s string")
    assert [r.s for r in df.orderBy(nm.natural_key("s")).collect()] == ["2x", "f2_a", "F2_b", "f010_a", "f10_b", "f12345678901234567890123_a"]
    one = spark.createDataFrame([("a/b.tiles/f_cell00017", "f", 123456)], "p string, f string, n long")
    r = one.select(nm.container_of("p"), nm.cell_of("p"), nm.tile_display_name(nm.cell_of("p")), nm.cell_id_for("f", "n")).first()
    assert tuple(r) == ("a/b.tiles", "f_cell00017", "f · cell 17", "f_cell123456")


def test_channel_names(spark):
    rows = [("BF_100ms", True), ("DIC2", True), ("mTagBFP2", False), ("brightfield100", True), ("Trans", True), ("DAPI", False), (None, False)]
    df = spark.createDataFrame(rows, "n string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", nm.channel_name_matches("n", nm.BRIGHTFIELD_HINTS)).collect())


def test_overlap_without_a_record_is_null(spark):
    rows = spark.createDataFrame([("c", i) for i in range(8)], "container string, label long")
    seen = rows.where("label < 5")
    assert tuple(predictions.provenance_overlap(rows, seen, ["container", "label"]).first()) == (5, 8)
    assert tuple(predictions.provenance_overlap(rows, seen, ["container", "label"], recorded=False).first()) == (None, 8)


def test_unknown_labels_fail(spark):
    df = spark.createDataFrame([("a",), ("b",)], "label string")
    assert predictions.require_known(predictions.target_categories(df, "label", ["a", "b"])).count() == 2
    with pytest.raises(Exception, match="outside the vocabulary: b"):
        predictions.require_known(predictions.target_categories(df, "label", ["a"])).collect()


def test_missing_plane_count_fails_when_strict(spark):
    df = spark.createDataFrame([(5.0, 0.0, None), (5.0, 100.0, 3)], "b double, o double, n int")
    assert [r[0] for r in df.select(px.effective_background("b", "o", "n", strict=True)).collect()] == [5.0, 305.0]
    bad = spark.createDataFrame([(5.0, 1.0, None)], "b double, o double, n int")
    with pytest.raises(Exception, match="summed planes"):
        bad.select(px.effective_background("b", "o", "n", strict=True)).collect()


def test_channel_last_tiles_are_turned(spark):
    first = bytes(range(12))  # (3, 2, 2)
    last = bytes(first[c * 4 + i] for i in range(4) for c in range(3))  # (2, 2, 3)
    df = spark.createDataFrame([(1, bytearray(first), [3, 2, 2], "uint8"), (2, bytearray(last), [2, 2, 3], "uint8")], "id int, pixels binary, shape array<int>, dtype string")
    got = {(r.id, r.ty, r.tx): (r.brightfield, r.target, r["mask"]) for r in export.unpack_tiles(df, ["id"]).collect()}
    for k in (1, 2):
        assert [got[k, y, x] for y in range(2) for x in range(2)] == [(i, 4 + i, 8 + i) for i in range(4)]


def test_tiles_are_replaced_per_field(spark, tmp_path):
    path = str(tmp_path / "tiles")
    tile_store.write_tiles(tiles_of(spark, {"001": 3, "b": 2}), path)
    tile_store.write_tiles(tiles_of(spark, {"001": 1}), path)
    back = tile_store.read_tiles(spark, path, tiles_of(spark, {"x": 1}).schema)
    assert sorted((r.fov_id, r.label) for r in back.collect()) == [("001", 1), ("b", 1), ("b", 2)]


def test_mask_files(spark):
    rows = [("file:/lab/p1/01_reduced/masks/a_seg.npy", "a_seg.npy"), ("file:/lab/p1/01_reduced/a.tiff", "a.tiff")]
    df = spark.createDataFrame(rows, "path string, name string").withColumn("mtime", F.current_timestamp())
    assert [tuple(r)[:3] for r in manifest.mask_files(df).collect()] == [("p1", "01_reduced", "a")]


def test_complete_mode_stream(spark, tmp_path):
    from cellframe.streaming import jobs

    schema = "tile long, ts timestamp, event_id long, actor string, category string, confidence double"
    rows = [(1, 1, 1, "ai", "x", 0.5), (1, 2, 2, "human", "y", None), (1, 3, 3, "ai", "z", 0.9), (2, 1, 4, "human", "y", None),
            (2, 2, 5, "human", "", None), (2, 3, 6, "ai", "z", 0.7), (3, 1, 7, "ai", "x", 0.1), (3, 2, 8, "human", "", None)]
    feed = str(tmp_path / "feed")
    spark.createDataFrame(rows, "tile long, s long, event_id long, actor string, category string, confidence double").withColumn(
        "ts", F.timestamp_seconds("s")).drop("s").write.parquet(feed)
    stream = spark.readStream.schema(schema).parquet(feed)
    q = jobs.tag_states(stream).writeStream.outputMode("complete").format("memory").queryName("tag_states_out").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ckpt")).start()
    q.awaitTermination()
    got = {r.tile: (r.category, r.confidence) for r in spark.table("tag_states_out").collect()}
    assert got == {1: ("y", None), 2: ("z", 0.7)}


def test_very_long_names(spark):
    line = "#categories\t" + "a" * (1 << 20) + "\tlast"
    assert [len(n) for n in spark.createDataFrame([(line,)], "l string").select(nm.parse_vocab_header("l")).first()[0]] == [1 << 20, 4]
    names = ["f" + "1" * n for n in (9998, 9999, 10000, 10001, 5000)]
    got = [len(r.s) - 1 for r in spark.createDataFrame([(n,) for n in names], "s string").orderBy(nm.natural_key("s")).collect()]
    assert got == [5000, 9998, 9999, 10000, 10001]
