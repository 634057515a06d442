"""The building blocks under hot keys, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import contrast, ranking, skew


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows under one key."""
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 else f"k{i % 30}", i, float(rng.normal()) if i % 2 else float(rng.integers(0, 4))) for i in range(3000)]
    rows.append(("single", 5000, 1.5))
    return spark.createDataFrame(rows, "g string, id long, v double"), rows


def test_exact_percentiles(hot):
    df, rows = hot
    want = {"p0": 0, "p1": 0.1, "p50": 50, "p99": 99.9, "p100": 100}
    got = {r.g: r for r in skew.exact_percentiles(df, ["g"], "v", want).collect()}
    for g in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == g]
        for name, p in want.items():
            assert got[g][name] == pytest.approx(np.percentile(values, p), abs=1e-12)


def test_percentiles_of_signed_zeros_and_tiny_values(spark):
    values = [-1e-300, -0.0, 0.0, 1e-300, 3.0, -7.5, 1e300]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    got = skew.exact_percentiles(df, ["g"], "v", {"lo": 0, "mid": 50, "hi": 100}).first()
    assert (got.lo, got.mid, got.hi) == (-7.5, 0.0, 1e300)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_first_by_hash(hot, digits):
    df, rows = hot
    md5 = F.md5(F.col("id").cast("string"))
    out = skew.mark_first_by_hash(df, ["g"], md5, lambda n: F.floor(n * 0.3), "first", digits)
    got = {(r.g, r.id): r["first"] for r in out.collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        ids = sorted((hashlib.md5(str(r[1]).encode()).hexdigest(), r[1]) for r in rows if r[0] == g)
        for k, (_, i) in enumerate(ids):
            assert got[g, i] == (k < int(len(ids) * 0.3))


def test_blocked_rank(hot):
    df, rows = hot
    got = {(r.g, r.id): r["rank"] for r in skew.blocked_rank(df, ["g"], "id", "rank", block=64).collect()}
    for g in {r[0] for r in rows}:
        for k, i in enumerate(sorted(r[1] for r in rows if r[0] == g)):
            assert got[g, i] == k + 1


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_a_plain_one(spark, hot, how):
    df, _ = hot
    facts = spark.createDataFrame([("hot", 1), ("k0", 2), ("none", 3)], "g string, f int")
    plain = df.join(facts, ["g"], how)
    salted = skew.salted_join(df, facts, ["g"], how, salts=5)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_of_many_groups_never_pass_through_the_driver(spark):
    rows = spark.range(2000).select((F.col("id") % 500).alias("g"), F.col("id").alias("v"))
    facts = spark.range(500).select(F.col("id").alias("g"), (F.col("id") * 2).alias("f"))
    for most, sent in ((500, True), (499, False)):
        out = skew.join_facts(rows, facts, ["g"], max_rows=most)
        assert ("Broadcast" in planned(out)) is sent
        assert sorted(map(tuple, out.select("g", "v", "f").collect())) == sorted((i % 500, i, i % 500 * 2) for i in range(2000))


def test_images_are_normalised_without_a_broadcast_of_their_bounds(spark):
    images = 20_001  # one more than the facts that are sent to every task
    pixels = spark.range(2 * images).select((F.col("id") % images).alias("image"), F.col("id").cast("double").alias("value"))
    out = contrast.normalise(pixels, ["image"], 0.0, 100.0)
    assert "Broadcast" not in planned(out)
    assert {tuple(r) for r in out.groupBy("value").count().collect()} == {(0.0, images), (1.0, images)}


def test_split_sizes(spark):
    sizes = {"a": 1, "b": 2, "c": 12, "d": 13, "e": 1000}
    df = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)], "id string, label string")
    out = ranking.stratified_split(df, "id", "label")
    got = {r.label: r.v for r in out.groupBy("label").agg(F.count_if("is_val").alias("v")).collect()}
    assert got == {c: (max(1, round(n * 0.2)) if n > 1 else 0) for c, n in sizes.items()}
    assert out.count() == sum(sizes.values())
    again = {r.id for r in ranking.stratified_split(df, "id", "label").where("is_val").collect()}
    other = {r.id for r in ranking.stratified_split(df, "id", "label", seed=1).where("is_val").collect()}
    assert again == {r.id for r in out.where("is_val").collect()} and again != other


def test_sample_is_exact(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert ranking.sample_rows(df, "k", 30).count() == 30
    assert ranking.sample_rows(df, "k", 300).count() == 100


def test_last_page_is_clamped(spark):
    df = spark.createDataFrame([(f"f_cell{i}",) for i in range(1, 24)], "cell_id string")
    assert [r.cell_id for r in ranking.page(df, "cell_id", 99, 10).collect()] == ["f_cell21", "f_cell22", "f_cell23"]
    assert [r.cell_id for r in ranking.page(df, "cell_id", 0, 3).collect()] == ["f_cell1", "f_cell2", "f_cell3"]
    assert ranking.page_count(df.limit(0), 10).first()[0] == 1


def test_deep_pages(spark):
    rows = [(f"f_cell{i}",) for i in range(1, 501)]
    df = spark.createDataFrame(rows, "cell_id string").repartition(7)
    for number in (0, 3, 17, 49, 99):
        got = [r.cell_id for r in ranking.page(df, "cell_id", number, 10, shallow=0).collect()]
        start = min(number, 49) * 10
        assert got == [f"f_cell{i}" for i in range(start + 1, start + 11)]


def test_facts_join_either_way(spark, hot):
    df, rows = hot
    facts = df.groupBy("g").agg(F.max("v").alias("top"))
    small = skew.join_facts(df, facts, ["g"])
    large = skew.join_facts(df, facts, ["g"], max_rows=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and small.count() == len(rows)


def test_percentiles_where_most_values_are_equal(spark):
    values = [0.0] * 900 + [float(i) for i in range(100)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(5)
    got = skew.exact_percentiles(df, ["g"], "v", {"a": 50, "b": 95, "c": 99.9}).first()
    assert (got.a, got.b, got.c) == pytest.approx(tuple(np.percentile(values, [50, 95, 99.9])))


def test_index_upsert_replaces_whole_fields(spark):
    def rows(fov, labels):
        return spark.createDataFrame(
            [(f"{fov}_cell{n:05d}", fov, n, "x") for n in labels], "cell_id string, fov_id string, label long, crop_path string"
        )

    old = rows("fov1", [1, 2, 3, 4]).unionByName(rows("fov2", [1]))
    two = ranking.upsert_tile_index(old, rows("fov1", [1, 2]))
    assert sorted((r.fov_id, r.label) for r in two.collect()) == [("fov1", 1), ("fov1", 2), ("fov2", 1)]
    gone = ranking.upsert_tile_index(two, rows("fov1", []), spark.createDataFrame([("fov1",)], "fov_id string"))
    assert [r.fov_id for r in gone.collect()] == ["fov2"]


def test_percentiles_with_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", v) for v in (-inf, 1.0, 2.0, 3.0, inf)] + [("b", inf), ("b", inf)], "g string, v double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in skew.exact_percentiles(df, ["g"], "v", {"lo": 0, "mid": 50, "hi": 100}).collect()}
    assert got == {"a": (-inf, 2.0, inf), "b": (inf, inf, inf)}


def test_percentiles_of_values_close_together(spark):
    """Two thirds of a group are distinct doubles within 0.2 % of one another: its bins are cut until they are small."""
    rng = np.random.default_rng(2)
    close = 1000 * (1 + rng.random(4000) * 0.002)
    tight = np.array([1.5 + i * 2.0**-52 for i in range(700)])  # neighbouring doubles
    values = {"a": np.concatenate([close, rng.normal(size=1500) * 900, np.full(500, 1000.5)]), "b": np.concatenate([tight, -tight]), "c": np.array([3.0])}
    rows = [(g, float(v)) for g, part in values.items() for v in rng.permutation(part)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {"lo": 1.0, "low": 33.3, "mid": 50, "high": 66, "hi": 99.5}
    got = {r.g: r for r in skew.exact_percentiles(df, ["g"], "v", want, bin_rows=20).collect()}
    for g, part in values.items():
        assert [got[g][k] for k in want] == pytest.approx(np.percentile(part, list(want.values())).tolist(), rel=1e-15, abs=0)
    bins = skew.selected_bins(df, ["g"], "v", want, 20).groupBy("g", "_before").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_v").alias("d")).collect()
    assert all(r.n <= 20 or r.d == 1 for r in bins)


def test_facts_of_many_groups_are_not_broadcast(spark):
    facts = spark.range(30_000).select(F.col("id").alias("g"), (F.col("id") * 2).alias("f"))
    big = spark.range(60_000).select((F.col("id") % 30_000).alias("g"), "id")
    out = skew.join_facts(big, facts, ["g"])
    assert "broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("f = 2 * g").count() == 60_000
