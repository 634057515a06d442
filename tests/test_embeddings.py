"""Neighbours, votes, collapse diagnostics and probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import approximate
from cellframe.operators import embeddings as emb
from cellframe.plans import classify, models


def frame(spark, x, labels=None):
    labels = labels if labels is not None else [0] * len(x)
    return spark.createDataFrame(
        [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, labels))], "id long, embedding array<double>, label int"
    )


def brute(q, t, metric):
    if metric == "euclidean":
        return np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1))
    if metric == "manhattan":
        return np.abs(q[:, None] - t[None]).sum(-1)
    if metric == "correlation":
        q, t = q - q.mean(1, keepdims=True), t - t.mean(1, keepdims=True)
    return 1 - (q @ t.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(t, axis=1))


@pytest.mark.parametrize("metric", emb.METRICS)
def test_neighbours_equal_brute_force(spark, metric):
    """Clusters, one of them holding most rows, cut into many small blocks."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6)) * 8
    which = np.where(rng.random(300) < 0.6, 0, rng.integers(1, 4, 300))
    x = centres[which] + rng.normal(size=(300, 6))
    q = centres[rng.integers(0, 4, 40)] + rng.normal(size=(40, 6))
    got = emb.knn_join(frame(spark, q), frame(spark, x), 4, metric, n_pivots=5, block_rows=32).collect()
    d = brute(q, x, metric)
    for i in range(len(q)):
        rows = sorted((r["rank"], r.neighbor_id, r.distance) for r in got if r.query_id == i)
        order = np.lexsort((np.arange(len(x)), d[i]))[:4]
        assert [r[1] for r in rows] == order.tolist()
        assert [r[2] for r in rows] == pytest.approx(d[i][order].tolist(), abs=1e-9)


def test_duplicates_tie_by_id_and_self_is_left_out(spark):
    x = np.repeat(np.eye(3), 5, axis=0)
    got = emb.knn_graph(frame(spark, x), 3).collect()
    assert len(got) == 15 * 3
    for r in got:
        same = [i for i in range(15) if i // 5 == r.query_id // 5 and i != r.query_id]
        assert r.neighbor_id == same[r["rank"] - 1] and r.distance == pytest.approx(0)


def test_fewer_rows_than_k(spark):
    x = np.eye(4)
    assert emb.knn_join(frame(spark, x[:2]), frame(spark, x), 9).count() == 8
    assert emb.knn_graph(frame(spark, x), 15).count() == 4 * 3


def test_separable_classes_score_high(spark):
    rng = np.random.default_rng(0)
    labels = np.repeat(np.arange(4), 30)
    x = np.eye(8)[labels] * 10 + rng.normal(0, 0.1, (120, 8))
    r = emb.knn_accuracy(frame(spark, x, labels)).first()
    assert (r.n_train, r.n_val) == (96, 24) and r.accuracy > 0.95


def test_one_class_has_no_score(spark):
    assert emb.knn_accuracy(frame(spark, np.eye(5))).first().accuracy is None


def test_vote_tie_goes_to_the_nearer(spark):
    rows = [(1, 0, 7, 0.1, 1), (1, 1, 8, 0.2, 2), (1, 2, 8, 0.3, 3), (1, 3, 7, 0.4, 4)]
    df = spark.createDataFrame(rows, "query_id long, neighbor_id long, label int, distance double, rank int")
    assert emb.knn_vote(df).first().predicted == 7


def test_collapse_diagnostics(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(50, 5)), rng.normal(size=(50, 5)) * 0.5
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "z1 array<double>, z2 array<double>").repartition(3)
    r = emb.embedding_health(df).first()
    sim = ((a - b) ** 2).mean()
    std = sum(np.maximum(0, 1 - np.sqrt(z.var(0, ddof=1) + 1e-4)).mean() for z in (a, b))
    cov = 0.0
    for z in (a, b):
        c = np.cov(z.T)
        cov += (c**2).sum() / 5 - (np.diag(c) ** 2).sum() / 5
    assert (r.sim, r.std, r["cov"]) == pytest.approx((sim, std, cov))
    assert r.total == pytest.approx(25 * sim + 25 * std + cov)


def test_probe_learns_separable_classes(spark):
    rng = np.random.default_rng(0)
    labels = np.repeat(np.arange(3), [60, 20, 8])
    x = np.eye(6)[labels] * 5 + rng.normal(0, 0.3, (88, 6))
    df = frame(spark, x, labels).select("id", "embedding", F.concat(F.lit("c"), "label").alias("category"))
    _m, names, pairs, weights = classify.train_probe(df, "id", max_iter=20)
    assert names == ["c0", "c1", "c2"]
    assert pairs.where("truth = pred").count() == pairs.count() == 12 + 4 + 2
    w = {r.label: r.weight for r in weights.collect()}
    assert w["c2"] > w["c1"] > w["c0"]


def test_human_tags_survive_inference(spark):
    class Always:
        def load(self):
            return lambda vectors: (np.array(["x"] * len(vectors), dtype=object), np.full(len(vectors), 0.7))

    tiles = spark.createDataFrame([("p", "f", f"c{i}", [0.0]) for i in range(4)], "project string, fov_id string, cell_id string, embedding array<double>")
    tags = spark.createDataFrame(
        [("p", "f", "c0", "y", None), ("p", "f", "c1", "y", 0.2), ("p", "f", "c3", "x", None)],
        "project string, fov_id string, cell_id string, category string, confidence double",
    )
    new, report = classify.classify_pool(tiles, tags, Always())
    got = {r.cell_id: (r.category, r.confidence) for r in new.collect()}
    assert got == {"c0": ("y", None), "c1": ("x", 0.7), "c2": ("x", 0.7), "c3": ("x", None)}
    r = report.first()
    assert (r.n_total, r.n_new, r.n_replaced, r.n_human, r.n_agree, r.n_unseen) == (4, 1, 1, 2, 1, None)
    assert r.accuracy_human == 0.5 and r.accuracy_unseen is None


def _hits(got, x, k):
    d = brute(x, x, "euclidean")
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k]}
    return len(want & {(r.query_id, r.neighbor_id) for r in got}) / len(want)


def test_approximate_graph_finds_most_neighbours(spark):
    """Two levels of lists over clusters, one of which holds a third of all rows; a query sees a small part of them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32)) * 2
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(1, 60, 3000))
    x = centres[which] + rng.normal(size=(3000, 32)) * 0.7
    df = frame(spark, x)
    got = approximate.knn_graph_approx(df, 5, fan=8, levels=2, probes=12, block_rows=100).collect()
    assert len(got) == 15000 and _hits(got, x, 5) >= 0.9
    again = approximate.knn_graph_approx(df.repartition(7), 5, fan=8, levels=2, probes=12, block_rows=77).collect()
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in got} == {(r.query_id, r.neighbor_id, r["rank"]) for r in again}


@pytest.mark.parametrize("metric", emb.METRICS)
def test_approximate_graph_without_levels_is_exact(spark, metric):
    x = np.random.default_rng(5).normal(size=(90, 6))
    exact = emb.knn_graph(frame(spark, x), 3, metric).collect()
    got = approximate.knn_graph_approx(frame(spark, x), 3, metric, block_rows=40).collect()
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in got} == {(r.query_id, r.neighbor_id, r["rank"]) for r in exact}


def test_approximate_lists_of_equal_vectors_are_whole(spark):
    x = np.repeat(np.eye(3), 40, axis=0)
    got = approximate.knn_graph_approx(frame(spark, x), 3, fan=4, levels=2, probes=2, block_rows=16).collect()
    assert len(got) == 360 and all(r.distance == pytest.approx(0) and r.query_id // 40 == r.neighbor_id // 40 for r in got)
    empty = frame(spark, x).limit(0)
    assert approximate.knn_graph_approx(empty, 3).count() == 0


def test_a_trained_probe_predicts_from_its_row(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = ["p", "q", "r"]
    labels = np.repeat([0, 1, 2], [40, 20, 8])
    x = np.eye(5)[labels] * 4 + rng.normal(0, 0.4, (68, 5))
    keys = [("pr", "f", f"c{i}") for i in range(68)]
    tiles = spark.createDataFrame([(*k, [float(a) for a in row]) for k, row in zip(keys, x)], "project string, fov_id string, cell_id string, embedding array<double>")
    tags = spark.createDataFrame(
        [(*k, names[c], None if i % 4 else 0.3) for i, (k, c) in enumerate(zip(keys, labels))], "project string, fov_id string, cell_id string, category string, confidence double"
    )
    folder = str(tmp_path / "models")
    report = {r.category: r for r in models.train_probe_job(tiles, tags, folder, "first", max_iter=30).collect()}
    assert {c: (r.n_train, r.n_val, r.n_correct, r.recorded) for c, r in report.items()} == {"p": (24, 6, 6, True), "q": (12, 3, 3, True), "r": (5, 1, 1, True)}
    row = models.read_models(spark, folder).first()
    assert (row.model_id, row.labels, row.n_train, row.n_val, row.accuracy) == ("first", names, 41, 10, 1.0)
    taught = {tuple(r)[:3] for r in models.read_provenance(spark, folder, "first").collect()}
    assert len(taught) == 41 and all(int(k[2][1:]) % 4 for k in taught)

    z = x @ np.array(row.coefficients).T + np.array(row.intercepts)
    e = np.exp(z - z.max(1, keepdims=True))
    scored = classify.predict_tiles(tiles, models.load_predictor(spark, folder, "first"))
    got = {r.cell_id: (r.pred, r.score) for r in scored.collect()}
    for i in range(68):
        assert got[f"c{i}"] == (names[z[i].argmax()], pytest.approx(e[i].max() / e[i].sum()))

    with pytest.raises(ValueError, match="exists"):
        models.train_probe_job(tiles, tags, folder, "first")
    with pytest.raises(ValueError, match="no model"):
        models.load_predictor(spark, folder, "second")
    models.save_model(spark, folder, "second", models.LinearProbe.from_means(tiles.join(tags.drop("confidence"), ["project", "fov_id", "cell_id"])), tags)
    assert models.read_models(spark, folder).count() == 2


def test_a_lost_training_run_can_be_repeated(spark, tmp_path):
    """Provenance without a model row is what a run leaves that was lost before its commit."""
    folder = str(tmp_path / "models")
    rows = spark.createDataFrame([("p", "f", "c1", "x")], "project string, fov_id string, cell_id string, category string")
    rows.unionByName(rows).write.parquet(f"{folder}/provenance/model_id=m")
    assert models.read_models(spark, folder).count() == 0
    models.save_model(spark, folder, "m", models.LinearProbe(["x"], [[1.0]], [0.0]), rows)
    assert models.read_provenance(spark, folder, "m").count() == 1 and models.read_models(spark, folder).first().n_train == 1


@pytest.mark.parametrize("metric", emb.METRICS)
def test_queries_leave_routing_in_small_batches(spark, metric, monkeypatch):
    """Where vectors do not cluster every query sees every part: once, and a few rows at a time."""
    from cellframe.operators import embeddings

    monkeypatch.setattr(embeddings, "ROUTED", 64)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(150, 16)), 2, axis=0)
    got = emb.knn_graph(frame(spark, x), 3, metric).collect()
    d = brute(x, x, metric)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i].round(9)))[:3]
        assert [r.neighbor_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == order.tolist()
    q, ids = x[:8], np.arange(8)
    rows, cols, far = emb._top_k(q, ids, np.repeat(x, 40, axis=0), np.arange(12000), 3, "manhattan", False)
    assert len(emb._distinct(np.repeat(x, 40, axis=0), np.arange(12000), 3)) == 600
    assert (far == 0).all() and cols.tolist() == [c for i in range(8) for c in range(i // 2 * 80, i // 2 * 80 + 3)]


def test_a_query_is_routed_once_to_each_part(spark):
    """160 cells of a small table form one part; before, every query was sent to each of them."""
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(800, 8)))
    plan = emb.knn_graph(df, 3)
    whole = emb.knn_join(df, df, 3, skip_self=True, n_pivots=160)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, whole.drop("label").collect()))
    assert "pivot_d" not in whole._jdf.queryExecution().analyzed().toString()
