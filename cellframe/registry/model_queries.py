"""Predictions, training records, epochs, embeddings and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import approximate
from ..operators import embeddings as emb
from ..operators import lineage
from ..operators import predictions as pred
from ..operators import ranking, tags
from ..plans import classify, models
from ..session import materialize, scratch_dir
from .core import Views, query, r6, when_text

KEY = ["project", "fov_id", "cell_id"]
CLASSES = ["bud", "single", "tetrad", "two", "ghost"]

# --- predictions --------------------------------------------------------------------

_REC = """rec AS (SELECT p.*, g.category, CASE WHEN g.category IS NULL THEN 'new' WHEN g.confidence IS NOT NULL THEN 'replaced' ELSE 'human' END AS status
    FROM fx_pred p LEFT JOIN fx_tags g USING (project, fov_id, cell_id))"""


@query(
    "reconcile_predictions",
    f"""WITH {_REC} SELECT cell_id, pred, score, category, status, CASE WHEN status = 'human' THEN pred = category END AS agrees FROM rec""",
)
def _(v: Views):
    return pred.reconcile_predictions(v.pred, v.tags).select("cell_id", "pred", "score", "category", "status", "agrees")


@query(
    "inference_report",
    f"""WITH {_REC}, f AS (SELECT *, status = 'human' AS h, pred = category AS a, label % 2 = 0 AS seen FROM rec)
       SELECT count(*) AS n_total, count(CASE WHEN status = 'new' THEN 1 END) AS n_new, count(CASE WHEN status = 'replaced' THEN 1 END) AS n_replaced, count(CASE WHEN h THEN 1 END) AS n_human,
         count(CASE WHEN h AND a THEN 1 END) AS n_agree, count(CASE WHEN h AND NOT seen THEN 1 END) AS n_unseen, count(CASE WHEN h AND NOT seen AND a THEN 1 END) AS n_agree_unseen,
         round(avg(score), 6) AS mean_confidence, round(count(CASE WHEN h AND a THEN 1 END) / count(CASE WHEN h THEN 1 END), 6) AS accuracy_human,
         round(count(CASE WHEN h AND NOT seen AND a THEN 1 END) / count(CASE WHEN h AND NOT seen THEN 1 END), 6) AS accuracy_unseen FROM f""",
)
def _(v: Views):
    trained = v.tiles.where("label % 2 = 0").select(*KEY)
    out = pred.inference_report(v.pred, v.tags, trained)
    return out.withColumns({c: r6(c) for c in ("mean_confidence", "accuracy_human", "accuracy_unseen")})


@query(
    "inference_report_foreign",
    f"""WITH {_REC} SELECT count(*) AS n_total, count(CASE WHEN status = 'human' THEN 1 END) AS n_human, CAST(NULL AS BIGINT) AS n_unseen, CAST(0 AS BIGINT) AS n_agree_unseen FROM rec""",
)
def _(v: Views):
    elsewhere = v.tiles.select(F.lit("away").alias("project"), "fov_id", "cell_id")
    return pred.inference_report(v.pred, v.tags, elsewhere).select("n_total", "n_human", "n_unseen", "n_agree_unseen")


@query(
    "prediction_counts",
    "SELECT pred AS category, count(*) AS n, round(avg(score), 6) AS mean_confidence FROM fx_pred GROUP BY 1",
)
def _(v: Views):
    return pred.prediction_counts(v.pred).withColumn("mean_confidence", r6("mean_confidence"))


def _pairs(v: Views):
    truth = v.tags.where("confidence is null").select(*KEY, F.col("category").alias("truth"))
    return v.pred.join(truth, KEY).select("truth", "pred")


_PAIRS = "pr AS (SELECT g.category AS truth, p.pred FROM fx_pred p JOIN fx_tags g USING (project, fov_id, cell_id) WHERE g.confidence IS NULL)"


@query(
    "evaluate_predictions",
    f"""WITH {_PAIRS} SELECT category, count(truth) AS n, count(CASE WHEN truth = pred THEN 1 END) AS n_correct,
         round(coalesce(count(CASE WHEN truth = pred THEN 1 END) / nullif(count(truth), 0), 0), 6) AS accuracy
       FROM (SELECT unnest({CLASSES}) AS category) c LEFT JOIN pr ON truth = category GROUP BY 1""",
)
def _(v: Views):
    return pred.evaluate_predictions(_pairs(v), CLASSES).withColumn("accuracy", r6("accuracy"))


@query("overall_accuracy", f"WITH {_PAIRS} SELECT count(*) AS n, round(count(CASE WHEN truth = pred THEN 1 END) / count(*), 6) AS accuracy FROM pr")
def _(v: Views):
    return pred.overall_accuracy(_pairs(v)).withColumn("accuracy", r6("accuracy"))


@query(
    "confusion_matrix",
    f"WITH {_PAIRS} SELECT truth, {', '.join(f'''count(CASE WHEN pred = '{c}' THEN 1 END) AS {c}''' for c in CLASSES)} FROM pr GROUP BY 1",
)
def _(v: Views):
    return pred.confusion_matrix(_pairs(v), CLASSES)


@query(
    "class_weights",
    """SELECT c.label, count(e.vec_id) AS n, round((SELECT count(*) FROM embeddings) / (12 * greatest(count(e.vec_id), 1)), 6) AS weight
       FROM (SELECT unnest(range(12)) AS label) c LEFT JOIN embeddings e ON e.label = c.label GROUP BY 1""",
)
def _(v: Views):
    return pred.class_weights(v.table("embeddings"), "label", list(range(12))).withColumn("weight", r6("weight"))


@query(
    "training_provenance",
    """SELECT container, label // 64 AS run, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels, count(*) AS n
       FROM fx_provenance GROUP BY 1, 2""",
)
def _(v: Views):
    out = pred.training_provenance(v.provenance, ["container"], "label", block=64)
    return out.withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), ","))


@query(
    "seen_in_training",
    """SELECT c.container, c.label, p.label IS NOT NULL AS seen FROM fx_candidates c LEFT JOIN fx_provenance p USING (container, label)""",
)
def _(v: Views):
    return pred.seen_in_training(v.candidates, v.provenance, ["container", "label"])


@query(
    "provenance_usable",
    """SELECT 'here' AS place, EXISTS (SELECT 1 FROM fx_provenance p JOIN fx_candidates c USING (container)) AS usable
       UNION ALL SELECT 'elsewhere', false""",
)
def _(v: Views):
    here = pred.provenance_usable(v.provenance, v.candidates, ["container"]).select(F.lit("here").alias("place"), "usable")
    away = v.candidates.select((F.col("container") + 1000000000).alias("container"))
    return here.union(
        pred.provenance_usable(v.provenance, away, ["container"]).select(F.lit("elsewhere").alias("place"), "usable")
    )


@query(
    "provenance_overlap",
    """SELECT count(p.label) AS already_seen, count(*) AS total FROM fx_candidates c LEFT JOIN fx_provenance p USING (container, label)""",
)
def _(v: Views):
    return pred.provenance_overlap(v.candidates, v.provenance, ["container", "label"])


@query(
    "target_categories",
    "SELECT DISTINCT CAST(label AS BIGINT) AS label, label < 8 AS known FROM embeddings",
)
def _(v: Views):
    return pred.target_categories(v.table("embeddings"), "label", list(range(8)))


# --- epochs and checkpoints ----------------------------------------------------------

_EPOCH = "SELECT run_id, epoch, round(avg_loss, 6) AS avg_loss, round(val_accuracy, 6) AS val_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {order}) AS rn FROM fx_epochs) WHERE rn = 1"


@query("select_epoch_cancelled", _EPOCH.format(order="val_accuracy DESC, epoch"))
def _(v: Views):
    return _rounded(pred.select_epoch(v.epochs, ["run_id"], False), "avg_loss", "val_accuracy")


@query("select_epoch_completed", _EPOCH.format(order="epoch DESC"))
def _(v: Views):
    return _rounded(pred.select_epoch(v.epochs, ["run_id"], True), "avg_loss", "val_accuracy")


def _rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


_SSL = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY knn_accuracy DESC, epoch) AS rn FROM fx_epochs WHERE knn_accuracy IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {order}) AS rn FROM fx_epochs)
    SELECT o.run_id, coalesce(k.epoch, o.epoch) AS epoch, round(coalesce(k.avg_loss, o.avg_loss), 6) AS avg_loss, round(k.knn_accuracy, 6) AS knn_accuracy,
      CASE WHEN k.epoch IS NOT NULL THEN 'knn' ELSE '{name}' END AS selected_by FROM o LEFT JOIN k ON k.run_id = o.run_id AND k.rn = 1 WHERE o.rn = 1"""


@query("select_epoch_ssl_cancelled", _SSL.format(order="avg_loss, epoch", name="loss"))
def _(v: Views):
    return _rounded(pred.select_epoch_ssl(v.epochs, ["run_id"], False), "avg_loss", "knn_accuracy")


@query("select_epoch_ssl_completed", _SSL.format(order="epoch DESC", name="last"))
def _(v: Views):
    return _rounded(pred.select_epoch_ssl(v.epochs, ["run_id"], True), "avg_loss", "knn_accuracy")


@query(
    "latest_checkpoint",
    """WITH w AS (SELECT project, stem AS model_id, max(mtime) AS mtime FROM fx_files WHERE stage IN ('02_denoised', '03_deconvolved')
         GROUP BY 1, 2 HAVING count(DISTINCT stage) = 2)
       SELECT project, model_id, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY mtime DESC, model_id DESC) AS rn FROM w) WHERE rn = 1""",
)
def _(v: Views):
    kind = F.when(F.col("stage") == "02_denoised", "weights").otherwise("meta")
    f = v.files.where(F.col("stage").isin("02_denoised", "03_deconvolved")).select(
        "project", F.col("stem").alias("model_id"), kind.alias("kind"), "mtime"
    )
    return pred.latest_checkpoint(f, ["project"]).withColumn("mtime", when_text("mtime"))


@query(
    "active_models",
    """SELECT kind, model_id, strftime(promoted_at, '%Y-%m-%d %H:%M:%S') AS promoted_at FROM (SELECT o_orderstatus AS kind, o_orderkey AS model_id, o_orderdate AS promoted_at,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey % 3 < 2) WHERE rn = 1""",
)
def _(v: Views):
    o = v.table("orders").select(
        F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("model_id"), F.col("o_orderdate").alias("promoted_at"), "o_custkey"
    )
    models = o.where("o_custkey % 3 = 0").drop("o_custkey")
    models = pred.register_model(models, o.where("o_custkey % 3 = 1").drop("o_custkey"))
    models = pred.register_model(models, o.where("o_custkey % 3 = 2").drop("o_custkey", "promoted_at"))
    return pred.active_models(models).withColumn("promoted_at", when_text("promoted_at"))


# --- embeddings -----------------------------------------------------------------------


@query(
    "stratified_split",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(vec_id, ':0'))) AS rk, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
       SELECT vec_id, CAST(label AS BIGINT) AS label, CASE WHEN n > 1 THEN rk <= greatest(1, round_even(n * 0.2, 0)) ELSE false END AS is_val FROM r""",
)
def _(v: Views):
    out = ranking.stratified_split(v.table("embeddings").select("vec_id", "label"), "vec_id", "label")
    return out.select("vec_id", "label", "is_val")


def _ids(v: Views):
    return v.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_GRAPH = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, {dist} AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
    SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 4"""

_DIST = {
    "euclidean": "list_distance(a.v, b.v)",
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
    "correlation": "1 - list_cosine_similarity(list_transform(a.v, lambda q: q - list_avg(a.v)), list_transform(b.v, lambda q: q - list_avg(b.v)))",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda q: abs(q[1] - q[2])))",
}


def _graph(metric):
    def build(v: Views):
        return emb.knn_graph(_ids(v), 4, metric).withColumn("distance", r6("distance"))

    return build


for _metric, _expr in _DIST.items():
    _name = "knn_graph" if _metric == "euclidean" else f"knn_graph_{_metric}"
    query(_name, _GRAPH.format(dist=_expr))(_graph(_metric))


_APPROX = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings),
    p1 AS (SELECT v AS p, j - 1 AS j FROM (SELECT v, row_number() OVER (ORDER BY h, vec_id) AS j FROM e) WHERE j <= 6),
    d1 AS (SELECT e.vec_id, e.v, e.h, j AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e.v, p), j) AS near FROM e, p1),
    p2 AS (SELECT cell, v AS p, j - 1 AS j FROM (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY h, vec_id) AS j FROM d1 WHERE near = 1) WHERE j <= 6),
    d2 AS (SELECT d1.vec_id, d1.v, d1.near AS own, d1.cell * 6 + j AS cell, list_distance(d1.v, p) AS away FROM d1 JOIN p2 USING (cell) WHERE d1.near <= 5),
    c AS (SELECT vec_id, v, arg_min(cell, struct_pack(a := away, c := cell)) AS cell FROM d2 WHERE own = 1 GROUP BY 1, 2),
    q AS (SELECT vec_id, v, cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY away, cell) AS near FROM d2) WHERE near <= 5),
    d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, list_distance(q.v, c.v) AS distance FROM q JOIN c USING (cell) WHERE q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
    SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 4"""


@query("knn_graph_approx", _APPROX)
def _(v: Views):
    out = approximate.knn_graph_approx(_ids(v), 4, fan=6, levels=2, probes=5)
    return out.withColumn("distance", r6("distance"))


_KNN = """r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY md5(concat(vec_id, ':0'))) AS rk, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    s AS (SELECT *, CASE WHEN n > 1 THEN rk <= greatest(1, round_even(n * 0.2, 0)) ELSE false END AS is_val FROM r),
    d AS (SELECT a.vec_id AS query_id, a.label AS truth, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
          FROM s a JOIN s b ON a.is_val AND NOT b.is_val),
    c AS (SELECT query_id, truth, label, count(*) AS n, min(rank) AS first FROM d WHERE rank <= 5 GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS rn FROM c)"""


@query("knn_vote", f"WITH {_KNN} SELECT query_id, CAST(label AS BIGINT) AS predicted FROM b WHERE rn = 1")
def _(v: Views):
    s = materialize(ranking.stratified_split(_ids(v), "id", "label"), "split")  # both sides are read several times
    return emb.knn_vote(emb.knn_join(s.where("is_val"), s.where("not is_val"), 5))


@query(
    "knn_accuracy",
    f"""WITH {_KNN} SELECT (SELECT count(*) FROM s WHERE NOT is_val) AS n_train, count(*) AS n_val, round(avg(CASE WHEN label = truth THEN 1.0 ELSE 0 END), 6) AS accuracy
       FROM b WHERE rn = 1""",
)
def _(v: Views):
    return emb.knn_accuracy(_ids(v)).withColumn("accuracy", r6("accuracy"))


@query(
    "embedding_health",
    """WITH e AS (SELECT a.vec_id, unnest(a.embedding) AS z1, unnest(b.embedding) AS z2, generate_subscripts(a.embedding, 1) AS i
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
       u AS (SELECT 1 AS view, vec_id, i, CAST(z1 AS DOUBLE) * 3 AS z FROM e UNION ALL SELECT 2, vec_id, i, CAST(z2 AS DOUBLE) * 3 FROM e),
       c AS (SELECT a.view, a.i, b.i AS j, covar_samp(a.z, b.z) AS c FROM u a JOIN u b ON a.view = b.view AND a.vec_id = b.vec_id GROUP BY 1, 2, 3),
       p AS (SELECT (SELECT avg(pow(CAST(z1 AS DOUBLE) * 3 - CAST(z2 AS DOUBLE) * 3, 2)) FROM e) AS sim, sum(CASE WHEN i = j THEN greatest(0, 1 - sqrt(c + 1e-4)) END) / 64 AS std,
           sum(CASE WHEN i <> j THEN c * c END) / 64 AS cov FROM c)
       SELECT round(sim, 6) AS sim, round(std, 6) AS std, round(cov, 6) AS cov, round(25 * sim + 25 * std + cov, 5) AS total FROM p""",
)
def _(v: Views):
    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("z"))
    second = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("z").alias("z2"))
    out = emb.embedding_health(e.withColumnRenamed("z", "z1").join(second, "vec_id"))
    return out.select(r6("sim").alias("sim"), r6("std").alias("std"), r6("cov").alias("cov"), F.round("total", 5).alias("total"))


_CENTROID = """m AS (SELECT truth, i, avg(z) AS m FROM (SELECT truth, CAST(unnest(embedding) AS DOUBLE) AS z, generate_subscripts(embedding, 1) AS i FROM fx_vecs
         JOIN fx_vec_tags USING (project, fov_id, cell_id) WHERE confidence IS NULL) GROUP BY 1, 2),
    d AS (SELECT vec_id, m.truth AS pred, sqrt(sum(pow(z - m, 2))) AS dist FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS z, generate_subscripts(embedding, 1) AS i FROM fx_vecs) q
         JOIN m USING (i) GROUP BY 1, 2),
    best AS (SELECT vec_id, arg_min(pred, dist) AS pred, exp(-min(dist)) / sum(exp(-dist)) AS score FROM d GROUP BY 1),
    sc AS (SELECT v.project, v.fov_id, v.cell_id, v.vec_id, pred, score FROM best JOIN fx_vecs v USING (vec_id))"""


def _centroids(v: Views):
    confirmed = v.vecs.join(tags.confirmed_records(v.vec_tags), KEY)
    return classify.NearestCentroid.fit(confirmed)


@query("predict_tiles", f"WITH {_CENTROID} SELECT cell_id, pred, round(score, 6) AS score FROM sc")
def _(v: Views):
    return classify.predict_tiles(v.vecs, _centroids(v)).select("cell_id", "pred", r6("score").alias("score"))


@query(
    "classify_pool",
    f"""WITH {_CENTROID} SELECT sc.cell_id, CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN g.category ELSE pred END AS category,
        round(CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN NULL ELSE score END, 6) AS confidence
        FROM sc LEFT JOIN fx_vec_tags g USING (project, fov_id, cell_id)""",
)
def _(v: Views):
    new_tags, _report = classify.classify_pool(v.vecs, v.vec_tags, _centroids(v))
    return new_tags.select("cell_id", "category", r6("confidence").alias("confidence"))


@query(
    "classify_pool_report",
    f"""WITH {_CENTROID} SELECT count(*) AS n_total, count(CASE WHEN g.category IS NULL THEN 1 END) AS n_new, count(CASE WHEN g.confidence IS NOT NULL THEN 1 END) AS n_replaced,
        count(CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN 1 END) AS n_human, count(CASE WHEN g.confidence IS NULL AND g.category = pred THEN 1 END) AS n_agree,
        count(CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL AND vec_id % 2 = 1 THEN 1 END) AS n_unseen, round(avg(score), 6) AS mean_confidence
        FROM sc LEFT JOIN fx_vec_tags g USING (project, fov_id, cell_id)""",
)
def _(v: Views):
    trained = v.vecs.where("vec_id % 2 = 0").select(*KEY)
    _tags, report = classify.classify_pool(v.vecs, v.vec_tags, _centroids(v), trained)
    return report.select(
        "n_total", "n_new", "n_replaced", "n_human", "n_agree", "n_unseen", r6("mean_confidence").alias("mean_confidence")
    )


_PROBE = """WITH cf AS (SELECT v.*, g.category FROM fx_vecs v JOIN fx_vec_tags g USING (project, fov_id, cell_id) WHERE g.confidence IS NULL),
    r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY md5(concat(project, '/', fov_id, '/', cell_id, ':0'))) AS rk, count(*) OVER (PARTITION BY category) AS n FROM cf),
    s AS (SELECT category, CASE WHEN n > 1 THEN rk <= greatest(1, round_even(n * 0.2, 0)) ELSE false END AS is_val FROM r),
    k AS (SELECT count(DISTINCT category) AS k, count(CASE WHEN NOT is_val THEN 1 END) AS t FROM s)
    SELECT category, count(CASE WHEN NOT is_val THEN 1 END) AS n_train, count(CASE WHEN is_val THEN 1 END) AS n_val,
      round(any_value(t) / (any_value(k) * greatest(count(CASE WHEN NOT is_val THEN 1 END), 1)), 6) AS weight, true AS recorded FROM s, k GROUP BY 1"""


@query("train_probe", _PROBE)
def _(v: Views):
    out = models.train_probe_job(v.vecs, v.vec_tags, scratch_dir(v.spark, "models"), "probe", max_iter=20)
    return out.select("category", "n_train", "n_val", r6("weight").alias("weight"), "recorded")


@query(
    "classify_pool_probe",
    """WITH m AS (SELECT truth, i, avg(z) AS m FROM (SELECT truth, CAST(unnest(embedding) AS DOUBLE) AS z, generate_subscripts(embedding, 1) AS i FROM fx_vecs
         JOIN fx_vec_tags USING (project, fov_id, cell_id) WHERE confidence IS NULL) GROUP BY 1, 2),
       l AS (SELECT vec_id, m.truth AS pred, sum(2 * z * m - m * m) AS z FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS z, generate_subscripts(embedding, 1) AS i FROM fx_vecs) q
         JOIN m USING (i) GROUP BY 1, 2),
       best AS (SELECT vec_id, arg_max(pred, z) AS pred, exp(max(z)) / sum(exp(z)) AS score FROM l GROUP BY 1)
       SELECT cell_id, CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN g.category ELSE pred END AS category,
         round(CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN NULL ELSE score END, 6) AS confidence,
         g.category IS NOT NULL AND g.confidence IS NULL AS learned
       FROM best JOIN fx_vecs USING (vec_id) LEFT JOIN fx_vec_tags g USING (project, fov_id, cell_id)""",
)
def _(v: Views):
    """A model row is written with its provenance, loaded again and used for the whole pool."""
    folder = scratch_dir(v.spark, "models")
    confirmed = v.vecs.join(tags.confirmed_records(v.vec_tags), KEY)
    models.save_model(v.spark, folder, "means", models.LinearProbe.from_means(confirmed), confirmed)
    new_tags, _report = classify.classify_pool(v.vecs, v.vec_tags, models.load_predictor(v.spark, folder, "means"))
    seen = pred.seen_in_training(new_tags, models.read_provenance(v.spark, folder, "means"), KEY)
    return seen.select("cell_id", "category", r6("confidence").alias("confidence"), F.col("seen").alias("learned"))


@query(
    "evaluate_embeddings",
    """WITH cf AS (SELECT v.*, g.category FROM fx_vecs v JOIN fx_vec_tags g USING (project, fov_id, cell_id) WHERE g.confidence IS NULL),
       r AS (SELECT *, concat_ws('/', project, fov_id, cell_id) AS id, CAST(embedding AS DOUBLE[]) AS v FROM cf),
       s AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(concat(id, ':0'))) AS rk, count(*) OVER (PARTITION BY category) AS n FROM r),
       t AS (SELECT *, CASE WHEN n > 1 THEN rk <= greatest(1, round_even(n * 0.2, 0)) ELSE false END AS is_val FROM s),
       d AS (SELECT a.id AS q, a.category AS truth, b.category, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM t a JOIN t b ON a.is_val AND NOT b.is_val),
       c AS (SELECT q, truth, category, count(*) AS n, min(rank) AS first FROM d WHERE rank <= 5 GROUP BY 1, 2, 3),
       b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, first) AS rn FROM c)
       SELECT (SELECT count(*) FROM cf) AS n_confirmed, (SELECT count(DISTINCT category) FROM cf) AS n_categories,
         least(60, (SELECT count(*) FROM fx_vecs) - (SELECT count(*) FROM cf)) AS n_unlabeled, (SELECT count(*) FROM t WHERE NOT is_val) AS n_train,
         count(*) AS n_val, round(avg(CASE WHEN category = truth THEN 1.0 ELSE 0 END), 6) AS accuracy FROM b WHERE rn = 1""",
)
def _(v: Views):
    out = classify.evaluate_embeddings(v.vecs, v.vec_tags, "sample", 60)
    return out.withColumn("accuracy", r6("accuracy"))


# --- lineage --------------------------------------------------------------------------

_SRC = """srcs AS (SELECT f.project, o.override, max(stage) FILTER (stage IN ('01_reduced', '02_denoised', '03_deconvolved')) AS auto,
      max(stage) FILTER (stage IN ('01_reduced', '02_denoised')) AS dec,
      coalesce(bool_or(stage = o.override), false) AS has FROM fx_files f JOIN fx_overrides o USING (project) GROUP BY 1, 2),
    act AS (SELECT project, dec, CASE WHEN override IS NULL THEN auto WHEN has THEN override END AS source_stage FROM srcs)"""


@query("resolve_source_stage", f"WITH {_SRC} SELECT project, source_stage FROM act")
def _(v: Views):
    return lineage.resolve_source_stage(v.files, overrides=v.overrides)


_STATUS = _SRC + """,
    feed AS (SELECT f.project, f.stage, f.stem, f.mtime, CASE f.stage WHEN '01_reduced' THEN 'raw' WHEN '02_denoised' THEN '01_reduced' ELSE dec END AS upstream
       FROM fx_files f JOIN act USING (project) WHERE f.stage IN ('01_reduced', '02_denoised', '03_deconvolved')),
    mt AS (SELECT d.*, u.mtime AS up FROM feed d LEFT JOIN fx_files u ON u.project = d.project AND u.stage = d.upstream AND u.stem = d.stem),
    av AS (SELECT project, stage, count(up) > 0 OR bool_or(upstream IS NULL) AS ok FROM mt GROUP BY 1, 2),
    st AS (SELECT mt.project, mt.stage, mt.stem, mt.upstream, CASE WHEN upstream IS NULL OR NOT ok THEN true WHEN up IS NULL THEN false ELSE mtime >= up END AS up_to_date,
       ok AS upstream_available FROM mt JOIN av USING (project, stage))"""


@query("stage_file_status", f"WITH {_STATUS} SELECT * FROM st")
def _(v: Views):
    return lineage.stage_file_status(v.files)


@query(
    "segmentation_status",
    """SELECT m.project, m.stem, coalesce(m.mtime >= f.mtime, false) AS up_to_date FROM fx_masks m
       LEFT JOIN fx_files f ON f.project = m.project AND f.stem = m.stem AND f.stage = '01_reduced'""",
)
def _(v: Views):
    return lineage.segmentation_status(v.masks, v.files.where("stage = '01_reduced'"))


_TILE_STATUS = """ts AS (SELECT f.project, f.stem AS fov_id, coalesce(n.n_cells, 0) AS n_cells, mp.project IS NOT NULL AS mask_available,
      CASE WHEN mp.project IS NULL THEN true ELSE coalesce(f.mtime >= m.mtime, false) END AS up_to_date FROM fx_files f
    LEFT JOIN (SELECT concat('s', l_partkey) AS stem, count(DISTINCT l_suppkey) AS n_cells FROM lineitem GROUP BY 1) n ON n.stem = f.stem
    LEFT JOIN fx_masks m ON m.project = f.project AND m.stem = f.stem
    LEFT JOIN (SELECT DISTINCT project FROM fx_masks) mp ON mp.project = f.project WHERE f.stage = '05_tiles')"""


def _tile_status(v: Views):
    pairs = v.table("lineitem").select("l_partkey", "l_suppkey").distinct()
    counts = pairs.groupBy(
        (F.col("l_partkey") % 10).alias("project"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("fov_id")
    ).agg(F.count(F.lit(1)).alias("n_cells"))
    tiles = v.files.where("stage = '05_tiles'").select("project", F.col("stem").alias("fov_id"), "mtime")
    masks = v.masks.select("project", F.col("stem").alias("fov_id"), "mtime")
    return lineage.fov_tile_status(tiles, counts, masks)


@query("fov_tile_status", f"WITH {_TILE_STATUS} SELECT project, fov_id, n_cells, up_to_date, mask_available FROM ts")
def _(v: Views):
    return _tile_status(v)


@query(
    "pending_files",
    """SELECT project, stem FROM fx_files WHERE stage = 'raw' EXCEPT SELECT project, stem FROM fx_files WHERE stage = '01_reduced'""",
)
def _(v: Views):
    return lineage.pending_files(v.files, lineage.RAW, lineage.REDUCED)


_STAGES = ", ".join(f"({i}, '{s}', {str(o).lower()})" for i, s, o in lineage.STAGES)


@query(
    "stage_status",
    f"""WITH {_STATUS}, agg AS (SELECT project, stage, bool_and(upstream_available) AS av, bool_and(up_to_date) AS fr FROM st GROUP BY 1, 2),
       cnt AS (SELECT project, stage, count(*) AS n FROM fx_files GROUP BY 1, 2), mk AS (SELECT DISTINCT project FROM fx_masks)
       SELECT act.project, CAST(p.position AS BIGINT) AS position, p.stage, p.optional, CASE WHEN p.stage = 'segmentation' THEN CASE WHEN mk.project IS NOT NULL THEN 'done' ELSE 'empty' END
           WHEN cnt.n IS NULL THEN 'empty' WHEN p.stage IN ('raw', '05_tiles') THEN 'done' WHEN NOT av THEN 'archived' WHEN fr THEN 'done' ELSE 'stale' END AS status,
         coalesce(p.stage = act.source_stage, false) AS active
       FROM act CROSS JOIN (VALUES {_STAGES}) p(position, stage, optional) LEFT JOIN cnt ON cnt.project = act.project AND cnt.stage = p.stage
       LEFT JOIN agg ON agg.project = act.project AND agg.stage = p.stage LEFT JOIN mk ON mk.project = act.project""",
)
def _(v: Views):
    return lineage.stage_status(v.stored_files, v.masks, v.overrides)


_INPUTS = _SRC + """, inp AS (SELECT project, stage, input_stage FROM (SELECT project, unnest(['02_denoised', '03_deconvolved', 'segmentation', '05_tiles']) AS stage,
    unnest(['01_reduced', dec, source_stage, source_stage]) AS input_stage FROM act))"""


@query("stage_inputs", f"WITH {_INPUTS} SELECT * FROM inp")
def _(v: Views):
    return lineage.stage_inputs(v.files, v.overrides)


@query(
    "stage_consumers",
    f"WITH {_INPUTS} SELECT project, input_stage, string_agg(stage, ',' ORDER BY stage) AS consumers FROM inp WHERE input_stage IS NOT NULL GROUP BY 1, 2",
)
def _(v: Views):
    out = lineage.stage_consumers(lineage.stage_inputs(v.files, v.overrides))
    return out.withColumn("consumers", F.array_join("consumers", ","))


@query(
    "stage_run_log",
    """SELECT project, stage, strftime(max(mtime), '%Y-%m-%d %H:%M:%S') AS last_run, count(DISTINCT stem) AS n_stems FROM fx_files GROUP BY 1, 2""",
)
def _(v: Views):
    return lineage.stage_run_log(v.files).withColumn("last_run", when_text("last_run"))


# A third of the stems has one channel, whatever its orders.
_DONE = """dn AS (SELECT project, stem, count(DISTINCT channel) AS k, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels
    FROM (SELECT o_custkey % 10 AS project, concat('s', o_custkey) AS stem, CASE WHEN o_custkey % 3 = 0 THEN '0' ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS channel FROM orders) GROUP BY 1, 2)"""


def _channels_done(v: Views):
    o = v.table("orders").select(
        (F.col("o_custkey") % 10).alias("project"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("stem"),
        F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 2).alias("channel"),
    )
    return lineage.merge_channels_done(o)


@query("merge_channels_done", f"WITH {_DONE} SELECT project, stem, channels FROM dn")
def _(v: Views):
    out = _channels_done(v)
    return out.withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))


@query(
    "project_status",
    f"""WITH {_STATUS}, {_TILE_STATUS}, {_DONE},
       sg AS (SELECT m.project, m.stem, f.stage, CASE WHEN m.mtime >= f.mtime THEN 'done' ELSE 'stale' END AS seg_state FROM fx_masks m
         JOIN act USING (project) JOIN fx_files f ON f.project = m.project AND f.stem = m.stem AND f.stage = act.source_stage)
       SELECT r.project, r.stage, r.stem, CASE WHEN d.stem IS NOT NULL THEN 'done' ELSE 'unprocessed' END AS state, CAST(NULL AS VARCHAR) AS seg_state
         FROM fx_files r LEFT JOIN fx_files d ON d.project = r.project AND d.stem = r.stem AND d.stage = '01_reduced' WHERE r.stage = 'raw'
       UNION ALL SELECT st.project, st.stage, st.stem, CASE WHEN NOT upstream_available THEN 'archived' WHEN st.stage = '02_denoised' AND up_to_date THEN
           CASE WHEN dn.k = 1 THEN 'partial' ELSE 'done' END WHEN up_to_date THEN 'done' ELSE 'stale' END, sg.seg_state
         FROM st LEFT JOIN dn ON dn.project = st.project AND dn.stem = st.stem LEFT JOIN sg ON sg.project = st.project AND sg.stem = st.stem AND sg.stage = st.stage
       UNION ALL SELECT project, '05_tiles', fov_id, CASE WHEN NOT mask_available THEN 'archived' WHEN up_to_date THEN 'done' ELSE 'stale' END, NULL FROM ts""",
)
def _(v: Views):
    return lineage.project_status(v.stored_files, v.masks, _channels_done(v), _tile_status(v), v.overrides)


@query(
    "infer_channels",
    """WITH ch AS (SELECT l_orderkey AS file, l_linenumber AS idx, CASE WHEN l_partkey % 5 = 0 THEN 'BF_100ms' WHEN l_partkey % 5 = 1 THEN 'mTagBFP2' WHEN l_partkey % 5 = 2 THEN 'DAPI'
           WHEN l_partkey % 5 = 3 THEN 'Brightfield2' END AS name, CASE WHEN l_suppkey % 3 = 0 THEN '460' WHEN l_suppkey % 3 = 1 THEN 'n/a' ELSE '520.5' END AS emission FROM lineitem),
       a AS (SELECT file, count(*) AS n, min(idx) FILTER (name IN ('BF_100ms', 'Brightfield2')) AS bf, coalesce(min(idx) FILTER (name = 'DAPI'), min(idx) FILTER (emission = '460')) AS tg FROM ch GROUP BY 1)
       SELECT file, CAST(CASE WHEN n >= 2 AND bf <> tg THEN bf END AS BIGINT) AS brightfield, CAST(CASE WHEN n >= 2 AND bf <> tg THEN tg END AS BIGINT) AS projection FROM a""",
)
def _(v: Views):
    m, s = F.col("l_partkey") % 5, F.col("l_suppkey") % 3
    ch = v.table("lineitem").select(
        F.col("l_orderkey").alias("file"),
        F.col("l_linenumber").alias("idx"),
        F.when(m == 0, "BF_100ms").when(m == 1, "mTagBFP2").when(m == 2, "DAPI").when(m == 3, "Brightfield2").alias("name"),
        F.when(s == 0, "460").when(s == 1, "n/a").otherwise("520.5").alias("emission"),
    )
    return lineage.infer_channels(ch, ["file"])
