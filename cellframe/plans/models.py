"""Trained models as table rows: written by the job that trains them, loaded by the jobs that predict.

A folder holds two append-only tables. ``provenance`` (a partition per model) names every tile a model learned from;
``models`` has one row per model with all that inference needs. A training job writes the provenance first and the
model row last: the row is the commit, and a job that was lost before it leaves nothing that is ever read and may run again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import predictions as pred
from ..operators import tags as tag_ops
from ..schemas import TAG_KEY
from ..session import literal_table, materialize
from .classify import PREDICTORS, Predictor, train_probe

MODELS = (
    "model_id string, kind string, labels array<string>, coefficients array<array<double>>, intercepts array<double>, "
    "n_train long, n_val long, accuracy double"
)


class LinearProbe:
    """A linear layer and a softmax over frozen features; equal scores go to the first label."""

    def __init__(self, labels: list[str], coefficients: list[list[float]], intercepts: list[float]):
        self.labels, self.coefficients, self.intercepts = labels, coefficients, intercepts

    @classmethod
    def from_means(cls, df: DataFrame, label: str = "category") -> "LinearProbe":
        """The layer that prefers the nearest class mean: twice the mean as weights, minus its square as intercept."""
        vectors = df.select(label, array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("v"))
        means = vectors.groupBy(label).agg(Summarizer.mean(F.col("v")).alias("m")).select(label, vector_to_array("m").alias("m"))
        rows = means.orderBy(label).collect()  # classes times dimensions numbers
        m = np.array([r["m"] for r in rows])
        return cls([r[label] for r in rows], (2 * m).tolist(), (-(m * m).sum(axis=1)).tolist())

    def load(self) -> Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]:
        w, b = np.asarray(self.coefficients, dtype=np.float64), np.asarray(self.intercepts, dtype=np.float64)
        names = np.asarray(self.labels, dtype=object)

        def predict(vectors: pd.Series):
            z = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) @ w.T + b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return names[z.argmax(axis=1)], e.max(axis=1) / e.sum(axis=1)

        return predict


PREDICTORS["linear_probe"] = LinearProbe


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """All model rows of a folder; none where nothing was trained yet."""
    try:
        return spark.read.schema(MODELS).parquet(f"{folder}/models")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MODELS)


def read_provenance(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    """The tiles a model was trained on, with the category it was told."""
    rows = spark.read.parquet(f"{folder}/provenance").where(F.col("model_id") == model_id)
    return rows.select(*TAG_KEY, "category")


def save_model(
    spark: SparkSession, folder: str, model_id: str, model: LinearProbe, trained_on: DataFrame, n_val: int = 0, accuracy: float | None = None
) -> None:
    """Provenance of ``trained_on`` (tag key, category), then the model row. A name is used once."""
    if read_models(spark, folder).where(F.col("model_id") == model_id).limit(1).count():
        raise ValueError(f"model {model_id!r} exists")
    place = f"{folder}/provenance/model_id={model_id}"
    trained_on.select(*TAG_KEY, "category").write.mode("overwrite").parquet(place)
    n_train = spark.read.parquet(place).count()
    row = (model_id, "linear_probe", model.labels, model.coefficients, model.intercepts, n_train, n_val, accuracy)
    literal_table(spark, [row], MODELS).coalesce(1).write.mode("append").parquet(f"{folder}/models")


def load_predictor(spark: SparkSession, folder: str, model_id: str) -> Predictor:
    """The predictor of a model row; classes times dimensions numbers come to the driver and go to each task once."""
    row = read_models(spark, folder).where(F.col("model_id") == model_id).first()
    if row is None:
        raise ValueError(f"no model {model_id!r} in {folder}")
    return PREDICTORS[row["kind"]](row["labels"], row["coefficients"], row["intercepts"])


def train_probe_job(
    tiles: DataFrame, tags: DataFrame, folder: str, model_id: str, val_frac: float = 0.2, seed: int = 0, max_iter: int = 50, min_per_class: int = 1
) -> DataFrame:
    """Train on the confirmed tiles, record model and provenance, and report per class.

    Returns ``category, n_train, n_val, n_correct, weight, recorded``: tiles learned from and tried, those predicted right,
    the class weight, and whether the provenance table names as many tiles of the class as were learned from. Classes of
    fewer than ``min_per_class`` confirmed tiles are left out.
    """
    spark = tiles.sparkSession
    confirmed = tiles.join(tag_ops.confirmed_records(tags), TAG_KEY).select(*TAG_KEY, "embedding", "category")
    if min_per_class > 1:
        kept = confirmed.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_per_class)
        confirmed = confirmed.join(kept.select("category"), "category", "left_semi")
    keyed = materialize(confirmed.withColumn("_key", F.concat_ws("/", *TAG_KEY)), "confirmed")
    model, labels, pairs, weights = train_probe(keyed, "_key", val_frac, seed, max_iter)
    pairs = materialize(pairs, "tried")
    learned = keyed.join(pairs.select("_key"), "_key", "left_anti")
    totals = pred.overall_accuracy(pairs).first()
    probe = LinearProbe(labels, model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist())
    save_model(spark, folder, model_id, probe, learned, totals["n"], totals["accuracy"])

    noted = read_provenance(spark, folder, model_id).groupBy("category").agg(F.count(F.lit(1)).alias("noted"))
    taught = learned.groupBy("category").agg(F.count(F.lit(1)).alias("n_train"))
    tried = pred.evaluate_predictions(pairs, labels).select("category", F.col("n").alias("n_val"), "n_correct")
    named = weights.select(F.col("label").alias("category"), "weight")
    report = tried.join(taught, "category", "left").join(noted, "category", "left").join(named, "category", "left")
    n_train = F.coalesce("n_train", F.lit(0))
    return report.select("category", n_train.alias("n_train"), "n_val", "n_correct", "weight", (F.coalesce("noted", F.lit(0)) == n_train).alias("recorded"))
