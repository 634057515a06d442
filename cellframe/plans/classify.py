"""Inference over a pool, linear probes, and embedding evaluation."""

from __future__ import annotations

from typing import Callable, Iterator, Protocol

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import embeddings as emb
from ..operators import predictions as pred
from ..operators import ranking, tags as tag_ops
from ..schemas import TAG_KEY
from ..session import materialize


class Predictor(Protocol):
    """What a classifier offers: loaded once per Python worker, then called batch by batch."""

    def load(self) -> Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]:
        """Returns a function from embeddings to (labels, confidences)."""


class NearestCentroid:
    """Label of the nearest class mean; confidence is the softmax of minus the distances."""

    def __init__(self, labels: list[str], centroids: list[list[float]]):
        self.labels, self.centroids = labels, centroids

    @classmethod
    def fit(cls, df: DataFrame, label: str = "category") -> "NearestCentroid":
        """Class means, aggregated map-side; brings classes * dimensions numbers to the driver."""
        vectors = df.select(label, array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("v"))
        means = vectors.groupBy(label).agg(Summarizer.mean(F.col("v")).alias("m"))
        rows = means.select(label, vector_to_array("m").alias("c")).orderBy(label).collect()
        return cls([r[label] for r in rows], [r["c"] for r in rows])
    def load(self):
        c = np.asarray(self.centroids, dtype=np.float64)
        names = np.asarray(self.labels, dtype=object)

        def predict(vectors: pd.Series):
            a = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
            d = np.sqrt(((a[:, None, :] - c[None, :, :]) ** 2).sum(-1))
            e = np.exp(-(d - d.min(axis=1, keepdims=True)))
            return names[d.argmin(axis=1)], e.max(axis=1) / e.sum(axis=1)

        return predict


# Constructors by name; nothing is built before it is asked for.
PREDICTORS: dict[str, Callable[..., Predictor]] = {"nearest_centroid": NearestCentroid}


def predict_tiles(tiles: DataFrame, predictor: Predictor, chunk: int = 256) -> DataFrame:
    """(tag key, pred, score) of every tile with an ``embedding``; the model loads once per task."""
    def run(batches: Iterator[pd.DataFrame]):
        predict = predictor.load()
        for pdf in batches:
            for start in range(0, len(pdf), chunk):
                part = pdf.iloc[start : start + chunk]
                labels, scores = predict(part["embedding"])
                yield part[TAG_KEY].assign(pred=labels, score=scores)

    schema = T.StructType([T.StructField(k, T.StringType()) for k in TAG_KEY]).add("pred", "string").add("score", "double")
    return tiles.select(*TAG_KEY, "embedding").mapInPandas(run, schema)


def classify_pool(
    tiles: DataFrame, tags: DataFrame, predictor: Predictor, provenance: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new tag table, one-row report). Human tags stay; every other tile gets this model's prediction."""
    # Inference is the dear part: run once, then merged and reported from the stored predictions.
    scored = materialize(predict_tiles(tiles, predictor), "scored")
    as_tags = scored.select(*TAG_KEY, F.col("pred").alias("category"), F.col("score").alias("confidence"))
    return tag_ops.apply_predictions(tags, as_tags), pred.inference_report(scored, tags, provenance)


def train_probe(df: DataFrame, key: str, val_frac: float = 0.2, seed: int = 0, max_iter: int = 50):
    """Weighted logistic regression on frozen features ``(key, embedding, category)``.

    Returns (model, label list, validation pairs, class weights). Fails if
    either side of the split is empty.
    """
    split = ranking.stratified_split(df, key, "category", val_frac, seed)
    sizes = split.agg(F.count_if(~F.col("is_val")).alias("t"), F.count_if("is_val").alias("v")).first()
    if not sizes["t"] or not sizes["v"]:
        raise ValueError("not enough labelled tiles for a train/validation split")
    labels = [r[0] for r in df.select("category").distinct().orderBy("category").collect()]
    train = split.where("not is_val")
    weights = pred.class_weights(train, "category", labels)
    index = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(labels) for v in (c, float(i))]), F.col("category"))
    by_label = F.element_at(
        F.create_map(*[F.lit(v) for r in weights.collect() for v in (r["label"], r["weight"])]), F.col("category")
    )
    features = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    model = LogisticRegression(maxIter=max_iter, family="multinomial", weightCol="w", featuresCol="features", labelCol="y").fit(
        train.select(features.alias("features"), index.alias("y"), by_label.alias("w"))
    )
    names = F.array(*[F.lit(c) for c in labels])
    val = model.transform(split.where("is_val").select(key, "category", features.alias("features")))
    pairs = val.select(
        key, F.col("category").alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("pred")
    )
    return model, labels, pairs, weights


def evaluate_embeddings(
    tiles: DataFrame,
    tags: DataFrame,
    unlabeled: str = "sample",
    n_sample: int = 100,
    k: int = 5,
    seed: int = 0,
) -> DataFrame:
    """One row: confirmed and unlabeled tiles looked at, classes, and the kNN accuracy of the confirmed."""
    records = tag_ops.confirmed_records(tags)
    confirmed = tiles.join(records, TAG_KEY)
    acc = emb.knn_accuracy(
        confirmed.select(F.concat_ws("/", *TAG_KEY).alias("id"), "embedding", F.col("category").alias("label")), k=k, seed=seed
    )
    rest = tag_ops.unlabeled(tiles, tags)
    if unlabeled == "none":
        rest = rest.limit(0)
    elif unlabeled == "sample":
        rest = ranking.sample_rows(rest, "cell_id", n_sample, seed)
    counts = confirmed.agg(F.count(F.lit(1)).alias("n_confirmed"), F.count_distinct("category").alias("n_categories"))
    extra = rest.agg(F.count(F.lit(1)).alias("n_unlabeled"))
    # Three one-row frames side by side.
    stacked = counts.unionByName(extra, allowMissingColumns=True).unionByName(acc, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
