"""Predictions against tags and truth, training provenance, and model records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TAG_KEY
from ..session import literal_table
from .skew import salted_join


def reconcile_predictions(predictions: DataFrame, tags: DataFrame) -> DataFrame:
    """What each prediction means for the tag now on its tile.

    ``new`` (no tag), ``replaced`` (an unconfirmed model tag), ``human``
    (confirmed; the prediction only serves as a check).
    """
    current = tags.select(*TAG_KEY, "category", F.col("confidence").alias("_conf"))
    p = predictions.join(current, TAG_KEY, "left")
    status = (
        F.when(F.col("category").isNull(), "new").when(F.col("_conf").isNotNull(), "replaced").otherwise("human")
    )
    return p.withColumn("status", status).withColumn(
        "agrees", F.when(F.col("status") == "human", F.col("pred") == F.col("category"))
    ).drop("_conf")


def seen_in_training(tiles: DataFrame, provenance: DataFrame, key: list[str]) -> DataFrame:
    """Tiles flagged by whether the model was trained on them; ``provenance`` is distinct on ``key``."""
    return tiles.join(provenance.select(*key).withColumn("_seen", F.lit(True)), key, "left").withColumn(
        "seen", F.coalesce("_seen", F.lit(False))
    ).drop("_seen")


def provenance_usable(provenance: DataFrame, present: DataFrame, container: list[str]) -> DataFrame:
    """One row: does any recorded container exist here at all.

    A record made elsewhere matches nothing, and "not trained on" would then
    wrongly hold for every tile.
    """
    hits = provenance.select(*container).distinct().join(present.select(*container).distinct(), container, "left_semi")
    return hits.agg((F.count(F.lit(1)) > 0).alias("usable"))


def provenance_overlap(tiles: DataFrame, provenance: DataFrame, key: list[str], recorded: bool = True) -> DataFrame:
    """(already seen, total) of the tiles about to be trained on; NULL seen without a record."""
    flagged = seen_in_training(tiles, provenance, key)
    seen = F.count_if(F.col("seen")) if recorded else F.lit(None).cast("long")
    return flagged.agg(seen.alias("already_seen"), F.count(F.lit(1)).alias("total"))


def training_provenance(records: DataFrame, container: list[str], label: str, block: int = 4096) -> DataFrame:
    """Sorted labels per container, in runs of ``block`` consecutive label numbers.

    A run holds at most ``block`` labels however large its container is, so no
    row grows with the data; the runs of a container, in order, are its list.
    """
    rows = records.select(*container, F.col(label).cast("long").alias("label"))
    runs = rows.groupBy(*container, F.floor(F.col("label") / block).cast("long").alias("run"))
    out = runs.agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return out.withColumn("n", F.size("labels").cast("long"))


def inference_report(
    predictions: DataFrame, tags: DataFrame, provenance: DataFrame | None = None, key: list[str] | None = None
) -> DataFrame:
    """The one-row account of an inference run.

    Unseen counts are NULL unless the model's training record can be matched to
    at least one of the containers scored.
    """
    r = reconcile_predictions(predictions, tags)
    key = key or TAG_KEY
    if provenance is None:
        r = r.withColumn("seen", F.lit(None).cast("boolean")).withColumn("_known", F.lit(False))
    else:
        r = seen_in_training(r, provenance, key)
        known = provenance.select(*key[:-1]).distinct().withColumn("_known", F.lit(True))
        r = salted_join(r, known, key[:-1], "left", salt_on=[key[-1]])
    human = F.col("status") == "human"
    unseen = human & ~F.coalesce(F.col("seen"), F.lit(False))
    usable = F.coalesce(F.max(F.col("_known")), F.lit(False))

    def ratio(a, b):
        return a / F.nullif(b, F.lit(0))

    out = r.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("status") == "new").alias("n_new"),
        F.count_if(F.col("status") == "replaced").alias("n_replaced"),
        F.count_if(human).alias("n_human"),
        F.count_if(human & F.col("agrees")).alias("n_agree"),
        F.when(usable, F.count_if(unseen)).alias("n_unseen"),
        F.when(usable, F.count_if(unseen & F.col("agrees"))).otherwise(F.lit(0)).alias("n_agree_unseen"),
        F.avg(F.col("score")).alias("mean_confidence"),
    )
    return out.withColumn("accuracy_human", ratio(F.col("n_agree"), F.col("n_human"))).withColumn(
        "accuracy_unseen", ratio(F.col("n_agree_unseen"), F.col("n_unseen"))
    )


def prediction_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(F.col("pred").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_confidence")
    )


def evaluate_predictions(pairs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Accuracy per class of ``(truth, pred)`` pairs; a class without examples scores 0."""
    classes = literal_table(pairs.sparkSession, [(c,) for c in vocabulary], "truth string")
    counts = pairs.groupBy("truth").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("n_correct")
    )
    joined = classes.join(counts, "truth", "left").select(
        F.col("truth").alias("category"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_correct", F.lit(0)).alias("n_correct"),
    )
    return joined.withColumn(
        "accuracy", F.coalesce(F.col("n_correct") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    )


def overall_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("truth") == F.col("pred")) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("accuracy"),
    )


def confusion_matrix(pairs: DataFrame, vocabulary: list[str]) -> DataFrame:
    cells = [F.count_if(F.col("pred") == c).alias(c) for c in vocabulary]
    return pairs.groupBy("truth").agg(*cells)


def class_weights(labels: DataFrame, column: str, vocabulary: list) -> DataFrame:
    """Inverse-frequency weight per listed class; a missing class weighs as if seen once."""
    spark = labels.sparkSession
    kind = labels.schema[column].dataType.simpleString()
    classes = literal_table(spark, [(c,) for c in vocabulary], f"{column} {kind}")
    counts = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(classes.withColumn("_listed", F.lit(True)), column, "full_outer")
    # One row per class; the total also counts labels outside the list.
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    weighted = joined.withColumn("_total", total).where(F.col("_listed"))
    return weighted.select(
        F.col(column).alias("label"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("_total") / (F.lit(len(vocabulary)) * F.coalesce("n", F.lit(1)))).alias("weight"),
    )


def target_categories(labels: DataFrame, column: str, vocabulary: list | None = None) -> DataFrame:
    """Distinct labels, each marked by whether the vocabulary knows it."""
    found = labels.select(F.col(column).alias("label")).distinct()
    known = F.lit(True) if vocabulary is None else F.col("label").isin(vocabulary)
    return found.withColumn("known", known)


def require_known(targets: DataFrame) -> DataFrame:
    """Fails the job if a label is outside the vocabulary."""
    msg = F.concat(F.lit("label outside the vocabulary: "), F.col("label").cast("string"))
    return targets.where(F.when(F.col("known"), F.lit(True)).otherwise(F.raise_error(msg).cast("boolean")))


# --- choosing epochs and models -------------------------------------------------


def select_epoch(epochs: DataFrame, run: list[str], completed: bool) -> DataFrame:
    """Cancelled runs keep the first epoch with the best validation accuracy, completed ones the last."""
    if completed:
        best = F.max_by(F.struct("epoch", "avg_loss", "val_accuracy"), F.col("epoch"))
    else:
        order = F.struct(F.col("val_accuracy"), -F.col("epoch"))
        best = F.max_by(F.struct("epoch", "avg_loss", "val_accuracy"), order)
    return epochs.groupBy(*run).agg(best.alias("_e")).select(*run, "_e.epoch", "_e.avg_loss", "_e.val_accuracy")


def select_epoch_ssl(epochs: DataFrame, run: list[str], completed: bool) -> DataFrame:
    """Best kNN score if any epoch was scored; otherwise lowest loss (cancelled) or last (completed)."""
    row = F.struct("epoch", "avg_loss", "knn_accuracy")
    scored = F.col("knn_accuracy").isNotNull()
    by_knn = F.max_by(row, F.when(scored, F.struct(F.col("knn_accuracy"), -F.col("epoch"))))
    fallback_order = F.struct(F.col("epoch"), F.col("epoch")) if completed else F.struct(-F.col("avg_loss"), -F.col("epoch"))
    other = F.max_by(row, fallback_order)
    picked = epochs.groupBy(*run).agg(by_knn.alias("_k"), other.alias("_o"))
    return picked.select(
        *run,
        F.coalesce(F.col("_k.epoch"), F.col("_o.epoch")).alias("epoch"),
        F.coalesce(F.col("_k.avg_loss"), F.col("_o.avg_loss")).alias("avg_loss"),
        F.col("_k.knn_accuracy").alias("knn_accuracy"),
        F.when(F.col("_k.epoch").isNotNull(), "knn").otherwise("last" if completed else "loss").alias("selected_by"),
    )


def latest_checkpoint(files: DataFrame, group: list[str]) -> DataFrame:
    """Newest checkpoint per group among those with both of their files present.

    ``files`` is ``(group…, model_id, kind, mtime)`` with kinds ``weights`` and ``meta``.
    """
    whole = (
        files.groupBy(*group, "model_id")
        .agg(
            F.max(F.col("kind") == "weights").alias("_w"),
            F.max(F.col("kind") == "meta").alias("_m"),
            F.max("mtime").alias("mtime"),
        )
        .where(F.col("_w") & F.col("_m"))
    )
    newest = F.max(F.struct("mtime", "model_id"))
    return whole.groupBy(*group).agg(newest.alias("_l")).select(*group, "_l.model_id", "_l.mtime")


def register_model(models: DataFrame, new: DataFrame) -> DataFrame:
    """Append-only registry; nothing already recorded is lost."""
    return models.unionByName(new, allowMissingColumns=True)


def active_models(models: DataFrame) -> DataFrame:
    """The model in use per kind: the one promoted last."""
    newest = F.max(F.struct("promoted_at", "model_id"))
    promoted = models.where(F.col("promoted_at").isNotNull())
    return promoted.groupBy("kind").agg(newest.alias("_m")).select("kind", "_m.model_id", "_m.promoted_at")
