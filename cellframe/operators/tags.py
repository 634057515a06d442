"""Tag tables: one row per tagged tile; a NULL confidence means a human set the tag.

Every change is a pure function ``(current, change) -> new``; ``sources.tile_store``
writes the result back by replacing the touched partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import category_key, tag_source
from ..schemas import TAG_KEY
from .skew import merge_join

TAG_COLUMNS = [*TAG_KEY, "category", "confidence"]


def _set(category):
    return category.isNotNull() & (category != "")


def last_per_key(changes: DataFrame, key: list[str], order: str, *fields: str) -> DataFrame:
    """The latest change of each key; an aggregate, so repeats collapse before the shuffle."""
    packed = F.max_by(F.struct(*fields), F.col(order)).alias("_last")
    return changes.groupBy(*key).agg(packed).select(*key, *[F.col(f"_last.{f}").alias(f) for f in fields])


def apply_human_tags(tags: DataFrame, edits: DataFrame, order: str = "seq") -> DataFrame:
    """Human edits win over anything; an empty category clears the tag."""
    last = last_per_key(edits, TAG_KEY, order, "category").select(
        *TAG_KEY, F.col("category").alias("_new"), F.lit(True).alias("_edited")
    )
    joined = tags.join(last, TAG_KEY, "full_outer")
    edited = F.coalesce(F.col("_edited"), F.lit(False))
    return joined.select(
        *TAG_KEY,
        F.when(edited, F.col("_new")).otherwise(F.col("category")).alias("category"),
        F.when(~edited, F.col("confidence")).alias("confidence"),
    ).where(_set(F.col("category")))


def apply_predictions(
    tags: DataFrame, predictions: DataFrame, mode: str = "replace_ai", order: str | None = None
) -> DataFrame:
    """Model tags never replace a human's.

    ``replace_ai`` also replaces earlier model tags (an empty category clears
    them); ``untagged_only`` leaves every existing tag alone. ``predictions``
    has the tag key, ``category`` and ``confidence``, one row per tile, or
    several with an ``order`` column of which the last counts.
    """
    if order is not None:
        predictions = last_per_key(predictions, TAG_KEY, order, "category", "confidence")
    if mode == "untagged_only":
        new = predictions.where(_set(F.col("category"))).join(tags.select(*TAG_KEY), TAG_KEY, "left_anti")
        return tags.select(*TAG_COLUMNS).unionByName(new.select(*TAG_COLUMNS))
    p = predictions.select(
        *TAG_KEY, F.col("category").alias("_cat"), F.col("confidence").alias("_conf"), F.lit(True).alias("_scored")
    )
    joined = tags.join(p, TAG_KEY, "full_outer")
    human = F.col("category").isNotNull() & F.col("confidence").isNull()
    replaced = F.coalesce(F.col("_scored"), F.lit(False)) & ~human
    return joined.select(
        *TAG_KEY,
        F.when(replaced, F.col("_cat")).otherwise(F.col("category")).alias("category"),
        F.when(replaced, F.col("_conf")).otherwise(F.col("confidence")).alias("confidence"),
    ).where(_set(F.col("category")))


def accept_predictions(tags: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected model tags become human-confirmed."""
    chosen = selected.select(*TAG_KEY).distinct().withColumn("_chosen", F.lit(True))
    return tags.join(chosen, TAG_KEY, "left").select(
        *TAG_KEY, "category", F.when(F.col("_chosen").isNull(), F.col("confidence")).alias("confidence")
    )


def clear_unconfirmed(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("confidence").isNull())


def count_unconfirmed(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count_if(F.col("confidence").isNotNull()).alias("n_removed"))


def remap_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key tags: ``mapping`` holds the tag key and ``new_cell_id`` (NULL drops the tag).

    A moved tag replaces the one it lands on unless that one moves away too;
    confidences travel along. Old keys are read before new ones are written, so
    swaps work.
    """
    m = mapping.select(*TAG_KEY, "new_cell_id", F.lit(True).alias("_mapped"))
    joined = merge_join(tags, m, TAG_KEY, "left")
    mapped = F.col("_mapped").isNotNull()
    placed = joined.where(~mapped | F.col("new_cell_id").isNotNull()).select(
        "project",
        "fov_id",
        F.when(mapped, F.col("new_cell_id")).otherwise(F.col("cell_id")).alias("_to"),
        F.struct(F.when(mapped, 1).otherwise(0).alias("moved"), F.col("cell_id").alias("from")).alias("_rank"),
        F.struct("category", "confidence").alias("_tag"),
    )
    return (
        placed.groupBy("project", "fov_id", "_to")
        .agg(F.max_by("_tag", "_rank").alias("_tag"))
        .select("project", "fov_id", F.col("_to").alias("cell_id"), "_tag.category", "_tag.confidence")
    )


def rename_category(tags: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Exact-name rename in every field of view; confidences stay."""
    new = F.col("category")
    for old, name in renames.items():
        if name.strip() and name.strip() != old:
            new = F.when(F.col("category") == old, F.lit(name.strip())).otherwise(new)
    return tags.select(*TAG_KEY, new.alias("category"), "confidence")


def fold_tag_events(events: DataFrame) -> DataFrame:
    """Current tag of each tile after a history of human and model changes.

    The last human event decides if it set a tag; after a human clear (or with
    no human event) the last model event that came later counts. Two running
    maxima per tile suffice, so a tile with very many events is folded
    map-side, and the same aggregate serves the streaming form.
    """
    at = F.struct("ts", "event_id", "category", "confidence")
    state = events.groupBy("tile").agg(
        F.max(F.when(F.col("actor") == "human", at)).alias("h"),
        F.max(F.when(F.col("actor") == "ai", at)).alias("a"),
    )
    return settle_tag_state(state)


def settle_tag_state(state: DataFrame) -> DataFrame:
    """Turn the (last human, last model) pair of each tile into its tag."""
    h, a = F.col("h"), F.col("a")
    later = h.isNull() | (F.struct(a["ts"], a["event_id"]) > F.struct(h["ts"], h["event_id"]))
    by_human = h.isNotNull() & _set(h["category"])
    by_model = ~by_human & a.isNotNull() & later & _set(a["category"])
    return state.select(
        "tile",
        F.when(by_human, h["category"]).when(by_model, a["category"]).alias("category"),
        F.when(by_model, a["confidence"]).alias("confidence"),
    ).where(F.col("category").isNotNull())


# --- reading tags against tiles -------------------------------------------------


def tag_tiles(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    """Every tile with its tag, if any; tags of cells that no longer exist drop out."""
    return tiles.join(tags.select(*TAG_COLUMNS), TAG_KEY, "left")


def unlabeled(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    """Tiles without a human tag; a model's guess still counts as unlabeled."""
    human = tags.where(F.col("confidence").isNull()).select(*TAG_KEY)
    return tiles.join(human, TAG_KEY, "left_anti")


def confirmed_records(tags: DataFrame, pool_fovs: DataFrame | None = None) -> DataFrame:
    """(tile, category) pairs a human stands behind, optionally only from the pooled fields of view."""
    human = tags.where(F.col("confidence").isNull() & _set(F.col("category")))
    if pool_fovs is not None:
        from .skew import salted_join

        human = salted_join(human, pool_fovs.distinct(), ["project", "fov_id"], "left_semi", salt_on=["cell_id"])
    return human.select(*TAG_KEY, "category")


def filter_category(tagged: DataFrame, target: str | None) -> DataFrame:
    """All tiles (None), the un-annotated ones (""), or one exact category."""
    if target is None:
        return tagged
    return tagged.where(F.coalesce(F.col("category"), F.lit("")) == target)


def tile_report(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per tile: cell label, category, who set it, and the model's confidence as text."""
    t = tag_tiles(tiles, tags)
    return t.select(
        "project",
        F.col("fov_id").alias("fov"),
        F.col("label").alias("cell"),
        F.coalesce("category", F.lit("")).alias("category"),
        tag_source("category", "confidence").alias("source"),
        F.when(F.col("confidence").isNull(), "")
        .otherwise(F.format_string("%.4f", F.col("confidence")))
        .alias("confidence"),
    )


def usage_count(tags: DataFrame, name: str) -> DataFrame:
    """Tags of exactly this name per project, orphans included."""
    return tags.where(F.col("category") == name).groupBy("project").agg(F.count(F.lit(1)).alias("n_tags"))


def tagged_items(tags: DataFrame) -> DataFrame:
    """All tags under their full key; unlike tallies this keeps orphan tags."""
    return tags.select(
        F.concat_ws("/", "project", F.concat(F.col("fov_id"), F.lit(".tiles")), "cell_id").alias("path"),
        "category",
        "confidence",
    )


def duplicate_categories(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Category spellings that differ only by case or outer blanks.

    Spellings are made distinct first, so the grouped sets are as small as the
    number of spellings in use.
    """
    spelled = names.select(F.col(name_col).alias("name")).distinct()
    return (
        spelled.groupBy(category_key("name").alias("key"))
        .agg(F.array_sort(F.collect_set("name")).alias("names"))
        .where(F.size("names") > 1)
    )
