"""Category vocabularies: short ordered lists ``(project, fov_id, position, category)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import category_key


def fallback_vocabulary(declared: DataFrame, tags: DataFrame) -> DataFrame:
    """The declared list of a field of view, or its names in use, sorted, where none is declared."""
    used = tags.select("project", "fov_id", "category").distinct()
    undeclared = used.join(declared.select("project", "fov_id").distinct(), ["project", "fov_id"], "left_anti")
    # Distinct names in use per field of view: a vocabulary, short by nature.
    pos = F.row_number().over(Window.partitionBy("project", "fov_id").orderBy("category"))
    filled = undeclared.withColumn("position", pos)
    cols = ["project", "fov_id", "position", "category"]
    return declared.select(*cols).unionByName(filled.select(*cols))


def union_vocabulary(vocab: DataFrame, order: list[str], name: str = "category") -> DataFrame:
    """First-seen spelling of each category, case and outer blanks aside."""
    first = F.struct(*order, F.col(name))
    return (
        vocab.groupBy(category_key(name).alias("key"))
        .agg(F.min(first).alias("_first"))
        .select("key", F.col(f"_first.{name}").alias(name), *[F.col(f"_first.{o}").alias(o) for o in order])
    )


def add_category(vocab: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """Append ``name`` to each project's list unless a variant is there already.

    A project without a list starts from its names in use. ``vocab`` is
    ``(project, position, category)``.
    """
    new = name.strip()
    # Both lists are vocabularies, short by nature.
    listed = vocab.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("position", "category"))).alias("_l"))
    used = tags.groupBy("project").agg(F.array_sort(F.collect_set("category")).alias("_u"))
    fallback = F.transform("_u", lambda c, i: F.struct((i + 1).alias("position"), c.alias("category")))
    words = listed.join(used, "project", "full_outer").select("project", F.coalesce("_l", fallback).alias("_w"))
    if new:
        known = F.exists("_w", lambda w: category_key(w["category"]) == category_key(F.lit(new)))
        end = F.coalesce(F.array_max(F.transform("_w", lambda w: w["position"])), F.lit(0))
        added = F.array(F.struct((end + 1).alias("position"), F.lit(new).alias("category")))
        words = words.withColumn("_w", F.when(known, F.col("_w")).otherwise(F.concat("_w", added)))
    return words.select("project", F.inline("_w").alias("position", "category"))


def remove_category(vocab: DataFrame, name: str) -> DataFrame:
    """Take a name out of the lists; tags that use it stay."""
    return vocab.where(F.col("category") != name)


def rename_in_vocabulary(vocab: DataFrame, old: str, new: str) -> DataFrame:
    """Rename in place; onto a name already listed the two become one at that one's place."""
    new = new.strip()
    if not new or new == old:
        return vocab
    has_new = F.max(F.when(F.col("category") == new, 1).otherwise(0)).over(Window.partitionBy("project"))
    kept = vocab.withColumn("_has", has_new).where((F.col("category") != old) | (F.col("_has") == 0))
    return kept.withColumn(
        "category", F.when(F.col("category") == old, F.lit(new)).otherwise(F.col("category"))
    ).drop("_has")
