"""Class shares against an experimental variable taken from field-of-view names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import extract_by_pattern

FOV = ["project", "fov_id"]


def extract_variable(fovs: DataFrame, pattern: str) -> DataFrame:
    """Fill ``index`` from the name of each included field of view, and ``variable`` where blank.

    ``fovs`` is ``(project, fov_id, include, index, variable)``.
    """
    found = F.when(F.col("include"), extract_by_pattern("fov_id", pattern))
    blank = F.coalesce(F.trim("variable"), F.lit("")) == ""
    return fovs.select(
        *FOV,
        "include",
        F.coalesce(found, F.col("index")).alias("index"),
        F.when(blank & found.isNotNull(), found).otherwise(F.col("variable")).alias("variable"),
    )


def coerce_variable(fovs: DataFrame, column: str = "variable") -> DataFrame:
    """All values as numbers if every one is a number, else all stay text.

    The decision is one aggregate over the field-of-view table.
    """
    number = F.expr(f"try_cast(`{column}` as double)")
    row = fovs.agg(F.count(column).alias("n"), F.count(number).alias("m")).first()
    return fovs.withColumn(column, number) if row["n"] == row["m"] else fovs


def tag_counts_by_fov(
    tags: DataFrame, categories: list[str] | None = None, confirmed_only: bool = False
) -> DataFrame:
    """Tags (orphans included) per field of view and category, after the report's filters."""
    kept = tags
    if confirmed_only:
        kept = kept.where(F.col("confidence").isNull())
    if categories is not None:
        kept = kept.where(F.col("category").isin(categories))
    return kept.groupBy(*FOV, "category").agg(F.count(F.lit(1)).alias("n"))


def mapped_counts(tags: DataFrame, fovs: DataFrame, **filters) -> DataFrame:
    """Counts joined to the variable of each included field of view that has one.

    Tags are counted before the join, so a field of view with very many tags is
    a handful of rows by then.
    """
    usable = fovs.where(F.col("include") & (F.coalesce(F.col("variable").cast("string"), F.lit("")) != ""))
    return tag_counts_by_fov(tags, **filters).join(usable.select(*FOV, "variable"), FOV)


def class_share(tags: DataFrame, fovs: DataFrame, **filters) -> DataFrame:
    """Share of each category among the filtered tags of a variable value."""
    counts = mapped_counts(tags, fovs, **filters).groupBy("variable", "category").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("variable"))
    return counts.select("variable", "category", "n", (F.col("n") / total * 100).alias("percentage"))


def variable_totals(tags: DataFrame, fovs: DataFrame, **filters) -> DataFrame:
    return mapped_counts(tags, fovs, **filters).groupBy("variable").agg(F.sum("n").alias("total_count"))


def fov_class_share(tags: DataFrame, fovs: DataFrame, **filters) -> DataFrame:
    """The export: share of each category within its own field of view."""
    counts = mapped_counts(tags, fovs, **filters)
    total = F.sum("n").over(Window.partitionBy(*FOV))
    return counts.select(
        "project",
        F.col("fov_id").alias("fov"),
        "variable",
        "category",
        F.col("n").alias("count"),
        (F.col("n") / total * 100).alias("percentage"),
    )
