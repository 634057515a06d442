"""Pools of projects: which fields of view take part, and tallies over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import literal_table, materialize
from .skew import salted_join
from .tags import tag_tiles

FOV = ["project", "fov_id"]


def _tagged():
    return F.col("category").isNotNull() & (F.col("category") != "")


def _human():
    return _tagged() & F.col("confidence").isNull()


def fov_category_counts(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    """Tiles and human-set tiles per field of view and category (NULL = untagged).

    The one pass over the tiles; all summaries below start from these counts.
    """
    return (
        tag_tiles(tiles, tags)
        .withColumn("category", F.when(_tagged(), F.col("category")))
        .groupBy(*FOV, "category")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(_human()).alias("n_human"))
    )


def fov_tally(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    return (
        fov_category_counts(tiles, tags)
        .groupBy(*FOV)
        .agg(
            F.sum("n").alias("n_tiles"),
            F.coalesce(F.sum(F.when(F.col("category").isNotNull(), F.col("n"))), F.lit(0)).alias("n_tagged"),
            F.sum("n_human").alias("n_human"),
            F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))), F.lit(0)).alias("untagged"),
        )
    )


def pool_summary(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    """Counts per category, per field of view, per project and overall, by one rollup of the counts."""
    counts = fov_category_counts(tiles, tags).withColumn("category", F.coalesce("category", F.lit("(untagged)")))
    return (
        counts.rollup("project", "fov_id", "category")
        .agg(F.sum("n").alias("n_tiles"), F.sum("n_human").alias("n_human"))
        .select("project", "fov_id", "category", "n_tiles", "n_human")
    )


def category_count_map(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    """category -> tiles map of each field of view; a map is as long as the names in use there."""
    counts = fov_category_counts(tiles, tags).where(F.col("category").isNotNull())
    entries = F.array_sort(F.collect_list(F.struct("category", "n")))
    return counts.groupBy(*FOV).agg(F.map_from_entries(entries).alias("counts"))


def annotation_stats(tiles: DataFrame, tags: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Count, share of the tagged total and human count per category.

    Listed categories come first, also unused ones; names in use outside the
    list follow. Un-annotated tiles get a row without a share.
    """
    spark = tiles.sparkSession
    schema = "category string, n long, n_human long, position int"
    listed = literal_table(spark, [(None, 0, 0, -1), *[(c, 0, 0, i) for i, c in enumerate(vocabulary)]], schema)
    counts = fov_category_counts(tiles, tags).select("category", "n", "n_human", F.lit(len(vocabulary)).alias("position"))
    rows = counts.unionByName(listed).groupBy("category").agg(
        F.sum("n").alias("n_tiles"), F.sum("n_human").alias("n_human"), F.min("position").alias("position")
    )
    # One row per category from here on.
    tagged = F.col("category").isNotNull()
    total = F.sum(F.when(tagged, F.col("n_tiles")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    share = F.coalesce(F.lit(100.0) * F.col("n_tiles") / F.nullif(total, F.lit(0)), F.lit(0.0))
    return rows.select(
        F.coalesce("category", F.lit("Un-annotated")).alias("category"),
        "n_tiles",
        F.when(tagged, share).alias("percent"),
        F.when(tagged, F.col("n_human")).alias("n_human"),
        "position",
    )


def results_long(tiles: DataFrame, tags: DataFrame) -> DataFrame:
    """The results as rows ``(project, fov, category, n, n_human)``, for any number of categories.

    ``category`` is null for what is unclassified; the field "" of project "" holds the totals. Names are values here,
    not columns, so none goes through the driver; a category that a field has no tile of has no row.
    """
    counts = materialize(fov_category_counts(tiles, tags), "results")
    rows = counts.select("project", F.col("fov_id").alias("fov"), "category", "n", "n_human")
    totals = rows.groupBy("category").agg(F.sum("n").alias("n"), F.sum("n_human").alias("n_human"))
    return rows.unionByName(totals.select(F.lit("").alias("project"), F.lit("").alias("fov"), "category", "n", "n_human"))


def results_table(tiles: DataFrame, tags: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per field of view: tiles, one column per category, unclassified, human-set; then a total row.

    Columns are the declared list, then names in use that are not on it. The
    counts are kept aside, so columns, rows and total come from one pass over
    the tiles. The names go through the driver; Spark refuses pivots beyond
    ``spark.sql.pivotMaxValues`` columns, and so does this.
    """
    counts = materialize(fov_category_counts(tiles, tags), "results")
    limit = int(tiles.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    used = [r[0] for r in counts.where("category is not null").select("category").distinct().limit(limit + 1).collect()]
    if len(used) > limit:
        raise ValueError(f"more than {limit} category names in use")
    categories = [*vocabulary, *sorted(u for u in used if u not in vocabulary)]

    def cell(c):
        return F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c)

    untagged = F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))), F.lit(0)).alias("unclassified")
    rows = (
        counts.groupBy(*FOV)
        .agg(F.sum("n").alias("tiles"), *[cell(c) for c in categories], untagged, F.sum("n_human").alias("human_set"))
        .withColumnRenamed("fov_id", "fov")
    )
    numbers = ["tiles", *categories, "unclassified", "human_set"]
    total = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"`{c}`")).alias(c) for c in numbers]).select(
        F.lit("").alias("project"), F.format_string("All %d FOV(s)", F.col("_n")).alias("fov"), *[F.col(f"`{c}`") for c in numbers]
    )
    return rows.select("project", "fov", *[F.col(f"`{c}`") for c in numbers]).unionByName(total)


def checked_fovs(fovs: DataFrame, roots: DataFrame, excluded: DataFrame, scope: str) -> DataFrame:
    """Fields of view of the pooled projects minus those a scope leaves out; new ones join by themselves."""
    out = excluded.where(F.col("scope") == scope).select(*FOV)
    pooled = salted_join(fovs.select(*FOV).distinct(), roots.select("project").distinct(), ["project"], "left_semi")
    return pooled.join(out, FOV, "left_anti")


def add_project(roots: DataFrame, project: str) -> DataFrame:
    new = literal_table(roots.sparkSession, [(project,)], "project string")
    return roots.select("project").union(new).distinct()


def remove_project(roots: DataFrame, excluded: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Leaving the pool also forgets what was excluded under that project, in every scope."""
    return roots.where(F.col("project") != project), excluded.where(F.col("project") != project)


def set_included(excluded: DataFrame, scope: str, fovs: DataFrame, included: bool) -> DataFrame:
    mine = fovs.select(F.lit(scope).alias("scope"), *FOV)
    if included:
        return excluded.join(mine, ["scope", *FOV], "left_anti")
    return excluded.select("scope", *FOV).unionByName(mine).distinct()


def route_to_owner(paths: DataFrame, folders: DataFrame, path_col: str = "path") -> DataFrame:
    """The longest folder that contains each path; NULL where none does.

    Each path is expanded to its ancestor folders (as many as it has slashes)
    and matched by equality, so no pairing of every path with every folder
    takes place; the salted join spreads popular folders over many tasks.
    """
    parts = F.split(F.col(path_col), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = paths.select(path_col, F.explode(ancestors).alias("folder"))
    hits = salted_join(spread, folders.select("folder").distinct(), ["folder"], "left_semi", salt_on=[path_col])
    best = hits.groupBy(path_col).agg(F.max_by("folder", F.length("folder")).alias("owner"))
    return paths.join(best, path_col, "left")
