"""Tables of tiles, tags and reports, replaced field of view by field of view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import strip_legacy_suffix
from ..schemas import TILE_INDEX
from ..session import scratch_dir


def _with_emptied(df: DataFrame, by: tuple[str, ...], touched: DataFrame | None) -> DataFrame:
    """``df`` and one row for each touched partition that it has no rows for, filled in the columns of ``touched`` only."""
    if touched is None:
        return df
    empty = touched.dropDuplicates(list(by)).join(df.select(*by).distinct(), list(by), "left_anti")
    return df.unionByName(empty, allowMissingColumns=True)


def write_partitions(
    df: DataFrame, path: str, order: list[str], by: tuple[str, ...] = ("project", "fov_id"), touched: DataFrame | None = None
) -> None:
    """Overwrite exactly the partitions ``df`` has rows for, and those that ``touched`` names.

    A touched partition that is left without rows keeps one row without a key:
    what it held goes in the same write, and a stream over the folder gets to
    see it. ``read_partitions`` leaves such rows out.

    Range partitioning by the full order spreads a very large field of view
    over several files, each sorted.
    """
    keys = [*by, *order]
    (
        _with_emptied(df, by, touched)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def replace_partitions(
    df: DataFrame, path: str, order: list[str], by: tuple[str, ...] = ("project", "fov_id"), touched: DataFrame | None = None
) -> None:
    """The same for a frame that reads ``path`` itself: it is written aside in the shared
    scratch folder first, so nothing is read and replaced at once and a lost executor costs
    no more than its task."""
    spark = df.sparkSession
    aside = scratch_dir(spark, "staged")
    _with_emptied(df, by, touched).write.parquet(aside)
    write_partitions(spark.read.schema(df.schema).parquet(aside), path, order, by)


def read_partitions(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """What ``write_partitions`` keeps. ``key`` is a column that every row of the table fills."""
    return spark.read.schema(schema).parquet(path).where(F.col(key).isNotNull())


def write_tiles(tiles: DataFrame, path: str, touched: DataFrame | None = None) -> None:
    """``touched``: the fields of view (project, fov_id) that were exported again, also those without a cell."""
    write_partitions(tiles, path, ["label"], touched=touched)


def read_tiles(spark: SparkSession, path: str, schema, key: str = "label") -> DataFrame:
    """Columnar, so queries that need no pixels never read them."""
    return read_partitions(spark, path, schema, key)


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """CSV index under a fixed schema: a field of view named "001" stays text."""
    df = spark.read.schema(TILE_INDEX).option("header", True).csv(path)
    return df.withColumn("crop_path", strip_legacy_suffix("crop_path"))


def write_tile_index(index: DataFrame, path: str) -> None:
    rows = index.select(*TILE_INDEX.names)
    rows.repartitionByRange("fov_id", "label").sortWithinPartitions("fov_id", "label").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV, NULL as the empty string; no byte-order mark."""
    report.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
