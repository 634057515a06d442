"""What files are there: names, times and sizes, without reading contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import DECONVOLVED, DENOISED, REDUCED, TILES


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Visible files below a folder: path, name, mtime, size. Contents are pruned from the scan."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("name", name).where(~F.startswith("name", F.lit(".")))


def stage_files(manifest: DataFrame, raw_suffixes: tuple[str, ...] = ("ims", "czi", "nd2")) -> DataFrame:
    """Manifest rows placed into their project and stage by folder name.

    Stage folders lie directly in the project folder; raw stacks lie in the
    project folder itself.
    """
    parts = F.split("path", "/")
    parent, grand = F.element_at(parts, -2), F.try_element_at(parts, F.lit(-3))
    staged = parent.isin(REDUCED, DENOISED, DECONVOLVED, TILES)
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    wanted = (
        F.when(parent == TILES, ext == "tiles").when(staged, ext == "tiff").otherwise(ext.isin(*raw_suffixes))
    )
    return manifest.where(wanted).select(
        F.when(staged, grand).otherwise(parent).alias("project"),
        F.when(staged, parent).otherwise("raw").alias("stage"),
        F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"),
        "path",
        "mtime",
        "size",
    )


def mask_files(manifest: DataFrame) -> DataFrame:
    """Saved masks: ``<stem>_seg.npy`` one folder below the stage they were computed from."""
    parts = F.split("path", "/")
    return manifest.where(F.endswith("name", F.lit("_seg.npy"))).select(
        F.try_element_at(parts, F.lit(-4)).alias("project"),
        F.try_element_at(parts, F.lit(-3)).alias("stage"),
        F.regexp_replace("name", r"_seg\.npy$", "").alias("stem"),
        "mtime",
    )
