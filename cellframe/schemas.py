"""Explicit schemas. Names that look numeric (fields of view such as "001") stay strings."""

from __future__ import annotations

from pyspark.sql import types as T

TAG_KEY = ["project", "fov_id", "cell_id"]

TAGS = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("fov_id", T.StringType()),
    T.StructField("cell_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

TILE_INDEX = T.StructType([
    T.StructField("cell_id", T.StringType()),
    T.StructField("fov_id", T.StringType()),
    T.StructField("label", T.LongType()),
    T.StructField("crop_path", T.StringType()),
])

TILES = T.StructType([
    T.StructField("container", T.StringType()),
    T.StructField("cell_id", T.StringType()),
    T.StructField("label", T.LongType()),
    T.StructField("shape", T.ArrayType(T.IntegerType())),
    T.StructField("dtype", T.StringType()),
    T.StructField("centroid", T.ArrayType(T.DoubleType())),
    T.StructField("pixels", T.BinaryType()),
])

MODEL_META = T.StructType([
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("category_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("trained_on", T.MapType(T.StringType(), T.ArrayType(T.LongType()))),
    T.StructField("validation", T.StructType([
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ])),
    T.StructField("pairing", T.StringType()),
    T.StructField("tile_count", T.LongType()),
    T.StructField("last_trained", T.StringType()),
    T.StructField("description", T.StringType()),
])

PROJECT_CONFIG = T.StructType([
    T.StructField("raw_pattern", T.StringType()),
    T.StructField("channels", T.StructType([
        T.StructField("brightfield", T.IntegerType()),
        T.StructField("projection", T.IntegerType()),
    ])),
    T.StructField("flatten_params", T.StructType([
        T.StructField("num_tiles_y", T.IntegerType()),
        T.StructField("num_tiles_x", T.IntegerType()),
        T.StructField("inverted_variance_prominence", T.DoubleType()),
        T.StructField("poly_degree", T.ArrayType(T.IntegerType())),
        T.StructField("offset_um", T.DoubleType()),
    ])),
    T.StructField("denoise_params", T.StructType([
        T.StructField("channels", T.ArrayType(T.IntegerType())),
        T.StructField("steps", T.IntegerType()),
    ])),
    T.StructField("deconvolve_params", T.StructType([
        T.StructField("enabled", T.BooleanType()),
        T.StructField("psf_path", T.StringType()),
        T.StructField("zoom", T.DoubleType()),
        T.StructField("camera_offset", T.DoubleType()),
        T.StructField("background", T.DoubleType()),
        T.StructField("num_iter", T.IntegerType()),
    ])),
    T.StructField("segmentation_params", T.StructType([
        T.StructField("model_path", T.StringType()),
        T.StructField("diameter", T.DoubleType()),
        T.StructField("flow_threshold", T.DoubleType()),
        T.StructField("cellprob_threshold", T.DoubleType()),
        T.StructField("remove_edge_masks", T.BooleanType()),
    ])),
    T.StructField("tile_params", T.StructType([
        T.StructField("size", T.IntegerType()),
        T.StructField("contrast_lo_pct", T.DoubleType()),
        T.StructField("contrast_hi_pct", T.DoubleType()),
    ])),
    T.StructField("segmentation_source_stage", T.StringType()),
    T.StructField("deconvolve_source_stage", T.StringType()),
    T.StructField("stage_runs", T.MapType(T.StringType(), T.StructType([
        T.StructField("last_run", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("denoise_channels_done", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
])
