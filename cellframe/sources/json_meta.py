"""Project settings and model records kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MODEL_META

# What a setting is when the file doesn't name it.
CONFIG_DEFAULTS = {
    "raw_pattern": "*.ims",
    "brightfield": 0,
    "projection": 1,
    "num_tiles_y": 8,
    "num_tiles_x": 8,
    "inverted_variance_prominence": 100.0,
    "offset_um": 1.0,
    "denoise_steps": 2000,
    "deconvolve_enabled": False,
    "zoom": 1.0,
    "camera_offset": 100.0,
    "background": 0.0,
    "num_iter": 50,
    "diameter": 30.0,
    "flow_threshold": 0.4,
    "cellprob_threshold": 0.0,
    "remove_edge_masks": True,
    "tile_size": 64,
    "contrast_lo_pct": 0.1,
    "contrast_hi_pct": 99.9,
}

# Where each setting sits in the file, and its type.
_FIELDS = [
    ("raw_pattern", None, "raw_pattern", "string"),
    ("brightfield", "channels", "brightfield", "int"),
    ("projection", "channels", "projection", "int"),
    ("num_tiles_y", "flatten_params", "num_tiles_y", "int"),
    ("num_tiles_x", "flatten_params", "num_tiles_x", "int"),
    ("inverted_variance_prominence", "flatten_params", "inverted_variance_prominence", "double"),
    ("offset_um", "flatten_params", "offset_um", "double"),
    ("denoise_steps", "denoise_params", "steps", "int"),
    ("deconvolve_enabled", "deconvolve_params", "enabled", "boolean"),
    ("zoom", "deconvolve_params", "zoom", "double"),
    ("camera_offset", "deconvolve_params", "camera_offset", "double"),
    ("background", "deconvolve_params", "background", "double"),
    ("num_iter", "deconvolve_params", "num_iter", "int"),
    ("diameter", "segmentation_params", "diameter", "double"),
    ("flow_threshold", "segmentation_params", "flow_threshold", "double"),
    ("cellprob_threshold", "segmentation_params", "cellprob_threshold", "double"),
    ("remove_edge_masks", "segmentation_params", "remove_edge_masks", "boolean"),
    ("tile_size", "tile_params", "size", "int"),
    ("contrast_lo_pct", "tile_params", "contrast_lo_pct", "double"),
    ("contrast_hi_pct", "tile_params", "contrast_hi_pct", "double"),
]
_OPTIONAL = [
    ("psf_path", "deconvolve_params", "psf_path"),
    ("model_path", "segmentation_params", "model_path"),
    ("segmentation_source_stage", None, "segmentation_source_stage"),
    ("deconvolve_source_stage", None, "deconvolve_source_stage"),
]


def _text_schema() -> T.StructType:
    """Scalars read as text, so a number in quotes is as good as a number."""
    groups: dict[str | None, list[str]] = {}
    for _name, group, field, *_ in [*_FIELDS, *_OPTIONAL]:
        groups.setdefault(group, []).append(field)
    out = T.StructType()
    for group, fields in groups.items():
        if group is None:
            for f in fields:
                out = out.add(f, "string")
        else:
            inner = T.StructType([T.StructField(f, T.StringType()) for f in fields])
            if group == "flatten_params":
                inner = inner.add("poly_degree", T.ArrayType(T.StringType()))
            if group == "denoise_params":
                inner = inner.add("channels", T.ArrayType(T.StringType()))
            out = out.add(group, inner)
    run = T.StructType().add("last_run", "string").add("files", T.ArrayType(T.StringType()))
    out = out.add("stage_runs", T.MapType(T.StringType(), run))
    out = out.add("denoise_channels_done", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return out.add("_corrupt", "string")


def parse_configs(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Settings with defaults filled in; ``status`` is ``unreadable`` for a broken or wrongly typed file.

    The other columns of ``texts`` pass through.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = texts.withColumn("_c", F.from_json(text_col, _text_schema(), options))
    bad = F.col("_c").isNull() | F.col("_c._corrupt").isNotNull()
    cols = []

    def typed(raw, kind):
        if kind == "string":
            return raw
        if kind == "int":
            return F.when(raw.try_cast("double").isNotNull(), raw.try_cast("double").cast("int"))
        return raw.try_cast(kind)

    for name, group, field, kind in _FIELDS:
        raw = F.col(f"_c.{group}.{field}" if group else f"_c.{field}")
        value = typed(raw, kind)
        bad = bad | (raw.isNotNull() & value.isNull())
        cols.append(F.coalesce(value, F.lit(CONFIG_DEFAULTS[name])).alias(name))
    for name, group, field in _OPTIONAL:
        raw = F.col(f"_c.{group}.{field}" if group else f"_c.{field}")
        cols.append(F.nullif(raw, F.lit("")).alias(name))
    degree = F.transform("_c.flatten_params.poly_degree", lambda x: x.try_cast("int"))
    cols.append(F.coalesce(degree, F.array(F.lit(2), F.lit(2))).alias("poly_degree"))
    channels = F.transform("_c.denoise_params.channels", lambda x: x.try_cast("int"))
    cols.append(F.coalesce(channels, F.array(F.lit(0), F.lit(1))).alias("denoise_channels"))
    cols.append(F.col("_c.stage_runs").alias("stage_runs"))
    cols.append(F.col("_c.denoise_channels_done").alias("denoise_channels_done"))
    keep = [c for c in texts.columns if c != text_col]
    return rows.select(*keep, F.when(bad, "unreadable").otherwise("ok").alias("status"), *cols)


def load_configs(spark: SparkSession, path: str, name: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(readable configs, quarantined files) below a folder; one small file per project."""
    texts = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    parsed = parse_configs(texts)
    return parsed.where("status = 'ok'").drop("status"), parsed.where("status = 'unreadable'").select("path")


def model_catalog(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Kind and one-line description of each model record; NULL kind where the record can't be read."""
    schema = T.StructType([*MODEL_META.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = texts.withColumn("_m", F.from_json(text_col, schema, options))
    ok = F.col("_m").isNotNull() & F.col("_m._corrupt").isNull()
    has_pairing = F.get_json_object(text_col, "$.pairing").isNotNull()
    kind = F.when(ok, F.when(has_pairing, "backbone").otherwise("classifier"))
    m = F.col("_m")
    trained = F.substring(F.coalesce(m["last_trained"], F.lit("unknown date")), 1, 10)
    counted = F.transform(
        m["categories"],
        lambda c: F.when(
            F.map_contains_key(m["category_counts"], c),
            F.concat(c, F.lit(" ("), F.element_at(m["category_counts"], c).cast("string"), F.lit(")")),
        ).otherwise(c),
    )
    named = F.coalesce(F.nullif(F.array_join(counted, ", "), F.lit("")), F.lit("n/a"))
    score = F.when(
        m["validation"].isNotNull(),
        F.format_string("validation accuracy %.3f on %d tiles; ", m["validation"]["accuracy"], m["validation"]["n"]),
    ).otherwise("")
    described = F.when(
        m["tile_count"].isNotNull(),
        F.concat(F.lit("trained "), trained, F.lit("; self-supervised on "), m["tile_count"].cast("string"), F.lit(" tiles")),
    ).otherwise(F.concat(F.lit("trained "), trained, F.lit("; "), score, F.lit("categories: "), named))
    keep = [c for c in texts.columns if c != text_col]
    return rows.select(*keep, kind.alias("kind"), F.when(ok, described).alias("description"))
