"""Percentile bounds and display ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from .skew import exact_percentiles, join_facts


def crop_percentiles(pixels: DataFrame, keys: list[str], lo: float = 0.1, hi: float = 99.9, value: str = "value") -> DataFrame:
    """Bounds over one crop's pixels; a crop has at most its window size of them."""
    p = F.percentile(F.col(value), F.array(F.lit(lo / 100.0), F.lit(hi / 100.0)))
    return pixels.groupBy(*keys).agg(p.alias("_p")).select(
        *keys, F.get("_p", F.lit(0)).alias("lo"), F.get("_p", F.lit(1)).alias("hi")
    )


def field_percentiles(pixels: DataFrame, keys: list[str], lo: float = 0.1, hi: float = 99.9, value: str = "value") -> DataFrame:
    """The same bounds for groups of any size, such as a channel of a whole project."""
    return exact_percentiles(pixels, keys, value, {"lo": lo, "hi": hi})


def stretch(pixels: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Each crop stretched to 0..255 between its own percentiles."""
    bounds = crop_percentiles(pixels, keys, lo, hi)
    return pixels.join(bounds, keys).withColumn("value", px.stretch_to_uint8("value", "lo", "hi")).drop("lo", "hi")


def normalise(pixels: DataFrame, keys: list[str], lo: float = 0.1, hi: float = 99.9) -> DataFrame:
    """(v - lo) / (hi - lo), an empty range dividing by one; for whole images."""
    bounds = field_percentiles(pixels, keys, lo, hi)
    span = F.when(F.col("hi") - F.col("lo") == 0, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    joined = join_facts(pixels, bounds, keys, "inner")
    return joined.withColumn("value", (F.col("value") - F.col("lo")) / span).drop("lo", "hi")


def contrast_limits(
    pixels: DataFrame,
    keys: list[str],
    lo: float = 0.5,
    hi: float = 99.98,
    ignore_zeros: bool = True,
    integer: bool = False,
    whole_fields: bool = False,
) -> DataFrame:
    """Display range of a channel.

    Crops go through one aggregate. With ``whole_fields`` the groups may be of
    any size and the percentiles come from ``exact_percentiles``.
    """
    v = F.col("value").cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    rows = pixels.select(*keys, finite.alias("v"))
    rows = rows.withColumn("pos", F.when(F.col("v") > 0, F.col("v")) if ignore_zeros else F.col("v"))
    base = [F.min("v").alias("min"), F.max("v").alias("max"), F.max(F.abs("v")).alias("abs_max")]
    if whole_fields:
        # Three readings of each pixel share one histogram pass.
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("v")) for k, c in
                          (("abs", F.abs("v")), ("pos", F.col("pos")), ("all", F.col("v")))])
        spread = rows.select(*keys, F.explode(kinds).alias("_k")).select(*keys, "_k.kind", "_k.v")
        bounds = exact_percentiles(spread, [*keys, "kind"], "v", {"lo": lo, "hi": hi})
        picks = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("abs", "pos", "all") for c in ("lo", "hi")]
        stats = rows.groupBy(*keys).agg(*base).join(bounds.groupBy(*keys).agg(*picks), keys, "left")
    else:
        q = lambda c, p: F.percentile(c, F.lit(p / 100.0))
        stats = rows.groupBy(*keys).agg(
            *base,
            q(F.abs("v"), hi).alias("abs_hi"),
            q(F.col("pos"), lo).alias("pos_lo"),
            q(F.col("pos"), hi).alias("pos_hi"),
            q(F.col("v"), lo).alias("all_lo"),
            q(F.col("v"), hi).alias("all_hi"),
        )
    named = {c: F.col(c) for c in ["min", "max", "abs_max", "abs_hi", "pos_lo", "pos_hi", "all_lo", "all_hi"]}
    vmin, vmax = px.contrast_range(named, integer)
    return stats.select(*keys, vmin.alias("vmin"), vmax.alias("vmax"))
