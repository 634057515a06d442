"""Image planes: ``(fov, z, height, width, values)`` rows with a row-major array.

A pixel's neighbours sit in the same array, so stencils, block statistics and
neighbour differences are computed while a plane is exploded, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from . import strips
from .skew import join_facts

INT = "int"


def explode_pixels(planes: DataFrame, keys: list[str], extra: list | None = None) -> DataFrame:
    """One row per pixel: ``keys``, y, x, value; extra columns may still read ``values``."""
    return planes.select(
        *keys, "height", "width", "values", F.posexplode("values").alias("_pos", "value")
    ).select(
        *keys,
        F.floor(F.col("_pos") / F.col("width")).cast(INT).alias("y"),
        (F.col("_pos") % F.col("width")).cast(INT).alias("x"),
        "value",
        "height",
        "width",
        "values",
    )


def block_variance(planes: DataFrame, keys: list[str], tiles_y: int = 8, tiles_x: int = 8) -> DataFrame:
    """Population variance of each grid block of each plane, the far edge padded by reflection.

    Blocks lie inside one plane row, so partial aggregation shrinks every plane
    to ``tiles_y * tiles_x`` rows before anything is shuffled.
    """
    th = F.ceil(F.col("height") / tiles_y).cast(INT)
    tw = F.ceil(F.col("width") / tiles_x).cast(INT)
    grid = planes.withColumn("_th", th).withColumn("_tw", tw)
    grid = grid.select(
        *keys,
        "height",
        "width",
        "values",
        "_th",
        "_tw",
        F.explode(F.sequence(F.lit(0), F.col("_th") * tiles_y * F.col("_tw") * tiles_x - 1)).alias("_i"),
    )
    padded_w = F.col("_tw") * tiles_x
    y = F.floor(F.col("_i") / padded_w).cast(INT)
    x = (F.col("_i") % padded_w).cast(INT)
    v = px.plane_at("values", px.reflect(y, F.col("height")), px.reflect(x, F.col("width")), F.col("width"))
    rows = grid.select(
        *keys,
        F.floor(y / F.col("_th")).cast(INT).alias("tile_y"),
        F.floor(x / F.col("_tw")).cast(INT).alias("tile_x"),
        v.alias("_v"),
    )
    return rows.groupBy(*keys, "tile_y", "tile_x").agg(F.var_pop("_v").alias("variance"))


def focal_peaks(variances: DataFrame, fov: list[str], prominence: float = 100.0) -> DataFrame:
    """Focal plane of each block: the most prominent local minimum of variance along z, 0 if none.

    A block's profile has one entry per plane of its stack. Plateaus count at
    their middle, end points never do; prominence is the drop to the higher of
    the two lowest points between the peak and a higher one on either side.
    """
    profile = variances.groupBy(*fov, "tile_y", "tile_x").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("z", "variance"))), lambda s: -s["variance"]).alias("v")
    )
    v = F.col("v")
    n = F.size("v")

    def at(i):
        return F.get(v, i)

    def run_end(i):
        """Last index of the run of equal values that starts at ``i``."""
        return F.aggregate(
            F.sequence(i, n - 1),
            i,
            lambda acc, j: F.when((acc >= j - 1) & (at(j) == at(i)), j).otherwise(acc),
        )

    def base(steps, i):
        """Lowest value met before meeting a higher one than the peak."""
        start = F.struct(F.lit(True).alias("on"), at(i).alias("low"))
        walked = F.aggregate(
            steps,
            start,
            lambda acc, j: F.struct(
                (acc["on"] & (at(j) <= at(i))).alias("on"),
                F.when(acc["on"] & (at(j) <= at(i)), F.least(acc["low"], at(j))).otherwise(acc["low"]).alias("low"),
            ),
        )
        return walked["low"]

    inner = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    rises = F.filter(inner, lambda i: at(i - 1) < at(i))
    tops = F.filter(
        F.transform(rises, lambda i: F.struct(i.alias("a"), run_end(i).alias("b"))),
        lambda s: (s["b"] < n - 1) & (at(s["b"] + 1) < at(s["a"])),
    )
    mids = F.transform(tops, lambda s: F.floor((s["a"] + s["b"]) / 2).cast(INT))
    scored = F.transform(
        mids,
        lambda i: F.struct(
            (at(i) - F.greatest(base(F.reverse(F.sequence(F.lit(0), i)), i), base(F.sequence(i, n - 1), i))).alias("p"),
            (-i).alias("neg"),
        ),
    )
    best = F.array_max(F.filter(scored, lambda s: s["p"] >= F.lit(float(prominence))))
    return profile.select(
        *fov,
        "tile_y",
        "tile_x",
        F.coalesce(-best["neg"], F.lit(0)).alias("z_index"),
        F.coalesce(best["p"], F.lit(0.0)).alias("prominence"),
    )


def tile_center(index, tile_size, limit):
    """Centre of the part of a block that lies inside the image; NULL if none does."""
    start = index * tile_size
    end = F.least(start + tile_size, limit)
    return F.when(start < limit, (start + end - 1) / 2.0)


def fit_focus_surface(
    peaks: DataFrame,
    sizes: DataFrame,
    fov: list[str],
    tiles_y: int = 8,
    tiles_x: int = 8,
    degree: tuple[int, int] = (2, 2),
) -> DataFrame:
    """Least-squares polynomial through the focal planes of a field's blocks.

    One row per field: ``coefs`` (row-major, x power outer), or ``error`` where
    too few blocks have a peak. At most ``tiles_y * tiles_x`` points go into a
    fit, so the solves run as vectors of small arrays in a pandas UDF.
    """
    n_coefs = (degree[0] + 1) * (degree[1] + 1)

    @F.pandas_udf("array<double>")
    def solve(points: pd.Series) -> pd.Series:
        out = []
        for pts in points:
            a = np.array([[p["x"], p["y"], p["z"]] for p in pts], dtype=float).reshape(-1, 3)
            if len(a) < n_coefs:
                out.append(None)
                continue
            design = np.polynomial.polynomial.polyvander2d(a[:, 0], a[:, 1], list(degree))
            out.append(np.linalg.lstsq(design, a[:, 2], rcond=None)[0].tolist())
        return pd.Series(out)

    p = peaks.join(sizes.select(*fov, "height", "width").distinct(), fov)
    th = F.ceil(F.col("height") / tiles_y)
    tw = F.ceil(F.col("width") / tiles_x)
    cy = tile_center(F.col("tile_y"), th, F.col("height"))
    cx = tile_center(F.col("tile_x"), tw, F.col("width"))
    point = F.when(
        (F.col("z_index") != 0) & cy.isNotNull() & cx.isNotNull(),
        F.struct(
            scaled(cx, F.col("width")).alias("x"),
            scaled(cy, F.col("height")).alias("y"),
            F.col("z_index").cast("double").alias("z"),
        ),
    )
    grouped = p.groupBy(*fov, "height", "width").agg(
        F.array_sort(F.collect_list(point)).alias("points"), F.count(F.lit(1)).alias("n_blocks")
    )
    few = F.size("points") < n_coefs
    message = F.format_string(
        f"focus peak in only %d of %d blocks; a degree {tuple(degree)} surface needs {n_coefs}",
        F.size("points"),
        F.col("n_blocks"),
    )
    return grouped.select(
        *fov,
        "height",
        "width",
        solve("points").alias("coefs"),
        F.size("points").cast("long").alias("n_points"),
        F.when(few, message).alias("error"),
    )


def scaled(coord, limit):
    return 2.0 * coord / F.greatest(limit - 1, F.lit(1)) - 1.0


def surface_at(coefs, y, x, height, width, degree: tuple[int, int]):
    """The polynomial at a pixel, as one arithmetic expression."""
    sx, sy = scaled(x, width), scaled(y, height)

    def power(c, k):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * c
        return out

    total = F.lit(0.0)
    for i in range(degree[0] + 1):
        for j in range(degree[1] + 1):
            total = total + F.get(coefs, F.lit(i * (degree[1] + 1) + j)) * power(sx, i) * power(sy, j)
    return total


def eval_surface(fits: DataFrame, fov: list[str], degree: tuple[int, int] = (2, 2)) -> DataFrame:
    """The fitted surface at every pixel, generated from the one row per field."""
    grid = fits.where(F.col("error").isNull()).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1))
    )
    y = F.floor(F.col("_i") / F.col("width")).cast(INT)
    x = (F.col("_i") % F.col("width")).cast(INT)
    z = surface_at(F.col("coefs"), y, x, F.col("height"), F.col("width"), degree)
    return grid.select(*fov, y.alias("y"), x.alias("x"), z.alias("z_surface"))


def focal_slice(
    planes: DataFrame,
    fits: DataFrame,
    fov: list[str],
    degree: tuple[int, int] = (2, 2),
    offset_planes=0.0,
    method: str = "spline",
    finish: str | None = "uint16",
) -> DataFrame:
    """Sample each pixel at its own height.

    A sample is a weighted sum over the planes (``px.spline_plane_weight``), so
    each plane contributes its share where it is stored, and the shares travel
    as strips of pixels (``strips.strip_sums``); no pixel's stack is gathered. ``finish``: ``uint16`` rounds as a
    16-bit source does, ``truncate`` cuts as a float source does, None keeps it.
    """
    out = strips.strip_sums({"value": placed_planes(planes, fits, fov, offset_planes)}, fov, degree, method)
    out = out.withColumn("value", finished("value", finish))
    return strips.strip_pixels(out, fov, ["value"])


def placed_planes(planes: DataFrame, fits: DataFrame, fov: list[str], offset_planes=0.0) -> DataFrame:
    """Planes of fields that have a surface, with what weighs them: ``z, n_z, coefs, offset``."""
    counts = planes.groupBy(*fov).agg(F.count(F.lit(1)).alias("n_z"))
    facts = fits.where(F.col("error").isNull()).select(*fov, "coefs").join(counts, fov)
    offset = F.lit(offset_planes) if isinstance(offset_planes, (int, float)) else offset_planes
    return join_facts(planes, facts, fov, salt_on=[*fov, "z"]).withColumn("offset", offset.cast("double"))


def finished(values: str, finish: str | None) -> Column:
    """Samples as the source's kind of number."""
    if finish == "uint16":
        return F.transform(values, lambda v: px.clip(F.floor(v + 0.5), F.lit(0), F.lit(65535)).cast(INT))
    if finish == "truncate":
        return F.transform(values, lambda v: px.clip(v.cast("long"), F.lit(0), F.lit(65535)).cast(INT))
    return F.col(values)


def sum_project(planes: DataFrame, fov: list[str]) -> DataFrame:
    """Sum over z per pixel, in double, and how many planes went into it."""
    out = strips.strip_sums({"value": planes}, fov)
    return strips.strip_pixels(out, [*fov, "n_value"], ["value"]).select(*fov, "y", "x", "value", F.col("n_value").alias("n_z"))


def donut_average(planes: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel as the weighted mean of its neighbours; a stencil over the plane's own array."""
    rows = explode_pixels(planes, keys)
    return rows.select(
        *keys, "y", "x", px.donut_average("values", "y", "x", F.col("height"), F.col("width")).alias("value")
    )


def dark_frame_statistics(planes: DataFrame, keys: list[str]) -> DataFrame:
    rows = planes.select(*keys, F.explode("values").alias("v"))
    return rows.groupBy(*keys).agg(F.avg("v").alias("offset"), F.var_samp("v").alias("read_variance"))


def channel_range(planes: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """Min and max over all pixels of every tile, per channel; with ``step``, over every step-th row and column.

    Each plane gives its own two numbers first, so pixels never become rows.
    """
    seen = F.col("values")
    if step > 1:
        on_grid = lambda _v, i: (F.floor(i / F.col("width")) % step == 0) & (i % F.col("width") % step == 0)
        seen = F.filter("values", on_grid)
    return planes.groupBy(*keys).agg(F.min(F.array_min(seen)).alias("vmin"), F.max(F.array_max(seen)).alias("vmax"))


def merge_denoised_channels(source: DataFrame, existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Per field and channel: this run's result, else the output already there, else the source."""
    e = existing.select(*key, F.col("values").alias("_old"))
    n = new.select(*key, F.col("values").alias("_new"))
    out = source.join(e, key, "left").join(n, key, "left")
    origin = F.when(F.col("_new").isNotNull(), "new").when(F.col("_old").isNotNull(), "existing").otherwise("source")
    return out.select(
        *[c for c in source.columns if c != "values"],
        F.coalesce("_new", "_old", "values").alias("values"),
        origin.alias("origin"),
    )
