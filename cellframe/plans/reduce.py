"""Raw stacks to flat images: focus map, surface fit, focal slice, and projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images, strips
from ..session import materialize


@dataclass(frozen=True)
class FlattenParams:
    tiles_y: int = 8
    tiles_x: int = 8
    prominence: float = 100.0
    degree: tuple[int, int] = (2, 2)
    offset_um: float = 1.0
    dz_um: float = 1.0
    finish: str | None = "uint16"


def focus_diagnostics(planes: DataFrame, fov: list[str], params: FlattenParams) -> dict[str, DataFrame]:
    """Block variances, focal planes and the fitted surface. Only the first reads pixels,
    so keep it as a table when tuning the prominence."""
    variances = images.block_variance(planes, [*fov, "z"], params.tiles_y, params.tiles_x)
    peaks = images.focal_peaks(variances, fov, params.prominence)
    sizes = planes.select(*fov, "height", "width").distinct()
    fits = images.fit_focus_surface(peaks, sizes, fov, params.tiles_y, params.tiles_x, params.degree)
    return {"variances": variances, "peaks": peaks, "fits": fits}


def reduce_fovs(
    brightfield: DataFrame, target: DataFrame, fov: list[str], params: FlattenParams = FlattenParams()
) -> tuple[DataFrame, DataFrame]:
    """(reduced pixels, run report rows).

    Reduced rows are ``(fov…, y, x, brightfield, target, n_z)``; a field whose
    surface could not be fitted gives an error row instead, and the rest go on.
    """
    # One row per field, made from every plane: kept aside for the slice and the report.
    fits = materialize(focus_diagnostics(brightfield, fov, params)["fits"], "fits")
    placed = images.placed_planes(brightfield, fits, fov, params.offset_um / params.dz_um)
    # both channels in one pass and one shuffle; a field without a surface has no brightfield strips
    both = strips.strip_sums({"brightfield": placed, "target": target}, fov, params.degree)
    both = both.where("brightfield is not null and target is not null").withColumn("brightfield", images.finished("brightfield", params.finish))
    reduced = strips.strip_pixels(both.withColumnRenamed("n_target", "n_z"), [*fov, "n_z"], ["brightfield", "target"])
    reduced = reduced.select(*fov, "y", "x", "brightfield", "target", "n_z")
    report = fits.select(
        *fov, F.lit("reduce").alias("stage"), F.col("error").isNull().alias("success"), "error"
    )
    return reduced, report
