"""Pixel arithmetic as Columns, so it stays inside generated code."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Gaussian weights (sigma 1) of edge and corner neighbours.
EDGE_WEIGHT = math.exp(-0.5)
CORNER_WEIGHT = math.exp(-1.0)

FLOAT64_EPS = 2.220446049250313e-16


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(value, lo, hi) -> Column:
    return F.least(F.greatest(_col(value), lo), hi)


def stretch_to_uint8(value, lo, hi) -> Column:
    """Contrast stretch to 0..255, truncated; an empty range gives 0."""
    lo, hi = _col(lo), _col(hi)
    scaled = clip((_col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0), F.lit(1.0))
    return F.when(hi <= lo, F.lit(0)).otherwise(F.floor(scaled * 255).cast("int"))


def window_start(center, size) -> Column:
    """First pixel of a window of ``size`` around ``center`` (half rounds to even)."""
    half = F.floor(_col(size) / F.lit(2)) if not isinstance(size, int) else F.lit(size // 2)
    return F.rint(_col(center)).cast("long") - half.cast("long")


def axis_window(center, size: int, limit) -> dict[str, Column]:
    """Clipped source range and the matching range inside the tile, for one axis."""
    start = window_start(center, size)
    src0 = F.greatest(start, F.lit(0).cast("long"))
    src1 = F.least(start + F.lit(size), _col(limit).cast("long"))
    return {"src0": src0, "src1": src1, "dst0": src0 - start, "dst1": src1 - start}


def as_uint16(value) -> Column:
    """Nearest count (half to even), clipped to sixteen bits."""
    return clip(F.rint(_col(value)), F.lit(0.0), F.lit(65535.0)).cast("int")


def non_negative(value) -> Column:
    return F.greatest(_col(value), F.lit(0.0))


def effective_background(background, camera_offset, n_z, strict: bool = False) -> Column:
    """Solver background for a sum over ``n_z`` planes.

    Where the count is needed but unknown: NULL, or with ``strict`` a failed job.
    """
    offset = _col(camera_offset)
    scaled = _col(background) + offset * _col(n_z)
    if strict:
        message = F.lit("the number of summed planes is unknown; reduce the file again or set the offset to 0")
        scaled = F.when(_col(n_z).isNull(), F.raise_error(message).cast("double")).otherwise(scaled)
    return F.when(offset == 0, _col(background)).otherwise(scaled)


def effective_background_status(camera_offset, n_z) -> Column:
    return F.when((_col(camera_offset) != 0) & _col(n_z).isNull(), "missing plane count").otherwise("ok")


# Fixed value: a PSF may stray this far from the grid spacing it is used on.
PSF_TOLERANCE = 0.02


def psf_spacing_ok(psf_um, image_um, zoom=1.0) -> Column:
    """True where the spacings agree, or where one is unknown and nothing can be checked."""
    expected = _col(image_um) / zoom
    close = F.abs(_col(psf_um) - expected) <= PSF_TOLERANCE * expected
    return F.coalesce(close, F.lit(True))


def to_photons(value, offset, gain) -> Column:
    return (_col(value) - _col(offset)) / _col(gain)


def to_camera_units(photons, gain) -> Column:
    return _col(photons) * _col(gain)


def split_background(background, offset, gain) -> Column:
    return (_col(background) - _col(offset)) / _col(gain)


def pedestal(read_variance, gain) -> Column:
    r = _col(read_variance)
    return F.when(r <= 0, F.lit(1.0)).otherwise(r / (_col(gain) * _col(gain)))


def composite_rgb(channels: list[dict]) -> list[Column]:
    """Blend channels onto black, in order; returns the r, g, b byte columns.

    Each channel is a dict with ``value`` (Column or name), ``vmin``, ``vmax``,
    ``color`` (three floats), ``blend`` ("additive" or "overlay"), ``opacity``
    and optionally ``visible``.
    """
    rgb = [F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    for ch in channels:
        if not ch.get("visible", True):
            continue
        span = ch["vmax"] - ch["vmin"]
        span = span if span > 0 else 1.0
        t = clip((_col(ch["value"]) - ch["vmin"]) / span, F.lit(0.0), F.lit(1.0)) * ch["opacity"]
        for i in range(3):
            base = rgb[i] * (1.0 - t) if ch["blend"] == "overlay" else rgb[i]
            rgb[i] = clip(base + t * ch["color"][i], F.lit(0.0), F.lit(1.0))
    return [F.floor(c * 255.0).cast("int") for c in rgb]


def masked_unit(value, mask) -> Column:
    """Byte value scaled to 0..1 inside the mask (255), 0 outside."""
    return F.when(_col(mask) == 255, _col(value) / 255.0).otherwise(F.lit(0.0))


def plane_at(values, y, x, width) -> Column:
    """Pixel of a row-major plane held in one array."""
    return F.get(_col(values), (_col(y) * _col(width) + _col(x)).cast("int"))


def reflect(index, limit) -> Column:
    """Mirror an out-of-range index back, without repeating the edge pixel."""
    i, n = _col(index), _col(limit)
    period = F.greatest(n * 2 - 2, F.lit(1))
    m = F.pmod(i, period)
    return F.when(n == 1, F.lit(0)).when(m < n, m).otherwise(period - m)


def donut_average(values, y, x, height, width) -> Column:
    """Weighted mean of the eight neighbours, the border mirrored."""
    y, x = _col(y), _col(x)
    total = 4 * (EDGE_WEIGHT + CORNER_WEIGHT)
    out = F.lit(0.0)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy == 0 and dx == 0:
                continue
            w = (EDGE_WEIGHT if dy == 0 or dx == 0 else CORNER_WEIGHT) / total
            out = out + w * plane_at(values, reflect(y + dy, height), reflect(x + dx, width), width)
    return out


def in_polygon(px, py, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule: an edge counts when it crosses the ray to the right of the point."""
    px, py = _col(px), _col(py)
    inside = F.lit(False)
    n = len(vertices)
    for i in range(n):
        (x1, y1), (x2, y2) = vertices[i], vertices[(i + 1) % n]
        if y1 == y2:
            continue
        crosses = (F.lit(y1) > py) != (F.lit(y2) > py)
        at = F.lit(x1) + (py - y1) * ((x2 - x1) / (y2 - y1))
        inside = inside != (crosses & (px < at))
    return inside


def contrast_range(stats: dict[str, Column], integer: bool) -> tuple[Column, Column]:
    """Display range from the aggregates built by ``operators.contrast``.

    Signed data gets a range symmetric about zero; otherwise the percentile
    bracket of the positive pixels, falling back to min/max, then to a pad.
    """
    lo, hi = stats["min"], stats["max"]

    def pad(v):
        return F.lit(1.0) if integer else F.greatest(F.abs(v), F.lit(1.0)) * (FLOAT64_EPS * 1024.0)

    signed = (lo < 0) & (hi > 0)
    r = F.when(stats["abs_hi"] > 0, stats["abs_hi"]).otherwise(stats["abs_max"])
    p_lo = F.coalesce(stats["pos_lo"], stats["all_lo"])
    p_hi = F.coalesce(stats["pos_hi"], stats["all_hi"])
    vmin = (
        F.when(lo.isNull(), F.lit(0.0)).when(signed, -r).when(p_hi > p_lo, p_lo).otherwise(lo)
    )
    vmax = (
        F.when(lo.isNull(), F.lit(1.0))
        .when(signed, r)
        .when(p_hi > p_lo, p_hi)
        .when(hi > lo, hi)
        .otherwise(lo + pad(lo))
    )
    return vmin, vmax


# Pole of the quadratic B-spline prefilter and its impulse gain.
_POLE = math.sqrt(8.0) - 3.0
_GAIN = -8.0 * _POLE / (1.0 - _POLE * _POLE)


def prefilter_row(z, n) -> Column:
    """How much plane ``z`` counts in each of the ``n`` spline coefficients (mirrored ends).

    Depends on the plane only, so it is computed once per plane, not per pixel.
    """
    z, n = _col(z).cast("int"), _col(n).cast("int")
    period = 2 * n - 2

    def p(k):
        return F.pow(F.lit(_POLE), k.cast("double"))

    def weight(i):
        d, e = F.abs(i - z), i + z
        image = F.when((z == 0) | (z == n - 1), F.lit(0.0)).otherwise(p(e) + p(period - e))
        return _GAIN / F.nullif(1.0 - p(period), F.lit(0.0)) * (p(d) + p(period - d) + image)

    row = F.transform(F.sequence(F.lit(0), n - 1), weight)
    return F.when(n == 1, F.array(F.lit(1.0))).otherwise(row)


def spline_plane_weight(zc, row, n) -> Column:
    """Weight of a plane in the quadratic-spline sample at height ``zc``, given its ``prefilter_row``.

    The sample is linear in the planes, so summing weight times value over the
    planes of a pixel gives it, and that sum aggregates map-side.
    """
    zc, row = _col(zc), _col(row)
    r = F.floor(zc + 0.5).cast("int")
    d = zc - r
    last = (_col(n) - 1).cast("int")

    def tap(t):
        i = F.abs(r + t)
        return F.get(row, F.greatest(F.least(i, last * 2 - i), F.lit(0)))

    return (
        0.5 * (0.5 - d) * (0.5 - d) * tap(-1) + (0.75 - d * d) * tap(0) + 0.5 * (0.5 + d) * (0.5 + d) * tap(1)
    )


def spline_row_weights(z: int, n: int, zc: np.ndarray) -> np.ndarray:
    """``spline_plane_weight`` of plane ``z`` of ``n`` for arrays of heights within the stack."""
    row = np.ones(1)
    if n > 1:
        i, period = np.arange(n), 2 * n - 2
        image = 0.0 if z in (0, n - 1) else _POLE ** (i + z) + _POLE ** (period - i - z)
        row = _GAIN / (1.0 - _POLE**period) * (_POLE ** np.abs(i - z) + _POLE ** (period - np.abs(i - z)) + image)
    r = np.floor(zc + 0.5).astype(np.int64)
    d = zc - r

    def tap(t: int) -> np.ndarray:
        i = np.abs(r + t)
        return row[np.maximum(np.minimum(i, 2 * (n - 1) - i), 0)]

    return 0.5 * (0.5 - d) ** 2 * tap(-1) + (0.75 - d * d) * tap(0) + 0.5 * (0.5 + d) ** 2 * tap(1)


def linear_plane_weight(zc, z) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(_col(zc) - _col(z).cast("double")))
