"""Sums of weighted image planes as strips: runs of whole pixel rows of bounded size, held as arrays.

A task adds up the planes it reads strip by strip and sends one array per strip and channel; a second pass adds the tasks'
arrays. Images are shuffled once, as arrays of sums, whatever the number of planes, and pixels become rows only where a caller asks.
A field of any size spreads over its strips. Missing pixel values add nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pixels import spline_row_weights

STRIP_PIXELS = 65_536
#: Sums a task holds before it sends them, in pixels.
HELD_PIXELS = 16_000_000
#: Pixels read for a batch of results.
MADE_PIXELS = 1_000_000


def _surface(coefs: np.ndarray, degree: tuple[int, int], at: np.ndarray, height: int, width: int) -> np.ndarray:
    """The fitted polynomial at flat positions of an image."""
    sy, sx = (2.0 * c / max(n - 1, 1) - 1.0 for c, n in ((at // width, height), (at % width, width)))
    total = np.zeros(len(at))
    for i in range(degree[0] + 1):
        for j in range(degree[1] + 1):
            total = total + coefs[i * (degree[1] + 1) + j] * sx**i * sy**j
    return total


def _weights(z: int, n: int, zc: np.ndarray, method: str) -> np.ndarray:
    """How much plane ``z`` of ``n`` counts in samples at heights ``zc``."""
    zc = np.clip(zc, 0.0, n - 1.0)
    return np.maximum(0.0, 1.0 - np.abs(zc - z)) if method == "linear" else spline_row_weights(z, n, zc)


def _flat(values: pa.ListArray, i: int) -> np.ndarray:
    a, b = values.offsets[i].as_py(), values.offsets[i + 1].as_py()
    part = pc.fill_null(values.values.slice(a, b - a), 0)
    return part.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _arrays(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def _partial(fov: list[str], degree: tuple[int, int], method: str, strip_pixels: int, held_pixels: int):
    names = [*fov, "strip", "first", "width", "channel", "n", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        pixels, kinds = 0, []

        def sent() -> pa.RecordBatch:
            keys = list(zip(*held))
            whole = [pa.array(keys[i], t) for i, t in enumerate(kinds)]
            ints = [pa.array(keys[len(fov) + i], pa.int32()) for i in range(4)]
            return pa.RecordBatch.from_arrays([*whole, *ints, pa.array([h[0] for h in held.values()], pa.int64()), _arrays([h[1] for h in held.values()])], names=names)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in fov]
            small = [batch.column(c).to_pylist() for c in (*fov, "channel", "height", "width", "z", "n_z", "coefs", "offset")]
            values = batch.column("values")
            for i, (*key, channel, height, width, z, n_z, coefs, offset) in enumerate(zip(*small)):
                plane, rows = _flat(values, i), max(1, strip_pixels // max(1, width))
                for strip, first in enumerate(range(0, len(plane), rows * width)):
                    part = plane[first : first + rows * width]
                    if coefs is not None:
                        at = np.arange(first, first + len(part))
                        part = part * _weights(z, n_z, _surface(np.asarray(coefs), degree, at, height, width) + offset, method)
                    name = (*key, strip, first, width, channel)
                    if name in held:
                        held[name][0] += 1
                        held[name][1] = held[name][1] + part
                    else:
                        held[name] = [1, part]
                        pixels += len(part)
                if pixels > held_pixels:
                    yield sent()
                    held, pixels = {}, 0
        if held:
            yield sent()

    return run


def _merged(fov: list[str], channels: list[str]):
    """Adds up rows sorted by field, strip and channel; one row per strip, in batches of bounded size."""
    names = [*fov, "strip", "first", "width", *[f"n_{c}" for c in channels], *channels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, kinds = None, {}, []
        done: list[tuple[list, dict]] = []
        pixels = 0

        def made() -> pa.RecordBatch:
            fields = [pa.array([k[i] for k, _ in done], t) for i, t in enumerate([*kinds, pa.int32(), pa.int32(), pa.int32()])]
            counts = [pa.array([s[c][0] if c in s else None for _, s in done], pa.int64()) for c in range(len(channels))]
            arrays = []
            for c in range(len(channels)):
                there = np.array([c in s for _, s in done])
                stops = np.cumsum([0, *[len(s[c][1]) if c in s else 0 for _, s in done]])
                flat = np.concatenate([np.zeros(0), *[s[c][1] for _, s in done if c in s]])
                arrays.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat), mask=pa.array(~there)))
            return pa.RecordBatch.from_arrays([*fields, *counts, *arrays], names=names)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in fov]
            small = [batch.column(c).to_pylist() for c in (*fov, "strip", "first", "width", "channel", "n")]
            values = batch.column("values")
            for i, (*name, channel, n) in enumerate(zip(*small)):
                if name != key:
                    if key is not None:
                        done.append((key, sums))
                    if pixels > MADE_PIXELS:
                        yield made()
                        done, pixels = [], 0
                    key, sums = name, {}
                part = _flat(values, i)
                pixels += len(part)
                sums[channel] = [sums[channel][0] + n, sums[channel][1] + part] if channel in sums else [n, part]
        if key is not None:
            done.append((key, sums))
            yield made()

    return run


def strip_sums(
    planes: dict[str, DataFrame], fov: list[str], degree: tuple[int, int] = (0, 0), method: str = "spline", strip_pixels: int = STRIP_PIXELS, held_pixels: int = HELD_PIXELS
) -> DataFrame:
    """``(fov…, strip, first, width)`` with, per channel, the sums of its planes as an array and ``n_<channel>``, their number.

    ``planes`` names frames ``(fov…, height, width, values)``. Frames that also have ``z, n_z, coefs`` and ``offset`` are sampled at the
    surface of these coefficients: each plane is weighted by its share in the sample. ``first`` is the flat position of a strip's first pixel.
    """
    parts = None
    for number, frame in enumerate(planes.values()):
        weighted = "coefs" in frame.columns
        extra = [(F.col(c) if weighted else F.lit(None)).cast(t).alias(c) for c, t in (("z", "long"), ("n_z", "long"), ("coefs", "array<double>"), ("offset", "double"))]
        rows = frame.select(*fov, F.lit(number).alias("channel"), "height", "width", *extra, F.col("values").cast("array<double>").alias("values"))
        parts = rows if parts is None else parts.unionByName(rows)
    keys = [parts.schema[k] for k in fov]
    ints = [T.StructField(c, T.IntegerType()) for c in ("strip", "first", "width")]
    many = T.ArrayType(T.DoubleType())
    sent = T.StructType([*keys, *ints, T.StructField("channel", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("values", many)])
    partial = parts.mapInArrow(_partial(fov, degree, method, strip_pixels, held_pixels), sent)
    channels = list(planes)
    made = T.StructType([*keys, *ints, *[T.StructField(f"n_{c}", T.LongType()) for c in channels], *[T.StructField(c, many) for c in channels]])
    ordered = partial.repartition(*fov, "strip").sortWithinPartitions(*fov, "strip", "channel")
    return ordered.mapInArrow(_merged(fov, channels), made)


def strip_pixels(strips: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per pixel: ``keys``, y, x and the named arrays' values there, null where a strip lacks one of them."""
    filled = [F.coalesce(F.col(v), F.array().cast(strips.schema[v].dataType)).alias(v) for v in values]
    flat = strips.select(*keys, "first", "width", *filled).select(*keys, "first", "width", F.posexplode(F.arrays_zip(*values)).alias("_i", "_v"))
    at = F.col("first") + F.col("_i")
    return flat.select(*keys, F.floor(at / F.col("width")).cast("int").alias("y"), (at % F.col("width")).cast("int").alias("x"), *[F.col("_v")[v].alias(v) for v in values])
