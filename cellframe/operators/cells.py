"""Cells: geometry, crops, outlines, overlap, and finding the same cell again after a re-export.

``label_pixels`` is ``(image…, y, x, label)`` with background rows left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels as px
from ..functions.names import cell_id_for
from ..session import materialize
from .skew import blocked_rank, merge_join, salted_join


def cell_geometry(label_pixels: DataFrame, image: list[str], size: int, height, width) -> DataFrame:
    """Centroid and clipped crop window of every cell."""
    h = F.lit(height) if isinstance(height, int) else height
    w = F.lit(width) if isinstance(width, int) else width
    cells = (
        label_pixels.where(F.col("label") != 0)
        .groupBy(*image, "label")
        .agg(F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"))
    )
    ay = px.axis_window("centroid_y", size, h)
    ax = px.axis_window("centroid_x", size, w)
    return cells.select(
        *image,
        "label",
        "centroid_y",
        "centroid_x",
        ay["src0"].alias("src_y0"),
        ay["src1"].alias("src_y1"),
        ax["src0"].alias("src_x0"),
        ax["src1"].alias("src_x1"),
        ay["dst0"].alias("dst_y0"),
        ax["dst0"].alias("dst_x0"),
    )


def crop_cells(
    pixels: DataFrame, geometry: DataFrame, image: list[str], block: int = 64, value_cols=("value",), cell_cols=()
) -> DataFrame:
    """Pixels inside each cell's window, in tile coordinates, with chosen columns of pixel and cell.

    A two-dimensional range join as an equi-join: windows are expanded to the
    grid blocks they touch, pixels know theirs, and the exact bounds are checked
    on the matches. The block is part of the key, so a large image spreads out.
    """
    def span(lo, hi):
        return F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block))

    g = geometry.where((F.col("src_y1") > F.col("src_y0")) & (F.col("src_x1") > F.col("src_x0")))
    g = g.select(*image, F.col("label").alias("cell_label"), "src_y0", "src_y1", "src_x0", "src_x1", "dst_y0", "dst_x0",
                 *cell_cols, F.explode(span("src_y0", "src_y1")).alias("_by"))
    g = g.withColumn("_bx", F.explode(span("src_x0", "src_x1")))
    p = pixels.withColumn("_by", F.floor(F.col("y") / block)).withColumn("_bx", F.floor(F.col("x") / block))
    hits = merge_join(p, g, [*image, "_by", "_bx"]).where(
        (F.col("y") >= F.col("src_y0"))
        & (F.col("y") < F.col("src_y1"))
        & (F.col("x") >= F.col("src_x0"))
        & (F.col("x") < F.col("src_x1"))
    )
    return hits.select(
        *image,
        F.col("cell_label").alias("label"),
        (F.col("y") - F.col("src_y0") + F.col("dst_y0")).cast("int").alias("ty"),
        (F.col("x") - F.col("src_x0") + F.col("dst_x0")).cast("int").alias("tx"),
        *value_cols,
        *cell_cols,
    )


def mask_outline(label_pixels: DataFrame, image: list[str]) -> DataFrame:
    """Labelled pixels with a 4-neighbour of another label (background and beyond the image included).

    Every pixel reports its label to itself and its neighbours; one aggregate
    per receiving pixel then sees them all.
    """
    steps = F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    ])
    own = (F.col("s.dy") == 0) & (F.col("s.dx") == 0)
    sent = label_pixels.where(F.col("label") != 0).select(*image, "y", "x", "label", F.explode(steps).alias("s")).select(
        *image,
        (F.col("y") + F.col("s.dy")).alias("y"),
        (F.col("x") + F.col("s.dx")).alias("x"),
        F.when(own, F.col("label")).alias("own"),
        F.when(~own, F.col("label")).alias("near"),
    )
    seen = sent.groupBy(*image, "y", "x").agg(
        F.max("own").alias("label"), F.count("near").alias("_n"), F.min("near").alias("_lo"), F.max("near").alias("_hi")
    )
    differs = (F.col("_n") < 4) | (F.col("_lo") != F.col("label")) | (F.col("_hi") != F.col("label"))
    return seen.where(F.col("label").isNotNull() & differs).select(*image, "y", "x", "label")


def drop_edge_cells(label_pixels: DataFrame, image: list[str], height: int, width: int) -> DataFrame:
    """Cells that touch the image border are removed, the others renumbered from 1 in label order."""
    boxes = label_pixels.where(F.col("label") != 0).groupBy(*image, "label").agg(
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.count(F.lit(1)).alias("n_pixels"),
    )
    inner = boxes.where(
        (F.col("_y0") > 0) & (F.col("_x0") > 0) & (F.col("_y1") < height - 1) & (F.col("_x1") < width - 1)
    )
    return blocked_rank(inner.select(*image, "label", "n_pixels"), image, "label", "new_label")


def relabel_pixels(label_pixels: DataFrame, relabelled: DataFrame, image: list[str]) -> DataFrame:
    """Apply ``drop_edge_cells`` to the pixels."""
    names = relabelled.select(*image, "label", "new_label")
    out = salted_join(label_pixels, names, [*image, "label"], "inner", salt_on=["y", "x"])
    return out.select(*image, "y", "x", F.col("new_label").alias("label"))


def mask_iou(a: DataFrame, b: DataFrame, pair: list[str], size_a: int | None = None, size_b: int | None = None) -> DataFrame:
    """Overlap of two binary masks per pair; tiles of different size are cut to the smaller, centred window.

    ``a`` and ``b`` are set pixels ``(pair…, ty, tx)``. Both sides stream into
    one aggregate per pixel and one per pair.
    """
    def centred(df, size, side):
        y, x = F.col("ty"), F.col("tx")
        if size_a and size_b:
            y, x = y - size // 2, x - size // 2
        out = df.select(*pair, y.alias("y"), x.alias("x"), F.lit(side).alias("side"))
        if size_a and size_b:
            n = min(size_a, size_b)
            lo, hi = -(n // 2), n - n // 2
            out = out.where((F.col("y") >= lo) & (F.col("y") < hi) & (F.col("x") >= lo) & (F.col("x") < hi))
        return out

    both = centred(a, size_a, 1).unionByName(centred(b, size_b, 2))
    per_pixel = both.groupBy(*pair, "y", "x").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return per_pixel.groupBy(*pair).agg(
        F.count_if(F.col("lo") != F.col("hi")).alias("n_both"), F.count(F.lit(1)).alias("n_union")
    ).withColumn("iou", F.col("n_both") / F.col("n_union"))


# How much two cells must overlap, and how alike two tiles must look.
MIN_OVERLAP = 0.5
MIN_CORRELATION = 0.9


def match_cells(old_masks: DataFrame, old_cells: DataFrame, new_pixels: DataFrame, image: list[str], size: int) -> DataFrame:
    """The new label of each old cell: the one covering most of its footprint (ties: smallest label).

    ``old_masks`` holds the set pixels ``(image…, old_label, ty, tx)`` of the old
    tiles of side ``size``; ``old_cells`` their centroids. Accepted at an overlap
    of one half, counted inside the old tile's window. The window's pixels meet
    the new ones by their image coordinates, an equi-join spread over the image.
    """
    start_y = px.window_start("centroid_y", size).cast("int")
    start_x = px.window_start("centroid_x", size).cast("int")
    cell = [*image, "old_label"]
    placed = old_cells.select(*cell, start_y.alias("_sy"), start_x.alias("_sx"))
    window = placed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1)))).select(
        *cell,
        (F.col("_sy") + F.floor(F.col("_i") / size)).cast("int").alias("y"),
        (F.col("_sx") + F.col("_i") % size).cast("int").alias("x"),
        F.lit(0).alias("_set"),
    )
    footprint = merge_join(placed, old_masks.select(*cell, "ty", "tx"), cell).select(
        *cell, (F.col("_sy") + F.col("ty")).cast("int").alias("y"), (F.col("_sx") + F.col("tx")).cast("int").alias("x"), F.lit(1).alias("_set")
    )
    # Window and footprint pixels look up the new mask together; each cell has window rows, so none drops out.
    new = new_pixels.where(F.col("label") != 0).select(*image, F.col("y").cast("int"), F.col("x").cast("int"), "label")
    per_label = (
        merge_join(window.unionByName(footprint), new, [*image, "y", "x"], "left")
        .groupBy(*cell, "label")
        .agg(F.sum("_set").alias("inter"), F.sum(1 - F.col("_set")).alias("in_window"))
    )
    covers = F.col("label").isNotNull() & (F.col("inter") > 0)
    scored = per_label.groupBy(*cell).agg(
        F.max(F.when(covers, F.struct("inter", (-F.col("label")).alias("neg"), "in_window"))).alias("_b"),
        F.sum("inter").alias("n_old"),
    )
    iou = F.col("_b.inter") / (F.col("n_old") + F.col("_b.in_window") - F.col("_b.inter"))
    return scored.select(
        *cell, F.when(iou >= MIN_OVERLAP, -F.col("_b.neg")).cast("int").alias("new_label"), iou.alias("iou")
    )


def resolve_matches(matches: DataFrame, image: list[str], old: str = "old_label", new: str = "new_label") -> DataFrame:
    """A new cell claimed by several old ones is ambiguous: all their claims are dropped."""
    claims = matches.where(F.col(new).isNotNull()).groupBy(*image, new).agg(
        F.count(F.lit(1)).alias("_n"), F.min(old).alias(old)
    )
    sole = claims.where(F.col("_n") == 1).select(*image, old, F.col(new).alias("_new"))
    return merge_join(matches, sole, [*image, old], "left").select(*image, old, F.col("_new").alias(new))


def tiles_as_arrays(tile_pixels: DataFrame, key: list[str], size: int, window: int) -> DataFrame:
    """One row per tile, cut to a centred window: set positions, and intensities as a centred unit vector.

    ``tile_pixels`` is ``(key…, ty, tx, value, mask)`` with every pixel of the
    tile present, so a row holds ``window * window`` values. With intensities
    brought to mean 0 and length 1 here, once per tile, a correlation is a dot
    product; a constant tile becomes zeros and correlates with nothing.
    """
    y = F.col("ty") - size // 2 + window // 2
    x = F.col("tx") - size // 2 + window // 2
    cut = tile_pixels.select(*key, y.alias("_y"), x.alias("_x"), "value", "mask").where(
        (F.col("_y") >= 0) & (F.col("_y") < window) & (F.col("_x") >= 0) & (F.col("_x") < window)
    )
    packed = F.array_sort(F.collect_list(F.struct((F.col("_y") * window + F.col("_x")).alias("p"), "value", "mask")))
    rows = cut.groupBy(*key).agg(
        packed.alias("_t"),
        F.avg("value").alias("_mean"),
        (F.stddev_pop("value") * F.sqrt(F.count(F.lit(1)))).alias("_norm"),
    )
    unit = F.transform(
        "_t", lambda s: F.coalesce((s["value"] - F.col("_mean")) / F.nullif(F.col("_norm"), F.lit(0.0)), F.lit(0.0))
    )
    return rows.select(
        *key,
        F.transform(F.filter("_t", lambda s: s["mask"] > 0), lambda s: s["p"]).alias("set_pixels"),
        unit.alias("intensity"),
    )


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


# Number of low frequencies a signature holds, and how many of them lay out the grid on which tiles meet.
SIGNATURE, GRID = 16, 3
#: Unit vectors that correlate by at least MIN_CORRELATION are no further apart than this, and their signatures no more.
REACH = (2 - 2 * MIN_CORRELATION) ** 0.5 * (1 + 1e-9)


def _cosines(window: int, n: int) -> np.ndarray:
    """The n lowest two-dimensional cosine waves without the constant one: orthonormal rows over a square window."""
    orders = sorted((p + q, p, q) for p in range(window) for q in range(window) if p + q)[:n]
    at = np.arange(window)
    wave = [np.cos(np.pi * (2 * at + 1) * p / (2 * window)) for p in range(window)]
    wave = [w / np.linalg.norm(w) for w in wave]
    return np.array([np.outer(wave[p], wave[q]).ravel() for _, p, q in orders]).reshape(-1, window * window)


def content_signatures(tiles: DataFrame, key: list[str], window: int) -> DataFrame:
    """``(key…, n_set, content, signature)`` of tiles that can match at all: with a mask, and not constant.

    ``content`` is the sha256 of mask and intensities; ``signature`` the low frequencies of the unit vector.
    """
    basis = _cosines(window, SIGNATURE)

    def sign(batches):
        for pdf in batches:
            masks, values = pdf.pop("set_pixels"), pdf.pop("intensity")
            use = [len(m) > 0 and bool(np.any(v)) for m, v in zip(masks, values)]
            pdf, masks, values = pdf[use], masks[use], values[use]
            if not len(pdf):
                continue
            rows = np.stack([np.asarray(v, dtype=np.float64) for v in values])
            shas = [hashlib.sha256(np.asarray(m, dtype=np.int64).tobytes() + r.tobytes()).digest() for m, r in zip(masks, rows)]
            yield pdf.assign(n_set=[len(m) for m in masks], content=shas, signature=list(rows @ basis.T))

    fields = [tiles.schema[k] for k in key]
    schema = T.StructType(fields).add("n_set", "long").add("content", "binary").add("signature", T.ArrayType(T.DoubleType()))
    return tiles.select(*key, "set_pixels", "intensity").mapInPandas(sign, schema)


def content_candidates(old: DataFrame, new: DataFrame, image: list[str]) -> DataFrame:
    """Pairs ``(image…, old_label, new_label)`` of signed tiles that may match; none that does is missing.

    A projection never lengthens a distance, so matching tiles lie within REACH of one another in every low
    frequency. Tiles meet on a grid of that width over the frequencies that vary most, a pair at most once, and go on
    if their whole signatures are near and their masks of comparable size.
    """
    spread = old.unionByName(new, allowMissingColumns=True).agg(
        *[F.coalesce(F.var_pop(F.get("signature", F.lit(i))), F.lit(0.0)).alias(str(i)) for i in range(SIGNATURE)]
    ).first()
    axes = sorted(range(SIGNATURE), key=lambda i: -spread[i])[:GRID]

    def step(i: int) -> Column:
        return F.floor(F.coalesce(F.get("signature", F.lit(i)), F.lit(0.0)) / REACH).cast("int")

    left = old.select(*image, "old_label", F.col("n_set").alias("_na"), F.col("signature").alias("_a"), *[step(i).alias(f"_g{i}") for i in axes])
    right = new.select(*image, "new_label", F.col("n_set").alias("_nb"), F.col("signature").alias("_b"), *[step(i).alias(f"_g{i}") for i in axes])
    for i in axes:
        around = F.array(*[F.col(f"_g{i}") + F.lit(shift) for shift in (-1, 0, 1)])
        right = right.withColumn(f"_g{i}", F.explode(around))
    met = left.join(right, [*image, *[f"_g{i}" for i in axes]]).where("_na <= 2 * _nb and _nb <= 2 * _na")
    apart = F.aggregate(F.zip_with("_a", "_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)
    return met.where(apart <= REACH * REACH).select(*image, "old_label", "new_label")


def match_cells_by_content(old: DataFrame, new: DataFrame, image: list[str], window: int) -> DataFrame:
    """For old tiles without a recorded place: the new tile of the image that looks the same.

    Wanted are mask overlap of one half and the best correlation of at least
    0.9 (ties: the highest new label). Tiles meet by their signatures
    (``content_candidates``), which are a few numbers each; pixels are fetched
    for the candidates only and decide. Tiles of equal content in an image are looked at once.

    ``old`` and ``new`` are ``(image…, old_label | new_label, set_pixels, intensity)``.
    """
    signed_old = materialize(content_signatures(old, [*image, "old_label"], window), "signed")
    signed_new = materialize(content_signatures(new, [*image, "new_label"], window), "signed")
    same = [*image, "content"]
    first = signed_old.groupBy(*same).agg(F.min("old_label").alias("old_label"), F.first("n_set").alias("n_set"), F.first("signature").alias("signature"))
    last = signed_new.groupBy(*same).agg(F.max("new_label").alias("new_label"), F.first("n_set").alias("n_set"), F.first("signature").alias("signature"))
    first = materialize(first, "contents")
    candidates = content_candidates(first.drop("content"), last.drop("content"), image)
    o = old.select(*image, "old_label", F.col("set_pixels").alias("_sa"), F.col("intensity").alias("_ia"))
    n = new.select(*image, "new_label", F.col("set_pixels").alias("_sb"), F.col("intensity").alias("_ib"))
    pairs = candidates.join(o, [*image, "old_label"]).join(n, [*image, "new_label"])
    both = F.size(F.array_intersect("_sa", "_sb"))
    iou = both / (F.size("_sa") + F.size("_sb") - both)
    good = pairs.withColumn("iou", iou).where(F.col("iou") >= MIN_OVERLAP).withColumn(
        "corr", dot("_ia", "_ib")
    ).where(F.col("corr") >= MIN_CORRELATION)
    best = good.groupBy(*image, "old_label").agg(F.max(F.struct("corr", "new_label", "iou")).alias("_b"))
    by_content = first.select(*same, "old_label").join(best, [*image, "old_label"]).select(*same, "_b")
    members = signed_old.select(*same, "old_label").join(by_content, same).select(*image, "old_label", "_b")
    return old.select(*image, "old_label").join(members, [*image, "old_label"], "left").select(
        *image,
        "old_label",
        F.col("_b.new_label").alias("new_label"),
        F.col("_b.corr").alias("corr"),
        F.col("_b.iou").alias("iou"),
    )


def carry_over_mapping(matches: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag moves after a re-export: old cell id to new one, NULL where lost; unchanged ids left out.

    ``matches`` is ``(project, fov_id, old_label, new_label)``, already resolved.
    """
    named = matches.select(
        "project",
        "fov_id",
        cell_id_for("fov_id", "old_label").alias("cell_id"),
        F.when(F.col("new_label").isNotNull(), cell_id_for("fov_id", "new_label")).alias("new_cell_id"),
    )
    tagged = merge_join(named, tags.select("project", "fov_id", "cell_id"), ["project", "fov_id", "cell_id"], "left_semi")
    return tagged.where(~F.col("new_cell_id").eqNullSafe(F.col("cell_id")))


def carry_over_counts(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count("new_cell_id").alias("tags_moved"), (F.count(F.lit(1)) - F.count("new_cell_id")).alias("tags_dropped")
    )


def encode_tiles(tile_pixels: DataFrame, key: list[str], size: int, grid: int = 4) -> DataFrame:
    """A plain embedding: block means of the masked tile, row by row.

    ``tile_pixels`` is ``(key…, ty, tx, value, mask)`` with byte values.
    """
    side = -(-size // grid)
    block = (F.floor(F.col("ty") / side) * grid + F.floor(F.col("tx") / side)).cast("int")
    means = tile_pixels.groupBy(*key, block.alias("b")).agg(F.avg(px.masked_unit("value", "mask")).alias("m"))
    return means.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda s: s["m"].cast("float")).alias("embedding")
    )
