"""Pixels, planes, focus, crops, masks and camera calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import cells, contrast, images, photon
from ..plans import encode, export, reduce, reexport
from ..schemas import TAGS
from ..session import materialize, scratch_dir
from ..sources.versions import VersionedTables
from .core import Views, query, r6

IMG = ["vec_id"]
SIZE = 8

# --- scalar pixel functions ---------------------------------------------------------


@query(
    "stretch_to_uint8",
    """WITH b AS (SELECT vec_id, quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM fx_pixels GROUP BY 1)
       SELECT vec_id, y, x, CASE WHEN hi <= lo THEN 0 ELSE CAST(floor(least(greatest((value - lo) / (hi - lo), 0), 1) * 255) AS BIGINT) END AS value
       FROM fx_pixels JOIN b USING (vec_id)""",
)
def _(v: Views):
    return contrast.stretch(v.pixels.select("vec_id", "y", "x", "value"), IMG, 0.1, 99.9)


@query(
    "axis_window",
    """WITH c AS (SELECT vec_id, label, avg(y) AS cy FROM fx_mask GROUP BY 1, 2),
       s AS (SELECT *, CAST(round_even(cy, 0) AS BIGINT) - 2 AS start FROM c)
       SELECT vec_id, label, greatest(start, 0) AS src0, least(start + 5, 8) AS src1, greatest(start, 0) - start AS dst0,
         least(start + 5, 8) - start AS dst1 FROM s""",
)
def _(v: Views):
    w = px.axis_window("cy", 5, F.lit(8))
    c = v.mask.groupBy("vec_id", "label").agg(F.avg("y").alias("cy"))
    return c.select("vec_id", "label", *[col.alias(n) for n, col in w.items()])


@query(
    "uint16_cast",
    """SELECT vec_id, y, x, CAST(least(greatest(round_even(value * 200000, 0), 0), 65535) AS BIGINT) AS counts,
       round(greatest(value, 0), 6) AS signal FROM fx_pixels""",
)
def _(v: Views):
    return v.pixels.select(
        "vec_id", "y", "x", px.as_uint16(F.col("value") * 200000).alias("counts"), r6(px.non_negative("value")).alias("signal")
    )


@query(
    "effective_background",
    """SELECT fov, n_z, offs, CASE WHEN offs = 0 THEN 5.0 ELSE 5.0 + offs * n_z END AS background,
         CASE WHEN offs <> 0 AND n_z IS NULL THEN 'missing plane count' ELSE 'ok' END AS status
       FROM (SELECT fov, CASE WHEN fov % 3 <> 0 THEN count(*) END AS n_z, CAST(fov % 2 * 100 AS DOUBLE) AS offs FROM fx_planes GROUP BY fov)""",
)
def _(v: Views):
    f = v.planes.groupBy("fov").agg(F.count(F.lit(1)).alias("n")).select(
        "fov", F.when(F.col("fov") % 3 != 0, F.col("n")).alias("n_z"), (F.col("fov") % 2 * 100).cast("double").alias("offs")
    )
    return f.select(
        "fov",
        "n_z",
        "offs",
        px.effective_background(F.lit(5.0), "offs", "n_z").alias("background"),
        px.effective_background_status("offs", "n_z").alias("status"),
    )


@query(
    "psf_spacing_audit",
    """SELECT p_partkey, psf, img, coalesce(abs(psf - img / 1.5) <= 0.02 * (img / 1.5), true) AS ok FROM (SELECT p_partkey,
         CAST(CASE WHEN p_size % 10 <> 0 THEN 0.04 + (p_partkey % 11) * 0.001 END AS DOUBLE) AS psf,
         CAST(CASE WHEN p_partkey % 7 <> 0 THEN 0.065 END AS DOUBLE) AS img FROM part)""",
)
def _(v: Views):
    p = v.table("part").select(
        "p_partkey",
        F.when(F.col("p_size") % 10 != 0, 0.04 + (F.col("p_partkey") % 11) * 0.001).alias("psf"),
        F.when(F.col("p_partkey") % 7 != 0, F.lit(0.065)).alias("img"),
    )
    return p.select("*", px.psf_spacing_ok("psf", "img", 1.5).alias("ok"))


@query(
    "to_photons",
    """WITH d AS (SELECT fov, avg(value) AS o, var_samp(value) AS r FROM fx_counts GROUP BY 1)
       SELECT vec_id, y, x, round((value - o) / 2.3, 6) + 0.0 AS photons, round((value - o) / 2.3 * 2.3, 6) + 0.0 AS adu,
         round((1100 - o) / 2.3, 6) AS background, round(r / 5.29, 6) AS pedestal FROM fx_counts JOIN d USING (fov)""",
)
def _(v: Views):
    from ..operators.skew import join_facts

    dark = images.dark_frame_statistics(v.count_planes, ["fov"])
    rows = images.explode_pixels(v.count_planes, ["fov", "vec_id"]).drop("values", "height", "width")
    j = join_facts(rows, dark, ["fov"], salt_on=["vec_id", "y", "x"])
    g = F.lit(2.3)
    ph = px.to_photons("value", "offset", g)
    return j.select(
        "vec_id",
        "y",
        "x",
        r6(ph).alias("photons"),
        r6(px.to_camera_units(ph, g)).alias("adu"),
        r6(px.split_background(F.lit(1100.0), "offset", g)).alias("background"),
        r6(px.pedestal("read_variance", g)).alias("pedestal"),
    )


@query(
    "composite_rgb",
    """WITH c AS (SELECT fov, y, x, max(CASE WHEN z = 0 THEN value END) AS c0, max(CASE WHEN z = 1 THEN value END) AS c1,
           max(CASE WHEN z = 2 THEN value END) AS c2 FROM fx_pixels WHERE z < 3 GROUP BY 1, 2, 3),
       t AS (SELECT *, least(greatest((c0 + 0.2) / 0.4, 0), 1) * 1.0 AS t0, least(greatest((c1 + 0.1) / 0.3, 0), 1) * 0.8 AS t1,
           least(greatest((c2 - 0.0) / 0.2, 0), 1) * 0.5 AS t2 FROM c),
       a AS (SELECT *, least(t0 * 0.9, 1) AS r0, least(t0 * 0.9, 1) AS g0, least(t0 * 0.9, 1) AS b0 FROM t),
       b AS (SELECT *, least(r0 + t1 * 0.0, 1) AS r1, least(g0 + t1 * 0.6, 1) AS g1, least(b0 + t1 * 1.0, 1) AS b1 FROM a)
       SELECT fov, y, x, CAST(floor(least(greatest(r1 * (1 - t2) + t2 * 1.0, 0), 1) * 255) AS BIGINT) AS r,
         CAST(floor(least(greatest(g1 * (1 - t2) + t2 * 0.5, 0), 1) * 255) AS BIGINT) AS g,
         CAST(floor(least(greatest(b1 * (1 - t2) + t2 * 0.0, 0), 1) * 255) AS BIGINT) AS b FROM b
       WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL""",
)
def _(v: Views):
    picks = [F.max(F.when(F.col("z") == i, F.col("value"))).alias(f"c{i}") for i in range(3)]
    wide = v.pixels.where("z < 3").groupBy("fov", "y", "x").agg(*picks).dropna()
    rgb = px.composite_rgb([
        {"value": "c0", "vmin": -0.2, "vmax": 0.2, "color": (0.9, 0.9, 0.9), "blend": "additive", "opacity": 1.0},
        {"value": "c1", "vmin": -0.1, "vmax": 0.2, "color": (0.0, 0.6, 1.0), "blend": "additive", "opacity": 0.8},
        {"value": "c2", "vmin": 0.0, "vmax": 0.2, "color": (1.0, 0.5, 0.0), "blend": "overlay", "opacity": 0.5},
    ])
    return wide.select("fov", "y", "x", *[c.alias(n) for c, n in zip(rgb, "rgb")])


@query(
    "masked_pixels",
    """SELECT vec_id, y, x, round(CASE WHEN value > 0.02 THEN (CAST(round_even(value * 200, 0) AS BIGINT) + 100) / 255.0 ELSE 0 END, 6) AS value
       FROM fx_pixels""",
)
def _(v: Views):
    byte = F.rint(F.col("value") * 200).cast("int") + 100
    mask = F.when(F.col("value") > 0.02, 255).otherwise(0)
    return v.pixels.select("vec_id", "y", "x", r6(px.masked_unit(byte, mask)).alias("value"))


@query(
    "points_in_polygon",
    """WITH e(x1, y1, x2, y2) AS (VALUES (-0.2, -0.15, 0.15, -0.2), (0.15, -0.2, 0.25, 0.1), (0.25, 0.1, 0.0, 0.0),
         (0.0, 0.0, -0.1, 0.25), (-0.1, 0.25, -0.2, -0.15)),
       p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py FROM embeddings)
       SELECT vec_id FROM p, e GROUP BY vec_id
       HAVING count(CASE WHEN (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * ((x2 - x1) / (y2 - y1)) THEN 1 END) % 2 = 1""",
)
def _(v: Views):
    lasso = [(-0.2, -0.15), (0.15, -0.2), (0.25, 0.1), (0.0, 0.0), (-0.1, 0.25)]
    e = v.table("embeddings").select(
        "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("px"), F.get("embedding", F.lit(1)).cast("double").alias("py")
    )
    return e.where(px.in_polygon("px", "py", lasso)).select("vec_id")


# --- masks --------------------------------------------------------------------------


@query(
    "mask_outline",
    """SELECT m.vec_id, m.y, m.x, m.label FROM fx_mask m
       LEFT JOIN fx_mask a ON a.vec_id = m.vec_id AND a.y = m.y - 1 AND a.x = m.x
       LEFT JOIN fx_mask b ON b.vec_id = m.vec_id AND b.y = m.y + 1 AND b.x = m.x
       LEFT JOIN fx_mask c ON c.vec_id = m.vec_id AND c.y = m.y AND c.x = m.x - 1
       LEFT JOIN fx_mask d ON d.vec_id = m.vec_id AND d.y = m.y AND d.x = m.x + 1
       WHERE coalesce(a.label, 0) <> m.label OR coalesce(b.label, 0) <> m.label OR coalesce(c.label, 0) <> m.label OR coalesce(d.label, 0) <> m.label""",
)
def _(v: Views):
    return cells.mask_outline(v.mask, IMG)


_GEOMETRY = """geo AS (SELECT vec_id, label, cy, cx, greatest(sy, 0) AS src_y0, least(sy + 4, 8) AS src_y1, greatest(sx, 0) AS src_x0,
    least(sx + 4, 8) AS src_x1, greatest(sy, 0) - sy AS dst_y0, greatest(sx, 0) - sx AS dst_x0 FROM (
      SELECT *, CAST(round_even(cy, 0) AS BIGINT) - 2 AS sy, CAST(round_even(cx, 0) AS BIGINT) - 2 AS sx FROM (
        SELECT vec_id, label, avg(y) AS cy, avg(x) AS cx FROM fx_mask GROUP BY 1, 2)))"""


def _geometry(v: Views, size=4):
    return cells.cell_geometry(v.mask, IMG, size, SIZE, SIZE)


@query(
    "cell_geometry",
    f"""WITH {_GEOMETRY} SELECT vec_id, label, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, src_y0, src_y1, src_x0, src_x1,
        dst_y0, dst_x0 FROM geo""",
)
def _(v: Views):
    return _geometry(v).withColumns({c: r6(c) for c in ("centroid_y", "centroid_x")})


@query(
    "crop_cells",
    f"""WITH {_GEOMETRY} SELECT p.vec_id, g.label, p.y - src_y0 + dst_y0 AS ty, p.x - src_x0 + dst_x0 AS tx, round(p.value, 6) + 0.0 AS value
       FROM geo g JOIN fx_pixels p ON p.vec_id = g.vec_id AND p.y >= src_y0 AND p.y < src_y1 AND p.x >= src_x0 AND p.x < src_x1""",
)
def _(v: Views):
    return cells.crop_cells(v.pixels, _geometry(v), IMG, block=4).withColumn("value", r6("value"))


@query(
    "crop_percentiles",
    f"""WITH {_GEOMETRY} SELECT p.vec_id, g.label, round(quantile_cont(p.value, 0.01), 6) + 0.0 AS lo, round(quantile_cont(p.value, 0.99), 6) + 0.0 AS hi
       FROM geo g JOIN fx_pixels p ON p.vec_id = g.vec_id AND p.y >= src_y0 AND p.y < src_y1 AND p.x >= src_x0 AND p.x < src_x1 GROUP BY 1, 2""",
)
def _(v: Views):
    crops = cells.crop_cells(v.pixels, _geometry(v), IMG, block=4)
    return contrast.crop_percentiles(crops, ["vec_id", "label"], 1.0, 99.0).withColumns({c: r6(c) for c in ("lo", "hi")})


@query(
    "field_percentiles",
    """SELECT class, round(quantile_cont(value, 0.001), 6) AS lo, round(quantile_cont(value, 0.999), 6) AS hi FROM fx_pixels GROUP BY 1""",
)
def _(v: Views):
    out = contrast.field_percentiles(v.pixels, ["class"], 0.1, 99.9)
    return out.select("class", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(
    "denoise_normalise",
    """WITH b AS (SELECT vec_id, quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM fx_pixels GROUP BY 1)
       SELECT vec_id, y, x, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) + 0.0 AS value FROM fx_pixels JOIN b USING (vec_id)""",
)
def _(v: Views):
    return contrast.normalise(v.pixels.select("vec_id", "y", "x", "value"), IMG).withColumn("value", r6("value"))


_LIMITS = """s AS (SELECT {key}, min(value) AS mn, max(value) AS mx, quantile_cont(abs(value), 0.9) AS ahi,
      quantile_cont(value, 0.05) FILTER (value > 0) AS plo, quantile_cont(value, 0.9) FILTER (value > 0) AS phi,
      quantile_cont(value, 0.05) AS alo, quantile_cont(value, 0.9) AS ahi2 FROM px GROUP BY 1),
    f AS (SELECT *, coalesce(plo, alo) AS lo, coalesce(phi, ahi2) AS hi FROM s)
    SELECT {key}, round(CASE WHEN mn < 0 AND mx > 0 THEN -ahi WHEN hi > lo THEN lo ELSE mn END, 6) + 0.0 AS vmin,
      round(CASE WHEN mn < 0 AND mx > 0 THEN ahi WHEN hi > lo THEN hi WHEN mx > mn THEN mx ELSE mn + 1 END, 6) + 0.0 AS vmax FROM f"""


def _limit_pixels(v: Views):
    """Signed, positive, binary and constant planes, by plane number."""
    m = F.col("vec_id") % 4
    value = (
        F.when(m == 0, F.col("value"))
        .when(m == 1, F.abs("value"))
        .when(m == 2, F.when(F.col("value") > 0, 1.0).otherwise(0.0))
        .otherwise(F.lit(7.0))
    )
    return v.pixels.select("vec_id", (F.col("fov") % 3).alias("grp"), value.alias("value"))


_LIMIT_PX = """px AS (SELECT vec_id, fov % 3 AS grp, CASE vec_id % 4 WHEN 0 THEN value WHEN 1 THEN abs(value)
    WHEN 2 THEN CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END ELSE 7.0 END AS value FROM fx_pixels)"""


@query("contrast_limits", f"WITH {_LIMIT_PX}, " + _LIMITS.format(key="vec_id"))
def _(v: Views):
    out = contrast.contrast_limits(_limit_pixels(v), IMG, 5.0, 90.0, integer=True)
    return out.select("vec_id", r6("vmin").alias("vmin"), r6("vmax").alias("vmax"))


@query("contrast_limits_field", f"WITH {_LIMIT_PX}, " + _LIMITS.format(key="grp"))
def _(v: Views):
    out = contrast.contrast_limits(_limit_pixels(v), ["grp"], 5.0, 90.0, integer=True, whole_fields=True)
    return out.select("grp", r6("vmin").alias("vmin"), r6("vmax").alias("vmax"))


@query(
    "channel_range",
    """SELECT class, round(min(value), 6) + 0.0 AS vmin, round(max(value), 6) + 0.0 AS vmax FROM fx_pixels GROUP BY 1""",
)
def _(v: Views):
    out = images.channel_range(v.planes, ["class"])
    return out.select("class", r6("vmin").alias("vmin"), r6("vmax").alias("vmax"))


@query(
    "mask_iou",
    """WITH m AS (SELECT vec_id // 2 AS pair, y, x, count(CASE WHEN vec_id % 2 = 0 THEN 1 END) AS a, count(CASE WHEN vec_id % 2 = 1 THEN 1 END) AS b FROM fx_mask GROUP BY 1, 2, 3)
       SELECT pair, count(CASE WHEN a > 0 AND b > 0 THEN 1 END) AS n_both, count(*) AS n_union, round(count(CASE WHEN a > 0 AND b > 0 THEN 1 END) / count(*), 6) AS iou FROM m GROUP BY 1""",
)
def _(v: Views):
    m = v.mask.select(F.floor(F.col("vec_id") / 2).alias("pair"), "vec_id", F.col("y").alias("ty"), F.col("x").alias("tx"))
    out = cells.mask_iou(m.where("vec_id % 2 = 0"), m.where("vec_id % 2 = 1"), ["pair"])
    return out.withColumn("iou", r6("iou"))


@query(
    "mask_iou_sizes",
    """WITH m AS (SELECT vec_id // 2 AS pair, y, x, vec_id % 2 AS side FROM fx_mask),
       c AS (SELECT pair, side, CASE side WHEN 0 THEN y - 4 ELSE y - 3 END AS y, CASE side WHEN 0 THEN x - 4 ELSE x - 3 END AS x FROM m
             WHERE side = 0 OR (y < 6 AND x < 6)),
       p AS (SELECT pair, y, x, count(CASE WHEN side = 0 THEN 1 END) AS a, count(CASE WHEN side = 1 THEN 1 END) AS b FROM c WHERE y BETWEEN -3 AND 2 AND x BETWEEN -3 AND 2 GROUP BY 1, 2, 3)
       SELECT pair, count(CASE WHEN a > 0 AND b > 0 THEN 1 END) AS n_both, count(*) AS n_union, round(count(CASE WHEN a > 0 AND b > 0 THEN 1 END) / count(*), 6) AS iou FROM p GROUP BY 1""",
)
def _(v: Views):
    m = v.mask.select(F.floor(F.col("vec_id") / 2).alias("pair"), "vec_id", F.col("y").alias("ty"), F.col("x").alias("tx"))
    small = m.where("vec_id % 2 = 1 and ty < 6 and tx < 6")
    return cells.mask_iou(m.where("vec_id % 2 = 0"), small, ["pair"], 8, 6).withColumn("iou", r6("iou"))


@query(
    "drop_edge_cells",
    """WITH b AS (SELECT vec_id, label, count(*) AS n_pixels FROM fx_quads GROUP BY 1, 2
           HAVING min(y) > 0 AND min(x) > 0 AND max(y) < 7 AND max(x) < 7)
       SELECT vec_id, label, n_pixels, row_number() OVER (PARTITION BY vec_id ORDER BY label) AS new_label FROM b""".replace(
        "fx_quads", "(SELECT vec_id, y, x, 1 + (y // 2) * 4 + (x // 2) AS label FROM fx_pixels WHERE value > 0.02)"
    ),
)
def _(v: Views):
    quads = v.pixels.where("value > 0.02").select(
        "vec_id", "y", "x", (1 + F.floor(F.col("y") / 2) * 4 + F.floor(F.col("x") / 2)).alias("label")
    )
    return cells.drop_edge_cells(quads, IMG, SIZE, SIZE)


# A re-export: the next plane's mask stands for the corrected one of the same field.
_OLD = """old AS (SELECT vec_id // 2 AS pair, label AS old_label, y, x FROM fx_mask WHERE vec_id % 2 = 0),
    newp AS (SELECT vec_id // 2 AS pair, CASE WHEN y >= 4 AND x >= 4 THEN 3 ELSE label + 10 END AS label, y, x FROM fx_mask WHERE vec_id % 2 = 1),
    c AS (SELECT pair, old_label, CAST(round_even(avg(y), 0) AS BIGINT) - 2 AS sy, CAST(round_even(avg(x), 0) AS BIGINT) - 2 AS sx, avg(y) AS cy, avg(x) AS cx
          FROM old GROUP BY 1, 2),
    om AS (SELECT pair, old_label, y - sy AS ty, x - sx AS tx FROM old JOIN c USING (pair, old_label)
           WHERE y - sy BETWEEN 0 AND 3 AND x - sx BETWEEN 0 AND 3),
    hits AS (SELECT c.pair, c.old_label, n.label, count(om.ty) AS inter, count(*) AS in_window FROM c
           JOIN newp n ON n.pair = c.pair AND n.y BETWEEN sy AND sy + 3 AND n.x BETWEEN sx AND sx + 3
           LEFT JOIN om ON om.pair = c.pair AND om.old_label = c.old_label AND om.ty = n.y - sy AND om.tx = n.x - sx GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY pair, old_label ORDER BY inter DESC, label) AS rn FROM hits WHERE inter > 0),
    n_old AS (SELECT pair, old_label, count(*) AS n FROM om GROUP BY 1, 2),
    matched AS (SELECT c.pair, c.old_label, b.inter / (n + b.in_window - b.inter) AS iou,
        CASE WHEN b.inter / (n + b.in_window - b.inter) >= 0.5 THEN b.label END AS new_label
        FROM c LEFT JOIN best b ON b.pair = c.pair AND b.old_label = c.old_label AND rn = 1
        LEFT JOIN n_old o ON o.pair = c.pair AND o.old_label = c.old_label)"""


def _reexport(v: Views):
    m = v.mask.withColumn("pair", F.floor(F.col("vec_id") / 2))
    old = m.where("vec_id % 2 = 0").select("pair", "label", "y", "x")
    corner = (F.col("y") >= 4) & (F.col("x") >= 4)
    new = m.where("vec_id % 2 = 1").select(
        "pair", F.when(corner, 3).otherwise(F.col("label") + 10).alias("label"), "y", "x"
    )
    geo = cells.cell_geometry(old, ["pair"], 4, SIZE, SIZE)
    crops = cells.crop_cells(old.withColumnRenamed("label", "own"), geo, ["pair"], 4, ("own",))
    masks = crops.where("own = label").select("pair", F.col("label").alias("old_label"), "ty", "tx")
    centres = geo.select("pair", F.col("label").alias("old_label"), "centroid_y", "centroid_x")
    return masks, centres, new


@query("match_cells", f"WITH {_OLD} SELECT pair, old_label, new_label, round(iou, 6) AS iou FROM matched")
def _(v: Views):
    masks, centres, new = _reexport(v)
    return cells.match_cells(masks, centres, new, ["pair"], 4).withColumn("iou", r6("iou"))


@query(
    "resolve_matches",
    f"""WITH {_OLD}, k AS (SELECT *, count(*) OVER (PARTITION BY pair, new_label) AS n FROM matched)
       SELECT pair, old_label, CASE WHEN new_label IS NOT NULL AND n = 1 THEN new_label END AS new_label FROM k""",
)
def _(v: Views):
    masks, centres, new = _reexport(v)
    return cells.resolve_matches(cells.match_cells(masks, centres, new, ["pair"], 4), ["pair"])


def _as_fov(df):
    return df.select(
        F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("pair").cast("string")).alias("fov_id"), *[c for c in df.columns if c != "pair"]
    )


@query(
    "carry_over_tags",
    f"""WITH {_OLD}, tg AS (SELECT 'p' AS project, concat('f', pair) AS fov_id, printf('f%d_cell%05d', pair, old_label) AS cell_id,
         CASE WHEN old_label % 2 = 0 THEN 'bud' ELSE 'two' END AS category, CAST(CASE WHEN old_label = 3 THEN 0.25 END AS DOUBLE) AS confidence, pair, old_label FROM c
         WHERE old_label < 4),
       r AS (SELECT pair, old_label, CASE WHEN new_label IS NOT NULL AND count(*) OVER (PARTITION BY pair, new_label) = 1 THEN new_label END AS new_label FROM matched WHERE old_label < 4),
       j AS (SELECT tg.*, r.new_label FROM tg JOIN r USING (pair, old_label))
       SELECT 'tag' AS kind, project, fov_id, printf('%s_cell%05d', fov_id, new_label) AS cell_id, category, confidence FROM j WHERE new_label IS NOT NULL
       UNION ALL SELECT 'moved', '', '', CAST(count(new_label) AS VARCHAR), '', NULL FROM j WHERE new_label IS DISTINCT FROM old_label
       UNION ALL SELECT 'dropped', '', '', CAST(count(*) - count(new_label) AS VARCHAR), '', NULL FROM j WHERE new_label IS DISTINCT FROM old_label""",
)
def _(v: Views):
    masks, centres, new = (_as_fov(d) for d in _reexport(v))
    from ..functions.names import cell_id_for

    tag_rows = centres.where("old_label < 4").select(
        "project",
        "fov_id",
        cell_id_for("fov_id", "old_label").alias("cell_id"),
        F.when(F.col("old_label") % 2 == 0, "bud").otherwise("two").alias("category"),
        F.when(F.col("old_label") == 3, 0.25).alias("confidence"),
    )
    moved, counts = export.carry_over_tags(tag_rows, masks, centres, new, 4)
    none = F.lit("")
    both = F.array(
        F.struct(F.lit("moved").alias("kind"), F.col("tags_moved").cast("string").alias("cell_id")),
        F.struct(F.lit("dropped").alias("kind"), F.col("tags_dropped").cast("string").alias("cell_id")),
    )
    tally = counts.select(F.explode(both).alias("t")).select(
        "t.kind", none.alias("project"), none.alias("fov_id"), "t.cell_id", none.alias("category"),
        F.lit(None).cast("double").alias("confidence"),
    )
    rows = moved.select(F.lit("tag").alias("kind"), "project", "fov_id", "cell_id", "category", "confidence")
    return rows.unionByName(tally)


# Same tiles under new labels, one in three blurred beyond recognition.
_CONTENT = """a AS (SELECT fov, z AS old_label, y, x, value FROM fx_pixels),
    b AS (SELECT fov, (z * 5 + 3) % 16 AS new_label, y, x, CASE WHEN z % 3 = 0 THEN value * (1 - 2 * ((y + x) % 2)) ELSE value * 1.5 + 0.001 * y END AS value,
          value > 0.02 AS m FROM fx_pixels),
    sa AS (SELECT fov, old_label, count(*) AS n FROM a WHERE value > 0.02 GROUP BY 1, 2),
    sb AS (SELECT fov, new_label, count(*) AS n FROM b WHERE m GROUP BY 1, 2),
    i AS (SELECT a.fov, a.old_label, b.new_label, count(*) AS n FROM a JOIN b ON a.fov = b.fov AND a.y = b.y AND a.x = b.x WHERE a.value > 0.02 AND b.m GROUP BY 1, 2, 3),
    o AS (SELECT i.fov, i.old_label, i.new_label, i.n / (sa.n + sb.n - i.n) AS iou FROM i JOIN sa USING (fov, old_label) JOIN sb USING (fov, new_label)),
    k AS (SELECT o.fov, o.old_label, o.new_label, o.iou, corr(a.value, b.value) AS c FROM o JOIN a USING (fov, old_label)
          JOIN b ON b.fov = o.fov AND b.new_label = o.new_label AND b.y = a.y AND b.x = a.x WHERE o.iou >= 0.5 GROUP BY 1, 2, 3, 4),
    w AS (SELECT *, row_number() OVER (PARTITION BY fov, old_label ORDER BY c DESC, new_label DESC) AS rn FROM k WHERE c >= 0.9)
    SELECT t.fov, t.old_label, w.new_label, round(w.c, 6) AS corr, round(w.iou, 6) AS iou FROM (SELECT DISTINCT fov, old_label FROM a) t
      LEFT JOIN w ON w.fov = t.fov AND w.old_label = t.old_label AND rn = 1"""


@query("match_cells_by_content", f"WITH {_CONTENT}")
def _(v: Views):
    p = v.pixels.withColumn("mask", F.when(F.col("value") > 0.02, 255).otherwise(0))
    at = [F.col("y").alias("ty"), F.col("x").alias("tx")]
    old = p.select("fov", F.col("z").alias("old_label"), *at, "value", "mask")
    flipped = F.col("value") * (1 - 2 * ((F.col("y") + F.col("x")) % 2))
    value = F.when(F.col("z") % 3 == 0, flipped).otherwise(F.col("value") * 1.5 + 0.001 * F.col("y"))
    new = p.select("fov", ((F.col("z") * 5 + 3) % 16).alias("new_label"), *at, value.alias("value"), "mask")
    # Tiles are a stored table.
    a = materialize(cells.tiles_as_arrays(old, ["fov", "old_label"], 8, 8), "old")
    b = materialize(cells.tiles_as_arrays(new, ["fov", "new_label"], 8, 8), "new")
    out = cells.match_cells_by_content(a, b, ["fov"], 8)
    return out.withColumns({c: r6(c) for c in ("corr", "iou")})


# --- planes -------------------------------------------------------------------------

_WEIGHT_SUM = 4 * (px.EDGE_WEIGHT + px.CORNER_WEIGHT)


@query(
    "donut_average",
    f"""WITH n AS (SELECT p.vec_id, p.y, p.x, CASE WHEN p.y + dy < 0 THEN -(p.y + dy) WHEN p.y + dy > 7 THEN 14 - p.y - dy ELSE p.y + dy END AS ny,
           CASE WHEN p.x + dx < 0 THEN -(p.x + dx) WHEN p.x + dx > 7 THEN 14 - p.x - dx ELSE p.x + dx END AS nx,
           CASE WHEN dy = 0 OR dx = 0 THEN exp(-0.5) ELSE exp(-1.0) END / {_WEIGHT_SUM!r} AS w
         FROM fx_pixels p, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) WHERE dy <> 0 OR dx <> 0)
       SELECT n.vec_id, n.y, n.x, round(sum(w * q.value), 6) + 0.0 AS value FROM n
       JOIN fx_pixels q ON q.vec_id = n.vec_id AND q.y = n.ny AND q.x = n.nx GROUP BY 1, 2, 3""",
)
def _(v: Views):
    return images.donut_average(v.planes, IMG).withColumn("value", r6("value"))


_VARIANCE = """vs AS (SELECT fov, z, ty // 3 AS tile_y, tx // 3 AS tile_x, var_pop(p.value) AS variance FROM fx_pixels p
    JOIN (SELECT unnest(range(9)) AS ty, CASE WHEN unnest(range(9)) < 8 THEN unnest(range(9)) ELSE 6 END AS sy) a ON p.y = a.sy
    JOIN (SELECT unnest(range(9)) AS tx, CASE WHEN unnest(range(9)) < 8 THEN unnest(range(9)) ELSE 6 END AS sx) b ON p.x = b.sx
    GROUP BY 1, 2, 3, 4)"""


@query("block_variance", f"WITH {_VARIANCE} SELECT fov, z, tile_y, tile_x, round(variance, 6) AS variance FROM vs")
def _(v: Views):
    return images.block_variance(v.planes, ["fov", "z"], 3, 3).withColumn("variance", r6("variance"))


# Strict peaks only: variances of continuous data have no plateaus.
_PEAKS = _VARIANCE + """,
    s AS (SELECT *, -variance AS h, lag(-variance) OVER w AS before, lead(-variance) OVER w AS after FROM vs
          WINDOW w AS (PARTITION BY fov, tile_y, tile_x ORDER BY z)),
    c AS (SELECT * FROM s WHERE h > before AND h > after),
    l AS (SELECT c.fov, c.tile_y, c.tile_x, c.z, max(q.z) FILTER (q.z < c.z) AS lz, min(q.z) FILTER (q.z > c.z) AS rz FROM c
          LEFT JOIN s q ON q.fov = c.fov AND q.tile_y = c.tile_y AND q.tile_x = c.tile_x AND q.h > c.h GROUP BY 1, 2, 3, 4),
    p AS (SELECT c.fov, c.tile_y, c.tile_x, c.z, c.h - greatest(min(q.h) FILTER (q.z <= c.z AND q.z > coalesce(lz, -1)),
            min(q.h) FILTER (q.z >= c.z AND q.z < coalesce(rz, 1000000))) AS prom FROM c JOIN l USING (fov, tile_y, tile_x, z)
          JOIN s q ON q.fov = c.fov AND q.tile_y = c.tile_y AND q.tile_x = c.tile_x GROUP BY c.fov, c.tile_y, c.tile_x, c.z, c.h),
    peaks AS (SELECT t.fov, t.tile_y, t.tile_x, coalesce(b.z, 0) AS z_index, coalesce(b.prom, 0) AS prominence
       FROM (SELECT DISTINCT fov, tile_y, tile_x FROM vs) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY fov, tile_y, tile_x
         ORDER BY prom DESC, z) AS rn FROM p WHERE prom >= 0.002) b ON b.fov = t.fov AND b.tile_y = t.tile_y AND b.tile_x = t.tile_x AND b.rn = 1)"""


def _peaks(v: Views):
    return images.focal_peaks(images.block_variance(v.planes, ["fov", "z"], 3, 3), ["fov"], 0.002)


@query("focal_peaks", f"WITH {_PEAKS} SELECT fov, tile_y, tile_x, z_index, round(prominence, 6) AS prominence FROM peaks")
def _(v: Views):
    return _peaks(v).withColumn("prominence", r6("prominence"))


@query("sum_project", "SELECT fov, y, x, round(sum(value), 6) + 0.0 AS value FROM fx_pixels GROUP BY 1, 2, 3")
def _(v: Views):
    return images.sum_project(v.planes, ["fov"]).select("fov", "y", "x", r6("value").alias("value"))


# Degree (1, 0) makes the surface a straight line in x, which SQL can fit; other degrees are tested against numpy.
_FIT = _PEAKS + """,
    pts AS (SELECT fov, CAST(z_index AS DOUBLE) AS z, 2.0 * ((tile_x * 3 + least(tile_x * 3 + 3, 8) - 1) / 2.0) / 7 - 1 AS x FROM peaks WHERE z_index > 0),
    fit AS (SELECT f.fov, n_points, CASE WHEN n_points >= 2 THEN regr_intercept(z, x) END AS c0, CASE WHEN n_points >= 2 THEN regr_slope(z, x) END AS c1
       FROM (SELECT fov, count(CASE WHEN z_index > 0 THEN 1 END) AS n_points FROM peaks GROUP BY 1) f LEFT JOIN pts USING (fov) GROUP BY f.fov, n_points)"""


def _fits(v: Views):
    sizes = v.planes.select("fov", "height", "width").distinct()
    return images.fit_focus_surface(_peaks(v), sizes, ["fov"], 3, 3, (1, 0))


@query("fit_focus_surface", f"WITH {_FIT} SELECT fov, n_points, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM fit")
def _(v: Views):
    return _fits(v).select(
        "fov", "n_points", r6(F.get("coefs", F.lit(0))).alias("c0"), r6(F.get("coefs", F.lit(1))).alias("c1")
    )


@query(
    "focus_surface",
    f"""WITH {_FIT} SELECT fov, y, x, round(c0 + c1 * (2.0 * x / 7 - 1), 6) + 0.0 AS z_surface FROM fit,
        (SELECT unnest(range(8)) AS y) a, (SELECT unnest(range(8)) AS x) b WHERE c0 IS NOT NULL""",
)
def _(v: Views):
    return images.eval_surface(_fits(v), ["fov"], (1, 0)).withColumn("z_surface", r6("z_surface"))


def _tilted(v: Views):
    """A known surface per field: a plane tilted differently in each."""
    f = v.planes.groupBy("fov").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    a = F.col("fov") % 5
    return f.select(
        "fov", "height", "width", F.array(4.0 + a, F.lit(1.5), 2.0 - a * 0.25, F.lit(0.5)).alias("coefs"), F.lit(None).cast("string").alias("error")
    )


_TILT = """nz AS (SELECT fov, count(*) AS n FROM fx_planes GROUP BY 1),
    zc AS (SELECT fov, n, y, x, least(greatest(4.0 + fov % 5 + 1.5 * (2.0 * y / 7 - 1) + (2.0 - (fov % 5) * 0.25) * (2.0 * x / 7 - 1)
        + 0.5 * (2.0 * x / 7 - 1) * (2.0 * y / 7 - 1) + 0.75, 0), n - 1) AS zc FROM nz, (SELECT unnest(range(8)) AS y) a, (SELECT unnest(range(8)) AS x) b)"""


@query(
    "focal_slice_linear",
    f"""WITH {_TILT} SELECT p.fov, p.y, p.x, round(sum(greatest(0, 1 - abs(zc - z)) * value), 6) + 0.0 AS value FROM fx_pixels p JOIN zc USING (fov, y, x) GROUP BY 1, 2, 3""",
)
def _(v: Views):
    out = images.focal_slice(v.planes, _tilted(v), ["fov"], (1, 1), 0.75, "linear", None)
    return out.withColumn("value", r6("value"))


# The spline's prefilter as an explicit recursion over the planes: causal and anti-causal passes with mirrored ends.
_POLE = repr(px._POLE)
_GAIN_ = repr((1 - px._POLE) * (1 - 1 / px._POLE))
_SPLINE = _TILT + f""",
    t AS (SELECT fov, n, zc, y, x, CAST(floor(zc + 0.5) AS BIGINT) + k AS tap, CASE k WHEN -1 THEN 0.5 * (0.5 - d) * (0.5 - d)
        WHEN 0 THEN 0.75 - d * d ELSE 0.5 * (0.5 + d) * (0.5 + d) END AS w FROM (SELECT *, zc - floor(zc + 0.5) AS d FROM zc), (VALUES (-1), (0), (1)) v(k)),
    m AS (SELECT fov, n, y, x, w, CASE WHEN tap < 0 THEN -tap WHEN tap > n - 1 THEN 2 * (n - 1) - tap ELSE tap END AS i FROM t),
    img AS (SELECT fov, y, x, z + 2 * (n - 1) * r AS pos, value FROM fx_pixels JOIN nz USING (fov), (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) q(r)
        UNION ALL SELECT fov, y, x, -z + 2 * (n - 1) * r, value FROM fx_pixels JOIN nz USING (fov), (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) q(r) WHERE z > 0 AND z < n - 1)
    SELECT m.fov, m.y, m.x, round(sum(w * {px._GAIN!r} * pow({_POLE}, abs(i - pos)) * value), 6) + 0.0 AS value
    FROM m JOIN img ON img.fov = m.fov AND img.y = m.y AND img.x = m.x GROUP BY 1, 2, 3"""


@query("focal_slice", f"WITH {_SPLINE}")
def _(v: Views):
    out = images.focal_slice(v.planes, _tilted(v), ["fov"], (1, 1), 0.75, "spline", None)
    return out.withColumn("value", r6("value"))


_REDUCE = (
    _FIT.replace("fx_pixels", "fx_counts").replace("prom >= 0.002", "prom >= 0.5")
    + ", "
    + _SPLINE.replace("fx_pixels", "fx_counts")
    .replace(_TILT[_TILT.index("zc AS"):], """zc AS (SELECT fov, n, y, x, least(greatest(c0 + c1 * (2.0 * x / 7 - 1) + 0.5, 0), n - 1) AS zc
        FROM nz JOIN fit USING (fov), (SELECT unnest(range(8)) AS y) a, (SELECT unnest(range(8)) AS x) b WHERE c0 IS NOT NULL)""")
    .replace("SELECT m.fov, m.y, m.x, round(", "SELECT m.fov, m.y, m.x, (SELECT n FROM nz WHERE nz.fov = m.fov) AS n_z, round(")
)
_REDUCE = _REDUCE[: _REDUCE.rindex("SELECT m.fov")] + f""", sharp AS (SELECT m.fov, m.y, m.x,
        sum(w * {px._GAIN!r} * pow({_POLE}, abs(i - pos)) * value) AS v FROM m JOIN img ON img.fov = m.fov AND img.y = m.y AND img.x = m.x GROUP BY 1, 2, 3),
    total AS (SELECT fov, y, x, sum(value) AS target, count(*) AS n_z FROM fx_counts GROUP BY 1, 2, 3)
    SELECT fov, y, x, CAST(least(greatest(floor(v + 0.5), 0), 65535) AS BIGINT) AS brightfield, target, n_z FROM sharp JOIN total USING (fov, y, x)"""


@query("reduce_fovs", f"WITH {_REDUCE}")
def _(v: Views):
    params = reduce.FlattenParams(3, 3, 0.5, (1, 0), 0.5, 1.0)
    reduced, _report = reduce.reduce_fovs(v.count_planes, v.count_planes, ["fov"], params)
    return reduced.select("fov", "y", "x", "brightfield", "target", "n_z")


@query(
    "run_report",
    f"""WITH {_PEAKS} SELECT 'reduce' AS stage, count(*) AS total, count(CASE WHEN n >= 4 THEN 1 END) AS done, count(CASE WHEN n < 4 THEN 1 END) AS failed FROM
        (SELECT fov, count(CASE WHEN z_index > 0 THEN 1 END) AS n FROM peaks GROUP BY 1)""",
)
def _(v: Views):
    from ..operators.lineage import run_report

    params = reduce.FlattenParams(3, 3, 0.002, (1, 1), 0.5, 1.0, None)
    fits = reduce.focus_diagnostics(v.planes, ["fov"], params)["fits"]
    rows = fits.select("fov", F.lit("reduce").alias("stage"), F.col("error").isNull().alias("success"), "error")
    return run_report(rows).drop("first_error")


@query(
    "dark_frame_statistics",
    """SELECT fov, round(avg(value), 6) AS "offset", round(var_samp(value), 6) AS read_variance FROM fx_counts GROUP BY 1""",
)
def _(v: Views):
    out = images.dark_frame_statistics(v.count_planes, ["fov"])
    return out.select("fov", r6("offset").alias("offset"), r6("read_variance").alias("read_variance"))


_BLOCKS = """d AS (SELECT vec_id, y, x, value, coalesce(lead(value) OVER (PARTITION BY vec_id, y ORDER BY x) - value, 0) AS dh,
      coalesce(lead(value) OVER (PARTITION BY vec_id, x ORDER BY y) - value, 0) AS dv FROM fx_counts),
    b AS (SELECT vec_id, y // 2 AS by_, x // 2 AS bx, avg(value) AS mean, 0.25 * (avg(dh * dh) + avg(dv * dv)) / 0.5 AS variance FROM d GROUP BY 1, 2, 3),
    e AS (SELECT vec_id, quantile_cont(mean, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM b GROUP BY 1),
    s AS (SELECT vec_id, i AS bin, count(*) AS n, quantile_disc(mean, 0.5) AS x, quantile_cont(variance, 0.2) AS y FROM b JOIN e USING (vec_id),
      (SELECT unnest(range(4)) AS i) r WHERE mean >= e[i + 1] AND mean <= e[i + 2] GROUP BY 1, 2 HAVING count(*) >= 4),
    f AS (SELECT vec_id, count(*) AS n_points, {slope} AS gain, CAST({off} AS DOUBLE) AS off, CAST({read} AS DOUBLE) AS rv, arg_min(y, bin) AS dark, {tot} AS ss FROM s GROUP BY 1),
    r AS (SELECT f.vec_id, sum(pow(s.y - (gain * (s.x - off) + rv), 2)) AS res FROM f JOIN s USING (vec_id) GROUP BY 1),
    q AS (SELECT *, CASE WHEN ss > 0 THEN 1 - res / ss ELSE 0 END AS r2 FROM f JOIN r USING (vec_id)),
    o AS (SELECT *, n_points >= 3 AS ok, gain BETWEEN 0.001 AND 10000 AND r2 >= 0.1 AS good FROM q)
    SELECT vec_id, n_points, round(CASE WHEN ok AND good THEN gain WHEN ok THEN 1 END, 6) AS gain,
      round(CASE WHEN ok AND good THEN off WHEN ok THEN {refused} END, 4) + 0.0 AS "offset",
      round(CASE WHEN ok AND good THEN rv WHEN ok THEN 0 END, 4) + 0.0 AS read_variance,
      round(CASE WHEN ok THEN dark END, 6) AS dark_variance,
      round(CASE WHEN ok AND good THEN least(greatest(r2, 0), 1) WHEN ok THEN 0 END, 6) AS r_squared FROM o"""


def _calibration(v: Views, **known):
    out = photon.photon_calibration(
        v.count_planes, IMG, photon.GainFit(side=2, bins=4, least_blocks=4, least_r2=0.1, bias=0.5), **known
    )
    four = {c: F.round(c, 4) for c in ("offset", "read_variance")}
    six = {c: r6(c) for c in ("gain", "dark_variance", "r_squared")}
    return out.withColumns({**four, **six}).select(
        "vec_id", "n_points", "gain", "offset", "read_variance", "dark_variance", "r_squared"
    )


@query(
    "photon_calibration",
    "WITH " + _BLOCKS.format(
        slope="regr_slope(y, x)", off="-regr_intercept(y, x) / nullif(regr_slope(y, x), 0)", read="0",
        tot="regr_syy(y, x)", refused="0",
    ),
)
def _(v: Views):
    return _calibration(v)


@query(
    "photon_calibration_offset",
    "WITH " + _BLOCKS.format(
        slope="regr_slope(y, x - 900)", off="900", read="greatest(regr_intercept(y, x - 900), 0)",
        tot="regr_syy(y, x)", refused="900",
    ),
)
def _(v: Views):
    return _calibration(v, offset=900.0)


@query(
    "photon_calibration_known",
    "WITH " + _BLOCKS.format(
        slope="sum((x - 900) * (y - 50)) / sum(pow(x - 900, 2))", off="900", read="50",
        tot="sum(pow(y - 50, 2))", refused="900",
    ),
)
def _(v: Views):
    return _calibration(v, offset=900.0, read_variance=50.0)


@query(
    "merge_denoised_channels",
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' WHEN vec_id % 2 = 0 THEN 'existing' ELSE 'source' END AS origin,
       round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN 3 WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END, 6) + 0.0 AS first FROM embeddings""",
)
def _(v: Views):
    src = v.planes.select("fov", F.col("vec_id").alias("channel"), "values")
    times = lambda k: F.transform("values", lambda x: x * k)
    old = src.where("channel % 2 = 0").withColumn("values", times(2))
    new = src.where("channel % 3 = 0").withColumn("values", times(3))
    out = images.merge_denoised_channels(src, old, new, ["fov", "channel"])
    return out.select(F.col("channel").alias("vec_id"), "origin", r6(F.get("values", F.lit(0))).alias("first"))


def _reduced(v: Views):
    """Even planes as brightfield, the next odd one as target; masks from the even ones."""
    p = v.pixels
    pair = F.floor(F.col("vec_id") / 2).alias("pair")
    wide = p.groupBy(pair, "y", "x").agg(
        F.max(F.when(F.col("vec_id") % 2 == 0, F.col("value"))).alias("brightfield"),
        F.max(F.when(F.col("vec_id") % 2 == 1, F.col("value"))).alias("target"),
    )
    mask = v.mask.where("vec_id % 2 = 0").select(pair, "y", "x", "label")
    return wide, mask


_TILES = """w AS (SELECT vec_id // 2 AS pair, y, x, max(CASE WHEN vec_id % 2 = 0 THEN value END) AS bf, max(CASE WHEN vec_id % 2 = 1 THEN value END) AS tg FROM fx_pixels GROUP BY 1, 2, 3),
    m AS (SELECT vec_id // 2 AS pair, y, x, label FROM fx_mask WHERE vec_id % 2 = 0),
    g AS (SELECT pair, label, avg(y) AS cy, avg(x) AS cx, CAST(round_even(avg(y), 0) AS BIGINT) - 2 AS sy, CAST(round_even(avg(x), 0) AS BIGINT) - 2 AS sx FROM m GROUP BY 1, 2),
    c AS (SELECT g.pair, g.label, w.y - sy AS ty, w.x - sx AS tx, bf, tg, CAST(CASE WHEN m.label = g.label THEN 255 ELSE 0 END AS BIGINT) AS mask FROM g
          JOIN w ON w.pair = g.pair AND w.y BETWEEN sy AND sy + 3 AND w.x BETWEEN sx AND sx + 3 LEFT JOIN m ON m.pair = w.pair AND m.y = w.y AND m.x = w.x),
    q AS (SELECT pair, label, quantile_cont(bf, 0.01) AS bl, quantile_cont(bf, 0.99) AS bh, quantile_cont(tg, 0.01) AS tl, quantile_cont(tg, 0.99) AS th FROM c GROUP BY 1, 2),
    tp AS (SELECT pair, label, ty, tx, CASE WHEN bh <= bl THEN 0 ELSE CAST(floor(least(greatest((bf - bl) / (bh - bl), 0), 1) * 255) AS BIGINT) END AS brightfield,
       CASE WHEN th <= tl THEN 0 ELSE CAST(floor(least(greatest((tg - tl) / (th - tl), 0), 1) * 255) AS BIGINT) END AS target, mask FROM c JOIN q USING (pair, label))"""


@query("tile_pixels", f"WITH {_TILES} SELECT * FROM tp")
def _(v: Views):
    wide, mask = _reduced(v)
    return export.tile_pixels(wide, mask, ["pair"], SIZE, SIZE, export.TileParams(4, 1.0, 99.0))


@query(
    "export_tiles",
    f"""WITH {_TILES}, grid AS (SELECT g.pair, g.label, g.cy, g.cx, ch, p FROM g, (SELECT unnest(range(3)) AS ch) a, (SELECT unnest(range(16)) AS p) b)
        SELECT grid.pair, printf('%d_cell%05d', grid.pair, grid.label) AS cell_id, grid.label, '3,4,4' AS shape, 'uint8' AS dtype,
          concat(printf('%.6f', cy), ',', printf('%.6f', cx)) AS centroid,
          string_agg(printf('%02X', coalesce(CASE ch WHEN 0 THEN brightfield WHEN 1 THEN target ELSE mask END, 0)), '' ORDER BY ch, p) AS pixels
        FROM grid LEFT JOIN tp ON tp.pair = grid.pair AND tp.label = grid.label AND tp.ty * 4 + tp.tx = grid.p GROUP BY grid.pair, grid.label, cy, cx""",
)
def _(v: Views):
    wide, mask = _reduced(v)
    tiles = export.export_tiles(wide, mask, ["pair"], SIZE, SIZE, "pair", export.TileParams(4, 1.0, 99.0))
    shown = F.transform("centroid", lambda c: F.format_string("%.6f", c))
    return tiles.select(
        "pair", "cell_id", "label", F.array_join("shape", ",").alias("shape"), "dtype",
        F.array_join(shown, ",").alias("centroid"), F.hex("pixels").alias("pixels"),
    )


@query(
    "unpack_tiles",
    f"""WITH {_TILES}, grid AS (SELECT g.pair, g.label, p // 4 AS ty, p % 4 AS tx FROM g, (SELECT unnest(range(16)) AS p) b)
        SELECT grid.pair, grid.label, grid.ty, grid.tx, coalesce(brightfield, 0) AS brightfield, coalesce(target, 0) AS target, coalesce(mask, 0) AS mask
        FROM grid LEFT JOIN tp ON tp.pair = grid.pair AND tp.label = grid.label AND tp.ty = grid.ty AND tp.tx = grid.tx""",
)
def _(v: Views):
    wide, mask = _reduced(v)
    tiles = export.export_tiles(wide, mask, ["pair"], SIZE, SIZE, "pair", export.TileParams(4, 1.0, 99.0))
    return export.unpack_tiles(tiles, ["pair", "label"])


@query(
    "encode_stored_tiles",
    f"""WITH {_TILES}, grid AS (SELECT g.pair, g.label, p // 4 AS ty, p % 4 AS tx FROM g, (SELECT unnest(range(16)) AS p) b),
        e AS (SELECT grid.pair, grid.label, (grid.ty // 2) * 2 + grid.tx // 2 AS b, avg(CASE WHEN mask > 0 THEN brightfield / 255.0 ELSE 0 END) AS m
          FROM grid LEFT JOIN tp ON tp.pair = grid.pair AND tp.label = grid.label AND tp.ty = grid.ty AND tp.tx = grid.tx GROUP BY 1, 2, 3)
        SELECT pair, label, string_agg(printf('%.5f', CAST(m AS FLOAT)), ',' ORDER BY b) AS embedding FROM e GROUP BY 1, 2""",
)
def _(v: Views):
    wide, mask = _reduced(v)
    tiles = export.export_tiles(wide, mask, ["pair"], SIZE, SIZE, "pair", export.TileParams(4, 1.0, 99.0))
    out = encode.encode_stored_tiles(tiles, encode.BlockMeans(2), ["pair", "label"], chunk=50)
    shown = F.transform("embedding", lambda m: F.format_string("%.5f", m))
    return out.select("pair", "label", F.array_join(shown, ",").alias("embedding"))


@query(
    "encode_tiles",
    """SELECT vec_id, string_agg(printf('%.6f', m), ',' ORDER BY b) AS embedding FROM (SELECT vec_id, (y // 2) * 4 + x // 2 AS b,
         CAST(avg(CASE WHEN value > 0.02 THEN (CAST(round_even(value * 200, 0) AS BIGINT) + 100) / 255.0 ELSE 0 END) AS FLOAT) AS m FROM fx_pixels GROUP BY 1, 2) GROUP BY 1""",
)
def _(v: Views):
    byte = F.rint(F.col("value") * 200).cast("int") + 100
    tp = v.pixels.select(
        "vec_id", F.col("y").alias("ty"), F.col("x").alias("tx"), byte.alias("value"), F.when(F.col("value") > 0.02, 255).otherwise(0).alias("mask")
    )
    out = cells.encode_tiles(tp, IMG, 8, 4)
    shown = F.transform("embedding", lambda m: F.format_string("%.6f", m))
    return out.select("vec_id", F.array_join(shown, ",").alias("embedding"))


# A first export, tags, then corrected masks; one field in seven has lost its mask and one in seven its image.
_AGAIN = f"""WITH {_OLD}, fld AS (SELECT DISTINCT vec_id // 2 AS pair FROM embeddings), ok AS (SELECT pair FROM fld WHERE pair % 7 NOT IN (4, 5)),
    tg AS (SELECT pair, old_label, CASE WHEN old_label % 2 = 0 THEN 'bud' ELSE 'two' END AS category, CAST(CASE WHEN old_label = 3 THEN 0.25 END AS DOUBLE) AS confidence FROM c WHERE old_label < 4),
    r AS (SELECT pair, old_label, CASE WHEN new_label IS NOT NULL AND count(*) OVER (PARTITION BY pair, new_label) = 1 THEN new_label END AS new_label FROM matched WHERE old_label < 4),
    j AS (SELECT tg.*, CASE WHEN ok.pair IS NULL THEN tg.old_label ELSE r.new_label END AS new_label FROM tg JOIN r USING (pair, old_label) LEFT JOIN ok USING (pair))"""


def _exported_again(v: Views):
    """The store after two exports, and the report of the second."""
    def named(df):
        return _as_fov(df)

    wide, first = _reduced(v)
    _masks, _centres, second = _reexport(v)
    image, first, second = materialize(named(wide), "image"), materialize(named(first), "first"), materialize(named(second), "second")
    fields = named(v.planes.select(F.floor(F.col("vec_id") / 2).alias("pair")).distinct())
    store = VersionedTables(v.spark, scratch_dir(v.spark, "store"))
    params = export.TileParams(4, 1.0, 99.0)
    reexport.reexport_fields(store, fields, fields, image, first, SIZE, SIZE, params)
    cells_now = store.read("tiles", reexport.STORED_TILES).where("label < 4")
    tag_rows = cells_now.select(
        "project", "fov_id", "cell_id", F.when(F.col("label") % 2 == 0, "bud").otherwise("two").alias("category"), F.when(F.col("label") == 3, 0.25).alias("confidence")
    )
    store.commit({"tags": tag_rows}, fields)
    seventh = F.substring("fov_id", 2, 20).cast("long") % 7
    report = reexport.reexport_fields(store, fields, fields.where(seventh != 5), image.where(seventh != 4), second, SIZE, SIZE, params)
    return store, report


@query(
    "reexport_fields",
    f"""{_AGAIN}, nc AS (SELECT pair, count(DISTINCT label) AS n FROM newp GROUP BY 1),
       mv AS (SELECT pair, count(new_label) AS moved, count(*) - count(new_label) AS dropped FROM j WHERE new_label IS DISTINCT FROM old_label GROUP BY 1)
       SELECT 'p' AS project, concat('f', pair) AS fov_id, ok.pair IS NOT NULL AS success, CASE pair % 7 WHEN 5 THEN 'no saved segmentation' WHEN 4 THEN 'no image' END AS error,
         CASE WHEN ok.pair IS NULL THEN 0 ELSE coalesce(n, 0) END AS n_cells, coalesce(moved, 0) AS tags_moved, coalesce(dropped, 0) AS tags_dropped
       FROM fld LEFT JOIN ok USING (pair) LEFT JOIN nc USING (pair) LEFT JOIN mv USING (pair)""",
)
def _(v: Views):
    return _exported_again(v)[1]


@query(
    "reexport_tags",
    f"""{_AGAIN} SELECT 'now' AS version, concat('f', pair) AS fov_id, printf('f%d_cell%05d', pair, new_label) AS cell_id, category, confidence FROM j WHERE new_label IS NOT NULL
       UNION ALL SELECT 'before', concat('f', pair), printf('f%d_cell%05d', pair, old_label), category, confidence FROM tg
       UNION ALL SELECT 'index', concat('f', pair), printf('f%d_cell%05d', pair, label), '', NULL FROM (SELECT DISTINCT pair, label FROM newp JOIN ok USING (pair)
         UNION ALL SELECT pair, old_label FROM c LEFT JOIN ok USING (pair) WHERE ok.pair IS NULL)""",
)
def _(v: Views):
    store, _report = _exported_again(v)
    columns = ["fov_id", "cell_id", "category", "confidence"]
    now, before = store.read("tags", TAGS), store.read("tags", TAGS, store.last_version() - 1)
    index = store.read("index", reexport.STORED_INDEX).select(F.lit("index").alias("version"), "fov_id", "cell_id", F.lit("").alias("category"), F.lit(None).cast("double").alias("confidence"))
    return now.select(F.lit("now").alias("version"), *columns).unionByName(before.select(F.lit("before").alias("version"), *columns)).unionByName(index)
