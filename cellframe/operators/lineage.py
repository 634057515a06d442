"""File manifests: which outputs are done, stale, archived or missing.

``files`` is ``(project, stage, stem, mtime, size)``, one row per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import BRIGHTFIELD_HINTS, TARGET_BAND_NM, TARGET_HINTS, channel_name_matches
from .skew import salted_join

# The folder names of the processing stages.
RAW, REDUCED, DENOISED, DECONVOLVED, TILES = "raw", "01_reduced", "02_denoised", "03_deconvolved", "05_tiles"
SEGMENTATION = "segmentation"
STAGES = [
    (0, RAW, False),
    (1, REDUCED, False),
    (2, DENOISED, True),
    (3, DECONVOLVED, True),
    (4, SEGMENTATION, False),
    (5, TILES, False),
]
DOWNSTREAM_FIRST = [DECONVOLVED, DENOISED, REDUCED]


def stage_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("project", "stage").agg(F.count(F.lit(1)).alias("n_files"))


def resolve_source_stage(
    files: DataFrame,
    candidates: list[str] = DOWNSTREAM_FIRST,
    overrides: DataFrame | None = None,
    out: str = "source_stage",
) -> DataFrame:
    """The most downstream non-empty stage of each project; an override counts only if non-empty.

    ``overrides`` is ``(project, override)``, NULL meaning automatic.
    """
    rank = F.coalesce(*[F.when(F.col("stage") == s, F.lit(i)) for i, s in enumerate(candidates)])
    filled = [F.max(F.col("stage") == s).alias(f"_has_{s}") for s in DOWNSTREAM_FIRST]
    found = files.groupBy("project").agg(F.min(rank).alias("_best"), *filled)
    auto = F.get(F.array(*[F.lit(s) for s in candidates]), F.col("_best"))
    if overrides is None:
        return found.select("project", auto.alias(out))
    joined = found.join(overrides.select("project", "override"), "project", "left")
    forced = F.coalesce(*[F.when((F.col("override") == s) & F.col(f"_has_{s}"), F.lit(s)) for s in DOWNSTREAM_FIRST])
    return joined.select("project", F.when(F.col("override").isNotNull(), forced).otherwise(auto).alias(out))


def producers(files: DataFrame, deconvolve_overrides: DataFrame | None = None) -> DataFrame:
    """(project, stage, upstream): which stage feeds each two-dimensional stage."""
    src = resolve_source_stage(files, [DENOISED, REDUCED], deconvolve_overrides, out="_deconv")
    return src.select(
        "project",
        F.explode(
            F.array(
                F.struct(F.lit(REDUCED).alias("stage"), F.lit(RAW).alias("upstream")),
                F.struct(F.lit(DENOISED).alias("stage"), F.lit(REDUCED).alias("upstream")),
                F.struct(F.lit(DECONVOLVED).alias("stage"), F.col("_deconv").alias("upstream")),
            )
        ).alias("_p"),
    ).select("project", "_p.stage", "_p.upstream")


def stage_file_status(files: DataFrame, deconvolve_overrides: DataFrame | None = None) -> DataFrame:
    """Freshness of each file of the two-dimensional stages against its upstream twin.

    Where no stem of a stage has a twin at all, the upstream has been archived
    and nothing there counts as stale.
    """
    feeds = producers(files, deconvolve_overrides)
    own = salted_join(
        files.where(F.col("stage").isin(REDUCED, DENOISED, DECONVOLVED)).select("project", "stage", "stem", "mtime"),
        feeds,
        ["project", "stage"],
        "left",
        salt_on=["stem"],
    )
    up = files.select("project", F.col("stage").alias("upstream"), "stem", F.col("mtime").alias("_up"))
    matched = own.join(up, ["project", "upstream", "stem"], "left")
    available = matched.groupBy("project", "stage").agg(
        (F.max(F.col("_up").isNotNull()) | F.max(F.col("upstream").isNull())).alias("upstream_available")
    )
    rows = salted_join(matched, available, ["project", "stage"], "left", salt_on=["stem"])
    # A stage without any upstream folder has nothing to be compared with.
    fresh = (
        F.when(F.col("upstream").isNull() | ~F.col("upstream_available"), F.lit(True))
        .when(F.col("_up").isNull(), F.lit(False))
        .otherwise(F.col("mtime") >= F.col("_up"))
    )
    return rows.select("project", "stage", "stem", "upstream", fresh.alias("up_to_date"), "upstream_available")


def segmentation_status(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Masks against the stage image they were computed from; a missing image means stale."""
    img = images.select("project", "stem", F.col("mtime").alias("_img"))
    fresh = F.coalesce(F.col("mtime") >= F.col("_img"), F.lit(False))
    return masks.join(img, ["project", "stem"], "left").select("project", "stem", fresh.alias("up_to_date"))


def fov_tile_status(containers: DataFrame, cell_counts: DataFrame, masks: DataFrame) -> DataFrame:
    """Tile containers against masks: cell count, freshness, and whether the project has masks at all.

    ``containers`` and ``masks`` are ``(project, fov_id, mtime)``; ``cell_counts`` ``(project, fov_id, n_cells)``.
    """
    have = masks.groupBy("project").agg(F.lit(True).alias("mask_available"))
    m = masks.select("project", "fov_id", F.col("mtime").alias("_mask"))
    rows = containers.join(m, ["project", "fov_id"], "left").join(cell_counts, ["project", "fov_id"], "left")
    rows = salted_join(rows, have, ["project"], "left", salt_on=["fov_id"])
    avail = F.coalesce("mask_available", F.lit(False))
    fresh = F.when(~avail, F.lit(True)).otherwise(F.coalesce(F.col("mtime") >= F.col("_mask"), F.lit(False)))
    return rows.select(
        "project",
        "fov_id",
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
        fresh.alias("up_to_date"),
        avail.alias("mask_available"),
    )


def pending_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """Files of one stage that the next has not produced yet."""
    done = files.where(F.col("stage") == target).select("project", "stem")
    return files.where(F.col("stage") == source).select("project", "stem").join(done, ["project", "stem"], "left_anti")


def stage_status(
    files: DataFrame, masks: DataFrame, overrides: DataFrame | None = None, deconvolve_overrides: DataFrame | None = None
) -> DataFrame:
    """Six ordered stages per project: empty, archived, stale or done, and which one is read from.

    ``masks`` is ``(project, …)`` with a row per mask file of the active stage.
    """
    stage_rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.lit(o).alias("optional"))
            for i, s, o in STAGES
        ]
    )
    grid = files.select("project").distinct().select("project", F.explode(stage_rows).alias("_s")).select(
        "project", "_s.*"
    )
    counts = stage_counts(files)
    fresh = stage_file_status(files, deconvolve_overrides).groupBy("project", "stage").agg(
        F.min("upstream_available").alias("_avail"), F.min("up_to_date").alias("_fresh")
    )
    masked = masks.groupBy("project").agg(F.count(F.lit(1)).alias("_n_masks"))
    active = resolve_source_stage(files, DOWNSTREAM_FIRST, overrides, out="_active")
    rows = (
        grid.join(counts, ["project", "stage"], "left")
        .join(fresh, ["project", "stage"], "left")
        .join(masked, "project", "left")
        .join(active, "project", "left")
    )
    present = F.coalesce("n_files", F.lit(0)) > 0
    status = (
        F.when(F.col("stage") == SEGMENTATION, F.when(F.col("_n_masks") > 0, "done").otherwise("empty"))
        .when(~present, "empty")
        .when(F.col("stage").isin(RAW, TILES), "done")
        .when(~F.col("_avail"), "archived")
        .when(F.col("_fresh"), "done")
        .otherwise("stale")
    )
    return rows.select(
        "project",
        "position",
        "stage",
        "optional",
        status.alias("status"),
        F.coalesce(F.col("stage") == F.col("_active"), F.lit(False)).alias("active"),
    )


def stage_inputs(
    files: DataFrame, overrides: DataFrame | None = None, deconvolve_overrides: DataFrame | None = None
) -> DataFrame:
    """(project, stage, input_stage): where each consuming stage reads from right now."""
    two_d = resolve_source_stage(files, DOWNSTREAM_FIRST, overrides, out="_2d")
    dec = resolve_source_stage(files, [DENOISED, REDUCED], deconvolve_overrides, out="_dec")
    pairs = F.array(
        F.struct(F.lit(DENOISED).alias("stage"), F.lit(REDUCED).alias("input_stage")),
        F.struct(F.lit(DECONVOLVED).alias("stage"), F.col("_dec").alias("input_stage")),
        F.struct(F.lit(SEGMENTATION).alias("stage"), F.col("_2d").alias("input_stage")),
        F.struct(F.lit(TILES).alias("stage"), F.col("_2d").alias("input_stage")),
    )
    return two_d.join(dec, "project").select("project", F.explode(pairs).alias("_p")).select("project", "_p.*")


def stage_consumers(inputs: DataFrame) -> DataFrame:
    """The inverse: which stages read from a stage (never more than the four consuming stages)."""
    return (
        inputs.where(F.col("input_stage").isNotNull())
        .groupBy("project", "input_stage")
        .agg(F.array_sort(F.collect_set("stage")).alias("consumers"))
    )


def stage_run_log(runs: DataFrame) -> DataFrame:
    """Per stage: last run and how many distinct stems were ever processed."""
    per_stem = stage_run_stems(runs)
    return per_stem.groupBy("project", "stage").agg(
        F.max("last_run").alias("last_run"), F.count(F.lit(1)).alias("n_stems")
    )


def stage_run_stems(runs: DataFrame) -> DataFrame:
    """The processed stems themselves, as rows rather than as one growing list."""
    return runs.groupBy("project", "stage", "stem").agg(F.max("mtime").alias("last_run"))


def merge_channels_done(done: DataFrame) -> DataFrame:
    """Union, per stem, of the channels that were ever denoised (there are two)."""
    return done.groupBy("project", "stem").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def run_report(results: DataFrame) -> DataFrame:
    """Totals of job outcomes ``(stage, success, error)``."""
    return results.groupBy("stage").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("done"),
        F.count_if(~F.col("success")).alias("failed"),
        F.min(F.when(~F.col("success"), F.col("error"))).alias("first_error"),
    )


def project_status(
    files: DataFrame,
    masks: DataFrame,
    channels_done: DataFrame,
    tile_status: DataFrame,
    overrides: DataFrame | None = None,
    deconvolve_overrides: DataFrame | None = None,
) -> DataFrame:
    """State of every file of every project: ``(project, stage, stem, state, seg_state)``."""
    produced = files.where(F.col("stage") == REDUCED).select("project", "stem", F.lit(True).alias("_done"))
    raw = (
        files.where(F.col("stage") == RAW)
        .select("project", "stage", "stem")
        .join(produced, ["project", "stem"], "left")
        .withColumn("state", F.when(F.col("_done"), "done").otherwise("unprocessed"))
    )
    flat = stage_file_status(files, deconvolve_overrides)
    n_channels = channels_done.select("project", "stem", F.size("channels").alias("_nch"))
    flat = flat.join(n_channels, ["project", "stem"], "left").withColumn(
        "state",
        F.when(~F.col("upstream_available"), "archived")
        .when(
            (F.col("stage") == DENOISED) & F.col("up_to_date"),
            F.when(F.col("_nch") == 1, "partial").otherwise("done"),
        )
        .when(F.col("up_to_date"), "done")
        .otherwise("stale"),
    )
    active = resolve_source_stage(files, DOWNSTREAM_FIRST, overrides, out="_active")
    images = salted_join(files, active, ["project"], "inner", salt_on=["stem"]).where(F.col("stage") == F.col("_active"))
    seg = segmentation_status(masks, images).select(
        "project", "stem", F.when(F.col("up_to_date"), "done").otherwise("stale").alias("seg_state")
    )
    seg = seg.join(images.select("project", "stem", "stage"), ["project", "stem"])
    cols = ["project", "stage", "stem", "state"]
    tiles = tile_status.select(
        "project",
        F.lit(TILES).alias("stage"),
        F.col("fov_id").alias("stem"),
        F.when(~F.col("mask_available"), "archived").when(F.col("up_to_date"), "done").otherwise("stale").alias("state"),
    )
    two_d = flat.select(*cols).join(seg, ["project", "stage", "stem"], "left")
    none = F.lit(None).cast("string").alias("seg_state")
    return (
        raw.select(*cols, none)
        .unionByName(two_d.select(*cols, "seg_state"))
        .unionByName(tiles.select(*cols, none))
    )


def infer_channels(channels: DataFrame, group: list[str]) -> DataFrame:
    """Best guess of the brightfield and target channel per file; NULL when unsure.

    ``channels`` is ``(group…, idx, name, emission)``.
    """
    nm = F.expr("try_cast(emission as double)")
    lo, hi = TARGET_BAND_NM
    idx = F.col("idx")

    def first(test: Column) -> Column:
        return F.min(F.when(test, idx))

    picked = channels.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        first(channel_name_matches("name", BRIGHTFIELD_HINTS)).alias("_bf"),
        F.coalesce(first(channel_name_matches("name", TARGET_HINTS)), first(nm.between(lo, hi))).alias("_target"),
    )
    sure = (F.col("_n") >= 2) & (F.col("_bf") != F.col("_target"))
    return picked.select(
        *group,
        F.when(sure, F.col("_bf")).alias("brightfield"),
        F.when(sure, F.col("_target")).alias("projection"),
    )
