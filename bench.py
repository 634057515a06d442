"""Time the headline queries on one JVM; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "results_table",
    "pool_summary",
    "annotation_stats",
    "class_share",
    "apply_human_tags",
    "apply_predictions",
    "remap_tags",
    "upsert_tile_index",
    "fold_tag_events",
    "inference_report",
    "training_provenance",
    "select_epoch_ssl_cancelled",
    "stage_file_status",
    "project_status",
    "block_variance",
    "focal_peaks",
    "focal_slice",
    "reduce_fovs",
    "sum_project",
    "donut_average",
    "field_percentiles",
    "crop_cells",
    "export_tiles",
    "match_cells",
    "match_cells_by_content",
    "carry_over_tags",
    "photon_calibration",
    "stratified_split",
    "knn_accuracy",
    "knn_graph",
    "embedding_health",
    "classify_pool",
    "encode_tiles",
]


def main() -> None:
    from cellframe.registry import REGISTRY
    from cellframe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cores, app="bench")
    REGISTRY["fov_tally"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
