"""Jobs from the command line, on the session the cluster gives: ``spark-submit … -m`` or the ``cellframe`` script.

Executors need the package too: hand over a wheel, or a zip of it (``cellframe.jobs.ship``), with the session.
"""

from __future__ import annotations

import argparse
import os
import shutil

from pyspark.sql import DataFrame, SparkSession

from .operators.lineage import run_report
from .plans.classify import classify_pool
from .plans.models import load_predictor, train_probe_job
from .plans.reduce import FlattenParams, reduce_fovs
from .plans.reexport import reexport_fields
from .plans.export import TileParams
from .session import scratch_dir
from .sources.versions import VersionedTables

FOV = ["project", "fov_id"]


def ship(spark: SparkSession, folder: str) -> str:
    """A zip of the package in ``folder``, given to this session's executors: Python workers then find it anywhere."""
    source = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(folder, "cellframe-package"), "zip", source, "cellframe")
    spark.sparkContext.addPyFile(archive)
    return archive


def reduce(spark: SparkSession, brightfield: str, target: str, out: str, params: FlattenParams = FlattenParams()) -> DataFrame:
    """Stacks to flat images under ``out``/images; an outcome per field under ``out``/report."""
    pixels, report = reduce_fovs(spark.read.parquet(brightfield), spark.read.parquet(target), FOV, params)
    pixels.write.mode("overwrite").parquet(f"{out}/images")
    report.write.mode("overwrite").parquet(f"{out}/report")
    return run_report(spark.read.parquet(f"{out}/report"))


def export(spark: SparkSession, images: str, masks: str, store: str, height: int, width: int, size: int = 64) -> DataFrame:
    """Tiles of all fields that have an image or a mask, into a versioned store."""
    reduced, labels = spark.read.parquet(images), spark.read.parquet(masks)
    segmented = labels.select(*FOV).distinct()
    fields = reduced.select(*FOV).union(segmented).distinct()
    return reexport_fields(VersionedTables(spark, store), fields, segmented, reduced, labels, height, width, TileParams(size))


def train(spark: SparkSession, tiles: str, tags: str, models: str, name: str) -> DataFrame:
    """A linear probe on the confirmed tiles, recorded as model ``name``."""
    return train_probe_job(spark.read.parquet(tiles), spark.read.parquet(tags), models, name)


def classify(spark: SparkSession, tiles: str, tags: str, models: str, name: str, out: str) -> DataFrame:
    """Tags of the whole pool by a recorded model, written to ``out``; human tags stay."""
    new_tags, report = classify_pool(spark.read.parquet(tiles), spark.read.parquet(tags), load_predictor(spark, models, name))
    new_tags.write.mode("overwrite").parquet(out)
    return report


JOBS = {"reduce": reduce, "export": export, "train": train, "classify": classify}
ARGUMENTS = {
    "reduce": ["brightfield", "target", "out"], "export": ["images", "masks", "store", "height", "width"],
    "train": ["tiles", "tags", "models", "name"], "classify": ["tiles", "tags", "models", "name", "out"],
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one job and prints its report; 1 if a field failed, as far as the job reports fields."""
    parser = argparse.ArgumentParser(prog="cellframe")
    commands = parser.add_subparsers(dest="job", required=True)
    for job, names in ARGUMENTS.items():
        command = commands.add_parser(job, help=JOBS[job].__doc__)
        for name in names:
            command.add_argument(name, type=int if name in ("height", "width") else str)
    given = vars(parser.parse_args(argv))
    job = given.pop("job")
    spark = spark or SparkSession.builder.appName(f"cellframe {job}").getOrCreate()
    report = JOBS[job](spark, **given)
    stored = scratch_dir(spark, "report")
    report.write.parquet(stored)
    report = spark.read.parquet(stored)
    report.show(50, truncate=False)
    failed = report.where("NOT success") if "success" in report.columns else report.where("failed > 0") if "failed" in report.columns else report.limit(0)
    return 1 if failed.limit(1).count() else 0


if __name__ == "__main__":
    raise SystemExit(main())
