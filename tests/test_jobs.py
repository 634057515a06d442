"""Jobs from the command line, and encoders of stored tiles."""

import os
import subprocess
import sys
import zipfile

import numpy as np

from cellframe import jobs
from cellframe.plans.encode import BlockMeans, encode_stored_tiles

FIELD = "project string, fov_id string"


def test_export_train_and_classify(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    rows = [("p", f, y, x, float(rng.normal()), float(rng.normal())) for f in "ab" for y in range(12) for x in range(12)]
    spark.createDataFrame(rows, FIELD + ", y int, x int, brightfield double, target double").write.parquet(str(tmp_path / "images"))
    cells = [("p", "a", y, x, 1) for y in (3, 4) for x in (3, 4)]
    spark.createDataFrame(cells, FIELD + ", y int, x int, label int").write.parquet(str(tmp_path / "masks"))
    folders = {"images", "masks", "store", "tiles", "tags", "models", "out"}

    def run(*words):
        return jobs.main([str(tmp_path / w) if w in folders else str(w) for w in words], spark)

    assert run("export", "images", "masks", "store", 12, 12) == 1  # b has no mask
    assert "no saved segmentation" in capsys.readouterr().out

    key = [("p", "f", f"c{i}") for i in range(20)]
    spark.createDataFrame([(*k, [float(i % 2), 1.0]) for i, k in enumerate(key)], FIELD + ", cell_id string, embedding array<double>").write.parquet(str(tmp_path / "tiles"))
    told = [(*k, "odd" if i % 2 else "even", None if i < 12 else 0.5) for i, k in enumerate(key)]
    spark.createDataFrame(told, FIELD + ", cell_id string, category string, confidence double").write.parquet(str(tmp_path / "tags"))
    assert run("train", "tiles", "tags", "models", "one") == 0
    assert run("classify", "tiles", "tags", "models", "one", "out") == 0
    got = {r.cell_id: r.category for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"c{i}": "odd" if i % 2 else "even" for i in range(20)}


def test_the_package_can_be_shipped(spark, tmp_path):
    """The zip alone is enough for a Python that knows no other copy."""
    archive = jobs.ship(spark, str(tmp_path))
    assert "cellframe/operators/strips.py" in zipfile.ZipFile(archive).namelist()
    code = "import cellframe.plans.encode as e; print(e.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": archive}, capture_output=True, text=True, timeout=100)
    assert archive in out.stdout


def test_encoders_see_tiles_of_one_shape(spark):
    rng = np.random.default_rng(2)
    first, last, odd = (rng.integers(0, 256, s).astype(np.uint8) for s in ((3, 8, 8), (8, 8, 3), (3, 5, 5)))
    rows = [(1, [3, 8, 8], "uint8", first.tobytes()), (2, [8, 8, 3], "uint8", last.tobytes()), (3, [3, 5, 5], "uint8", odd.tobytes()), (4, [3, 8, 8], "uint8", None)]
    tiles = spark.createDataFrame(rows, "id int, shape array<int>, dtype string, pixels binary").coalesce(1)
    got = {r.id: r.embedding for r in encode_stored_tiles(tiles, BlockMeans(2), ["id"]).collect()}
    assert got[4] is None
    for i, t in ((1, first), (2, np.moveaxis(last, -1, 0)), (3, odd)):
        v = np.where(t[2] > 0, t[0] / 255.0, 0)
        n = -(-v.shape[0] // 2)
        assert np.allclose(got[i], [v[:n, :n].mean(), v[:n, n:].mean(), v[n:, :n].mean(), v[n:, n:].mean()])
