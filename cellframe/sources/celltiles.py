"""Bulk import of packed tile containers as a Python data source.

A container is a magic line, the index length (8 bytes, little endian), a JSON
index, then one payload per cell at an offset behind the index, raw or zlib.

    spark.dataSource.register(CellTilesSource)
    spark.read.format("celltiles").load("/data/p1/05_tiles")
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import TILES

# Fixed value: the first bytes of a container.
MAGIC = b"YTLC1\n"


@dataclass
class Slice(InputPartition):
    """Part ``index`` of ``count`` of one file's payload bytes."""

    path: str
    index: int
    count: int


def _filesystem(path):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class CellTilesReader(DataSourceReader):
    """One task per container, several for a large one; each reads the index and its share of cells.

    Options: ``metadata_only`` leaves payloads unread (pixels NULL);
    ``slice_bytes`` is the most a task reads (64 MiB).
    """

    def __init__(self, options):
        self.path = options["path"]
        self.metadata_only = str(options.get("metadata_only", "false")).lower() == "true"
        self.slice_bytes = int(options.get("slice_bytes", 64 << 20))

    def partitions(self):
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            files = [info]
        else:
            files = [
                f
                for f in system.get_file_info(fs.FileSelector(root, recursive=True))
                if f.type == fs.FileType.File and f.base_name.endswith(".tiles") and not f.base_name.startswith(".")
            ]
        out = []
        for f in files:
            count = 1 if self.metadata_only else max(1, -(-f.size // self.slice_bytes))
            out.extend(Slice(f.path, i, count) for i in range(count))
        return out or [Slice("", 0, 1)]

    def read(self, part):
        import pyarrow as pa

        if not part.path:
            return
        system, _ = _filesystem(self.path)
        schema = pa.schema([
            ("container", pa.string()),
            ("cell_id", pa.string()),
            ("label", pa.int64()),
            ("shape", pa.list_(pa.int32())),
            ("dtype", pa.string()),
            ("centroid", pa.list_(pa.float64())),
            ("pixels", pa.binary()),
        ])
        with system.open_input_file(part.path) as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{part.path}: not a tile container (bad magic)")
            (length,) = struct.unpack("<Q", f.read(8))
            cells = json.loads(f.read(length))["cells"]
            start = f.tell()
            end = max((c["offset"] for c in cells), default=0) + 1
            width = -(-end // part.count)
            mine = [c for c in cells if c["offset"] // width == part.index]
            for at in range(0, len(mine), 1024):
                rows = []
                for c in mine[at : at + 1024]:
                    pixels = None
                    if not self.metadata_only:
                        f.seek(start + c["offset"])
                        pixels = f.read(c["nbytes"])
                        if c["codec"] == "zlib":
                            pixels = zlib.decompress(pixels)
                    rows.append({
                        "container": part.path,
                        "cell_id": c["cell_id"],
                        "label": c["label"],
                        "shape": c["shape"],
                        "dtype": c["dtype"],
                        "centroid": c.get("centroid"),
                        "pixels": pixels,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class CellTilesSource(DataSource):
    @classmethod
    def name(cls):
        return "celltiles"

    def schema(self):
        return TILES

    def reader(self, schema):
        return CellTilesReader(self.options)
