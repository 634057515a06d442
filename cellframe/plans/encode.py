"""Embeddings of stored tiles by any encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Encoder(Protocol):
    """What an encoder offers: loaded once per task, then called with tiles of one shape."""

    def load(self) -> Callable[[np.ndarray], np.ndarray]:
        """Returns a function from tiles (n, channels, height, width) to embeddings (n, dimensions)."""


class BlockMeans:
    """Means of a grid of blocks of one channel, in units of 255, with what lies outside the mask channel as 0."""

    def __init__(self, grid: int = 4, channel: int = 0, mask: int | None = 2):
        self.grid, self.channel, self.mask = grid, channel, mask

    def load(self):
        def encode(tiles: np.ndarray) -> np.ndarray:
            value = tiles[:, self.channel] / 255.0
            if self.mask is not None:
                value = np.where(tiles[:, self.mask] > 0, value, 0.0)
            side = -(-value.shape[-1] // self.grid)
            starts = np.arange(0, value.shape[-1], side)
            sums = np.add.reduceat(np.add.reduceat(value, starts, axis=1), starts, axis=2)
            n = np.diff(np.append(starts, value.shape[-1]))
            return (sums / np.outer(n, n)).reshape(len(tiles), -1)

        return encode


ENCODERS: dict[str, Callable[..., Encoder]] = {"block_means": BlockMeans}


def encode_stored_tiles(tiles: DataFrame, encoder: Encoder, keys: list[str], chunk: int = 256) -> DataFrame:
    """``(keys…, embedding)`` of tiles ``(keys…, shape, dtype, pixels)``; channel-last tiles of three channels are turned round.

    Tiles go to the encoder in runs of at most ``chunk`` of one shape and kind, as batches bring them. A tile without pixels has
    no embedding (null).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder.load()
        for pdf in batches:
            out = pd.Series([None] * len(pdf), dtype=object)
            kinds: dict[tuple, list[int]] = {}
            for i, (shape, dtype, pixels) in enumerate(zip(pdf["shape"], pdf["dtype"], pdf["pixels"])):
                if pixels is not None:
                    kinds.setdefault((tuple(shape), dtype), []).append(i)
            for (shape, dtype), rows in kinds.items():
                for start in range(0, len(rows), chunk):
                    part = rows[start : start + chunk]
                    stack = np.stack([np.frombuffer(pdf["pixels"].iloc[i], dtype=dtype).reshape(shape) for i in part])
                    if shape[-1] == 3 and len(shape) == 3:
                        stack = np.moveaxis(stack, -1, 1)
                    for i, vector in zip(part, encode(stack)):
                        out[i] = vector.astype(np.float32)
            yield pdf[keys].assign(embedding=out.to_numpy())

    schema = T.StructType([*[tiles.schema[k] for k in keys], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return tiles.select(*keys, "shape", "dtype", "pixels").mapInPandas(run, schema)
