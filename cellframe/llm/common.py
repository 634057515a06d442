"""What the operators share: reading tables, stored intermediate results, text buffers, components of a link graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_dir

WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a frame that several consumers read, compressed, to the shared scratch folder."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column, n: int):
    """crc32 of a whole number written as text, modulo n: splits labelled rows from held-out ones."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def in_fold(column, n: int, k: int):
    """Whether an id falls into fold k of n; a null id falls into none."""
    return F.coalesce(crc_mod(column, n) == k, F.lit(False))


NO_ID = -(1 << 63)


def ids_of(batch: pa.RecordBatch, start: int, n: int, column: str = "doc_id") -> np.ndarray:
    """Ids as numbers; a null id is NO_ID."""
    return pc.fill_null(batch.column(column).slice(start, n), pa.scalar(NO_ID, pa.int64())).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def runs(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """Slices of a batch's values as (first row, values), each of about ``limit`` characters; one row at least."""
    values = batch.column(column)
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, values.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, values.slice(start).to_pylist()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A ``mapInArrow`` function from one that turns a batch into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return run


def sample_rows(df: DataFrame, limit: int, key: str) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of ``key``; for fitting only, never for results."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(17)), key).limit(limit)


def join_counted(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, a stored table of one row per key; ``count`` says how many rows have the key.

    Keys of more than a thousandth of all rows are fewer than a thousand, so these are broadcast, and no key of the shuffle
    join is large. Rows without a fact go.
    """
    total = facts.agg(F.sum(count)).head()[0] or 0
    large = F.col(count) * 1000 > total
    hot = F.broadcast(facts.where(large))
    cold = rows.join(F.broadcast(facts.where(large).select(key)), key, "left_anti").join(facts.where(~large), key)
    return rows.join(hot, key).unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: ``(id, component)`` for every node that has a link, component = smallest id in it.

    Each round gives a node the smallest of itself and its neighbours, follows these to where they end, in steps that double,
    and draws every tree so found together: the links that remain lead from one tree to another, and a round sees each of
    them once. A node that ends a tree has all its neighbours in it or lies beside a smaller end, so at most half remain
    after two rounds. Only flags reach the driver.
    """
    rest = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    trees = None
    for _ in range(max_rounds):
        ends = stored(rest.select("u", F.col("u").alias("label")).unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("label"))).groupBy("u").agg(F.least("u", F.min("label")).alias("label")), "labels")
        for _ in range(max_rounds):
            further = ends.select(F.col("u").alias("label"), F.col("label").alias("further"))
            step = stored(ends.join(further, "label").select("u", F.col("further").alias("label"), (F.col("further") < F.col("label")).alias("moved")), "labels")
            ends = step.select("u", "label")
            if step.where("moved").isEmpty():
                break
        else:
            raise RuntimeError("components did not settle")
        if trees is None:
            trees = ends
        else:
            moved = ends.select(F.col("u").alias("label"), F.col("label").alias("further"))
            trees = stored(trees.join(moved, "label", "left").select("u", F.coalesce("further", "label").alias("label")), "trees")
        drawn = rest.join(ends, "u").select(F.col("label").alias("a"), "v").join(ends.select(F.col("u").alias("v"), F.col("label").alias("b")), "v")
        rest = stored(drawn.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        if rest.isEmpty():
            return trees.select(F.col("u").alias("id"), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, split at space and 0x09-0x0D: what bytes.lower and bytes.split do."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a fixed bijection with good diffusion)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


__all__ = ["table", "stored", "materialize", "crc_mod", "in_fold", "ids_of", "id_array", "NO_ID", "runs", "per_batch", "sample_rows", "join_counted", "components", "ascii_words", "mix64", "WORD_SEPARATORS"]
