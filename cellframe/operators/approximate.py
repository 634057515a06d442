"""Approximate neighbours by a tree of inverted lists over tables: work per query does not grow with the corpus.

Each cell of a level is split among its first ``fan`` rows by hash, its pivots. Corpus rows go to the nearest pivot, level
by level, until lists hold about ``list_rows``. Queries follow the ``probes`` nearest pivots of each level and look
exactly at the rows of the lists they end in. A query meets ``probes * fan`` pivots a level and ``probes`` lists.

Pivots and lists are tables joined by cell; nothing but the number of rows reaches the driver. Cells are read in blocks
of rows by hash, so a list that many equal vectors fill is spread over tasks, and every row of it is looked at.
Pivots are chosen by hash and ties go to the smaller number or id: the same tables give the same graph.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .embeddings import METRICS, _prepare, _top_k
from .skew import join_facts, mark_first_by_hash


def _pivot_distances(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distances by differences, so that equal pivots are equally far."""
    out = np.empty((len(q), len(p)))
    for j, row in enumerate(p):
        diff = q - row
        out[:, j] = np.abs(diff).sum(1) if metric == "manhattan" else np.sqrt((diff * diff).sum(1))
    return out


def _in_blocks(rows: DataFrame, sizes: DataFrame, block_rows: int, name: str) -> DataFrame:
    """Adds the block of a row: blocks of a cell hold about ``block_rows`` rows by hash."""
    blocks = sizes.select("cell", F.ceil(F.col("n") / block_rows).cast("long").alias("_blocks"))
    return join_facts(rows, blocks, ["cell"], salt_on=["id"]).withColumn(name, F.pmod(F.xxhash64("id"), F.col("_blocks"))).drop("_blocks")


def _repeated(rows: DataFrame, sizes: DataFrame, block_rows: int, name: str) -> DataFrame:
    """A copy of each row for every block of its cell in another table; none where that has no such cell."""
    blocks = sizes.select("cell", F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block_rows).cast("long") - 1).alias("_blocks"))
    return join_facts(rows, blocks, ["cell"], salt_on=["id"] if "id" in rows.columns else None).withColumn(name, F.explode("_blocks")).drop("_blocks")


def _counts(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")


def _pivots(corpus: DataFrame, fan: int) -> DataFrame:
    """The first ``fan`` rows of each cell by hash, in that order: ``(cell, pivots)``."""
    order = F.md5(F.col("id").cast("string"))
    first = mark_first_by_hash(corpus, ["cell"], order, lambda n: F.least(n, F.lit(fan)), "_pivot", digits=3).where("_pivot")
    listed = F.array_sort(F.collect_list(F.struct(order.alias("h"), "id", "embedding")))
    return materialize(first.groupBy("cell").agg(F.transform(listed, lambda s: s["embedding"]).alias("pivots")), "pivots")


def _step(rows: DataFrame, pivots: DataFrame, fan: int, keep: int, metric: str, block_rows: int) -> DataFrame:
    """Rows under the ``keep`` nearest pivots of their cell, as cells of the next level, with the distance."""
    sizes = _counts(rows)
    left = _in_blocks(rows, sizes, block_rows, "block")
    right = _repeated(pivots, sizes, block_rows, "block")
    schema = T.StructType([*rows.schema.fields, T.StructField("away", T.DoubleType())])
    names = rows.columns

    def nearest(part: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(split):
            return part[names].head(0).assign(away=pd.Series(dtype="float64"))
        p = _prepare(list(split["pivots"].iloc[0]), metric)
        d = _pivot_distances(_prepare(part["embedding"].tolist(), metric), p, metric)
        order = np.argsort(d, axis=1, kind="stable")[:, :keep]
        at = np.repeat(np.arange(len(part)), order.shape[1])
        out = part[names].iloc[at].reset_index(drop=True)
        out["cell"] = out["cell"].to_numpy() * fan + order.ravel()
        return out.assign(away=d[at, order.ravel()])

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(nearest, schema)


def knn_join_approx(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "euclidean",
    skip_self: bool = False,
    fan: int = 32,
    levels: int | None = None,
    probes: int = 16,
    list_rows: int = 1024,
    block_rows: int = 8192,
) -> DataFrame:
    """About the k nearest corpus rows of every query: ``(query_id, neighbor_id, label, distance, rank)``.

    Inputs are as in ``knn_join``, with unique ids. Distances are exact and so is the order; what may be missing are neighbours in
    lists that were not probed. By default the number of ``levels`` makes lists of about ``list_rows``; with none the result is exact. A
    query whose lists hold fewer than k rows gets fewer.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if min(fan, probes, list_rows, block_rows) < 1:
        raise ValueError("fan, probes, list_rows and block_rows are at least 1")
    if levels is None:
        levels = max(0, math.ceil(math.log(max(1, corpus.count() / list_rows)) / math.log(max(2, fan))))
    top = F.lit(0).cast("long").alias("cell")
    placed = corpus.select("id", "embedding", "label", top)
    routed = queries.select("id", "embedding", top)
    for _ in range(levels):
        pivots = _pivots(placed, fan)
        placed = materialize(_step(placed, pivots, fan, 1, metric, block_rows).drop("away"), "placed")
        steps = _step(routed, pivots, fan, probes, metric, block_rows)
        best = F.slice(F.array_sort(F.collect_list(F.struct("away", "cell"))), 1, probes)  # of at most probes * probes
        routed = steps.groupBy("id").agg(F.first("embedding").alias("embedding"), best.alias("_c"))
        routed = materialize(routed.select("id", "embedding", F.explode(F.transform("_c", lambda c: c["cell"])).alias("cell")), "routed")

    if not levels:  # both sides may be one table; as a table of its own the corpus has columns of its own
        placed = materialize(placed, "placed")
    lists, visits = _counts(placed), _counts(routed)
    keys = ["cell", "block", "chunk"]
    left = _in_blocks(_repeated(routed, lists, block_rows, "block"), visits, block_rows, "chunk")
    right = _in_blocks(_repeated(placed, visits, block_rows, "chunk"), lists, block_rows, "block")
    ids, labels = corpus.schema["id"].dataType, corpus.schema["label"].dataType
    schema = T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType), T.StructField("neighbor_id", ids), T.StructField("label", labels), T.StructField("distance", T.DoubleType()),
    ])

    def nearest(part: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(rows):
            return pd.DataFrame({"query_id": [], "neighbor_id": [], "label": [], "distance": []})
        q, t = _prepare(part["embedding"].tolist(), metric), _prepare(rows["embedding"].tolist(), metric)
        at, to, far = _top_k(q, part["id"].to_numpy(), t, rows["id"].to_numpy(), k, metric, skip_self)
        far = far * far / 2.0 if metric in ("cosine", "correlation") else far
        return pd.DataFrame({"query_id": part["id"].to_numpy()[at], "neighbor_id": rows["id"].to_numpy()[to], "label": rows["label"].to_numpy()[to], "distance": far})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_graph_approx(df: DataFrame, k: int, metric: str = "euclidean", **index) -> DataFrame:
    """Approximate neighbour graph of a table on itself; k is at least 2. ``index`` goes to ``knn_join_approx``."""
    corpus = df.select("id", "embedding", F.lit(None).cast("int").alias("label"))
    return knn_join_approx(df.select("id", "embedding"), corpus, max(2, k), metric, skip_self=True, **index).drop("label")
