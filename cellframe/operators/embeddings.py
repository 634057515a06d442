"""Embedding tables: neighbours, votes, collapse diagnostics, and the label join for plots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import literal_table, materialize

METRICS = ("euclidean", "cosine", "correlation", "manhattan")


def _prepare(vectors, metric: str) -> np.ndarray:
    """Bring vectors to a space where the metric is a plain norm distance."""
    if isinstance(vectors, np.ndarray):
        a = vectors
    else:
        a = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))
    if metric == "correlation":
        a = a - a.mean(axis=1, keepdims=True)
    if metric in ("cosine", "correlation"):
        norms = np.linalg.norm(a, axis=1, keepdims=True)
        a = a / np.where(norms == 0, 1.0, norms)
    return a


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column as rows of doubles; they must be there and of one length."""
    sizes = pc.list_value_length(column)
    ends = pc.min_max(sizes).as_py()
    if sizes.null_count or ends["min"] != ends["max"]:
        raise ValueError("vectors must not be null and must have one length")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), ends["min"] or 0)


def _id_values(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids that can be compared and ordered, null ids last, and which are there."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        return pc.fill_null(column.cast(pa.int64()), (1 << 63) - 1).to_numpy(zero_copy_only=False), known
    return column.to_numpy(zero_copy_only=False), known


def _norm_distances(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(t - row).sum(axis=1) for row in q]) if len(q) else np.empty((0, len(t)))
    sq = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2.0 * (q @ t.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _distinct(t: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of a query: of equal vectors those of the k + 1 smallest ids, k of an id."""
    if not t.size:
        return np.arange(len(t))
    raw = np.ascontiguousarray(t).view(np.dtype((np.void, t.itemsize * t.shape[1]))).ravel()
    every, group = np.unique(raw, return_inverse=True)
    if len(every) == len(t):
        return np.arange(len(t))
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    run = new | np.concatenate([[True], i[1:] != i[:-1]])
    at = np.arange(len(g))
    number = np.cumsum(run)
    among = number - number[np.maximum.accumulate(np.where(new, at, 0))]
    within = at - np.maximum.accumulate(np.where(run, at, 0))
    return np.sort(order[(among <= k) & (within < k)])


class _NormTiles:
    """Which rows of a tile may lie within a limit of each query, by one matrix product."""

    rows, cols = 256, 4096

    def __init__(self, q: np.ndarray, t: np.ndarray):
        self.q, self.t, self.q2, self.t2 = q, t, (q * q).sum(1), (t * t).sum(1)

    def near(self, a: slice, b: slice, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t2 = self.t2[b]
        sq = self.q[a] @ self.t[b].T
        sq *= -2.0
        sq += t2
        # wide enough for the rounding of the product
        edge = limit * limit - self.q2[a] + 1e-11 * (self.q2[a] + t2.max(initial=0.0))
        return np.nonzero(sq <= edge[:, None])


class _AbsoluteTiles:
    """The same for sums of absolute differences, by a lower bound: coordinates are cut and rounded down to 16-bit levels,
    which makes no difference larger than it is by more than one level."""

    rows, cols = 16, 4096

    def __init__(self, q: np.ndarray, t: np.ndarray):
        self.dim = t.shape[1]
        self.usable = 0 < self.dim <= 4096
        if self.usable:
            finite = t[np.isfinite(t)]
            low, high = np.quantile(finite, (0.001, 0.999)) if len(finite) else (0.0, 1.0)
            levels = 32000 // self.dim
            self.step = max((high - low) / levels, 1e-300)
            cut = lambda x: np.floor((np.clip(np.nan_to_num(x), low, high) - low) / self.step).clip(0, levels).astype(np.int16)
            self.q, self.t = cut(q), np.ascontiguousarray(cut(t).T)

    def near(self, a: slice, b: slice, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(limit), b.stop - b.start
        if not self.usable:
            return np.nonzero(np.ones((m, n), bool))
        total, part, q = np.zeros((m, n), np.int16), np.empty((m, n), np.int16), self.q[a]
        for j in range(self.dim):
            np.subtract(q[:, j, None], self.t[j, b], out=part)
            np.abs(part, out=part)
            np.add(total, part, out=total)
        edge = np.floor(np.minimum(np.nan_to_num(limit, nan=-np.inf, posinf=np.inf) * (1 + 1e-9) / self.step + self.dim + 1, 32767)).astype(np.float64)
        return np.nonzero(total <= np.maximum(edge, -1)[:, None].astype(np.int16))


def _top_k(q, q_ids, t, t_ids, k, metric, skip_self, limit=None, q_known=True):
    """Indices and exact distances of each query's nearest rows, ties by id.

    ``limit`` is a distance within which k rows are known to lie. Tiles of both sides are compared in turn; only rows that
    may lie within the distance of the k nearest so far are looked at exactly, 65,536 pairs at a time.
    """
    used = _distinct(t, t_ids, k)
    t, t_ids = t[used], t_ids[used]
    tiles = (_AbsoluteTiles if metric == "manhattan" else _NormTiles)(q, t)
    limit = np.full(len(q), np.inf) if limit is None else limit.astype(np.float64)
    known = np.broadcast_to(q_known, len(q))
    cuts = [0, *range(min(64 + k, len(t)), len(t), tiles.cols), len(t)]  # a short tile first, which gives limits
    out = []
    for start in range(0, len(q), tiles.rows):
        a = slice(start, min(start + tiles.rows, len(q)))
        m = a.stop - start
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        edge = limit[a].copy()
        for lo, hi in zip(cuts, cuts[1:]):
            rows, cols = tiles.near(a, slice(lo, hi), edge)
            for i in range(0, len(rows), 65536):
                r, c = rows[i : i + 65536], cols[i : i + 65536] + lo
                diff = q[r + start] - t[c]
                exact = np.abs(diff).sum(1) if metric == "manhattan" else np.sqrt((diff * diff).sum(1))
                keep = np.isfinite(exact) & (exact <= edge[r])
                if skip_self:
                    keep &= (q_ids[r + start] != t_ids[c]) | ~known[r + start]
                if not keep.any():
                    continue
                r, c, exact = (np.concatenate([x, y[keep]]) for x, y in zip(best, (r, c, exact)))
                order = np.lexsort((t_ids[c], exact, r))
                r, c, exact = r[order], c[order], exact[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                best = tuple(x[place < k] for x in (r, c, exact))
                full = place == k - 1
                edge[r[full]] = np.minimum(edge[r[full]], exact[full])
        out.append((best[0] + start, used[best[1]], best[2]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


#: Numbers in a block of vectors, and pairs of a query and a part of the corpus that leave a task's routing at once.
BLOCK_NUMBERS, ROUTED = 1 << 22, 4096


def _block_rows(n: int, dim: int) -> int:
    """Blocks of at most 32 MB of doubles, and several even of a small table, so that cores share them."""
    return max(256, min(BLOCK_NUMBERS // max(dim, 1), max(2048, -(-n // 8))))


def _chain(pivots: np.ndarray, metric: str) -> np.ndarray:
    """Pivots in an order where neighbours are close: always on to the nearest that is left."""
    d = np.nan_to_num(_norm_distances(pivots, pivots, metric), nan=np.inf, posinf=1e300)
    left, order = np.ones(len(d), bool), [0]
    left[0] = False
    while len(order) < len(d):
        order.append(int(np.where(left, d[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order)


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "euclidean",
    skip_self: bool = False,
    n_pivots: int | None = None,
    block_rows: int | None = None,
    n_queries: int | None = None,
    n_corpus: int | None = None,
) -> DataFrame:
    """Exact k nearest corpus rows of every query: (query_id, neighbor_id, label, distance, rank).

    ``queries`` is ``(id, embedding)``, ``corpus`` ``(id, embedding, label)``.

    The corpus is cut into cells around a few pivots, each known by its size
    and radius; neighbouring small cells form one part. The pivots and some more
    rows of the corpus tell a distance within which a query has k rows; by the
    triangle inequality it only needs the parts with a cell that reaches into
    it, and is sent once to each of those. Parts larger than ``block_rows`` are
    split by hash, queries likewise, so a task holds two blocks of at most
    about that size (by default 32 MB of numbers) and returns k rows per query, never the pairs. Where
    vectors do not cluster, every block meets every query: their number grows
    with the square of the rows over that of a block. Pivots and
    cell sizes are the only things on the driver (``n_pivots`` rows; by default
    their number grows with the root of the corpus, from 16 to 1024).
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if n_queries is None:
        n_queries = queries.count()
    if n_corpus is None:
        n_corpus = corpus.count()
    if n_pivots is None:
        n_pivots = min(1024, max(16, math.isqrt(n_corpus) // 8))
    id_type = corpus.schema["id"].dataType
    label_type = corpus.schema["label"].dataType
    seeds = corpus.select("id", "embedding").orderBy(F.md5(F.col("id").cast("string")), "id").limit(max(n_pivots, 8 * k, 64)).collect()
    if not seeds:
        raise ValueError("the corpus is empty")
    marks = _prepare([r["embedding"] for r in seeds], metric)
    pivots = marks[:n_pivots]
    mark_ids = np.array([r["id"] for r in seeds], dtype=object)
    size = lambda n: block_rows or _block_rows(n, marks.shape[1])
    corpus_rows, query_rows = size(n_corpus), size(n_queries)

    def assign(columns):
        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    d = _norm_distances(_prepare(_matrix(part.column("embedding")), metric), pivots, metric)
                    d = np.where(np.isnan(d), np.inf, d)
                    cell = d.argmin(axis=1)
                    made = {"cell": pa.array(cell.astype("int32")), "pivot_d": pa.array(d[np.arange(len(d)), cell])}
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in columns], names=columns)

        return run

    stats = corpus.select("embedding").mapInArrow(assign(["cell", "pivot_d"]), "cell int, pivot_d double")
    stats = stats.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("pivot_d").alias("r")).collect()
    found = {r["cell"]: r for r in stats}
    cells = np.array([c for c in _chain(pivots, metric).tolist() if c in found])
    sizes = np.array([found[c]["n"] for c in cells])
    radii = np.array([found[c]["r"] for c in cells])
    part, held = [], 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if i and held > corpus_rows:
            part.append(part[-1] + 1)
            held = n
        else:
            part.append(part[-1] if i else 0)
    part = np.array(part)
    firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    blocks = np.maximum(1, -(-np.add.reduceat(sizes, firsts) // corpus_rows)).astype("int64")
    part_of = np.zeros(len(pivots), np.int32)
    part_of[cells] = part

    def visits(batch):
        """Which parts each query has to see, and a distance within which it has k rows."""
        d = _norm_distances(_prepare(_matrix(batch.column("embedding")), metric), marks, metric)
        d = np.where(np.isnan(d), np.inf, d)
        others = d
        if skip_self:
            ids = np.array(batch.column("id").to_pylist(), dtype=object)
            others = np.where((ids[:, None] == mark_ids[None, :]) & (ids != None)[:, None], np.inf, d)  # noqa: E711
        reach = np.partition(others, k - 1, axis=1)[:, k - 1] if others.shape[1] >= k else np.full(len(d), np.inf)
        near = np.where(np.isfinite(d).any(axis=1), d.max(axis=1, where=np.isfinite(d), initial=0.0), 0.0)
        reach = reach * (1 + 1e-9) + 1e-6 * (1 + near)
        go = d[:, cells] - radii <= reach[:, None]
        return np.logical_or.reduceat(go, firsts, axis=1), reach

    def count(batches):
        total = np.zeros(len(blocks), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                total += visits(batch.slice(start, 1024))[0].sum(axis=0)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype("int32")), pa.array(total[there])], names=["cell", "n"])

    def route(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                go, reach = visits(piece)
                rows, cols = np.nonzero(go)
                for i in range(0, len(rows), ROUTED):
                    r, c = rows[i : i + ROUTED], cols[i : i + ROUTED]
                    at = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("id").take(at), piece.column("embedding").take(at), pa.array(c.astype("int32")), pa.array(blocks[c]), pa.array(reach[r])],
                        names=["id", "embedding", "cell", "n_blocks", "reach"])

    routed_schema = T.StructType([
        T.StructField("id", queries.schema["id"].dataType),
        T.StructField("embedding", queries.schema["embedding"].dataType),
        T.StructField("cell", T.IntegerType()),
        T.StructField("n_blocks", T.LongType()),
        T.StructField("reach", T.DoubleType()),
    ])
    queries = queries.select("id", "embedding")
    routed = queries.mapInArrow(route, routed_schema)
    if n_queries <= query_rows:
        chunks = {c: 1 for c in range(len(blocks))}
    else:
        seen = queries.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        chunks = {r["cell"]: max(1, -(-r["n"] // query_rows)) for r in seen} or {0: 1}

    def by_cell(numbers: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair]), F.col("cell"))

    keys = ["cell", "block", "chunk"]
    routed = (
        routed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .withColumn("chunk", F.pmod(F.xxhash64("id", "embedding"), by_cell(chunks)))
        .select(*keys, "id", "embedding", "reach")
    )
    # A block is repeated once per chunk of the queries that visit its part, and not at all if none does.
    placed_schema = T.StructType([*corpus.select("id", "embedding", "label").schema.fields, T.StructField("cell", T.IntegerType())])
    placed = corpus.select("id", "embedding", "label").mapInArrow(assign(["id", "embedding", "label", "cell"]), placed_schema)
    placed = placed.withColumn("cell", F.element_at(F.lit(part_of.tolist()), F.col("cell") + 1))
    visited = placed.where(F.col("cell").isin(list(chunks))) if len(chunks) < len(blocks) else placed
    corpus_blocks = (
        visited.withColumn("block", F.pmod(F.xxhash64("id", "embedding"), by_cell(dict(enumerate(blocks.tolist())))))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), by_cell(chunks).cast("long") - 1)))
        .select(*keys, "id", "embedding", "label")
    )
    names = ["query_id", "neighbor_id", "label", "distance"]

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = cols = np.empty(0, np.int64)
        dist = np.empty(0)
        if len(left) and len(right):
            q, t = _prepare(_matrix(left["embedding"]), metric), _prepare(_matrix(right["embedding"]), metric)
            (q_ids, known), (t_ids, _) = _id_values(left["id"]), _id_values(right["id"])
            rows, cols, dist = _top_k(q, q_ids, t, t_ids, k, metric, skip_self, left["reach"].to_numpy(), known)
            if metric in ("cosine", "correlation"):
                dist = dist * dist / 2.0
        return pa.table([left["id"].take(pa.array(rows)), right["id"].take(pa.array(cols)), right["label"].take(pa.array(cols)), pa.array(dist)], names=names)

    out_schema = T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType),
        T.StructField("neighbor_id", id_type),
        T.StructField("label", label_type),
        T.StructField("distance", T.DoubleType()),
    ])
    partial = routed.groupBy(*keys).cogroup(corpus_blocks.groupBy(*keys)).applyInArrow(nearest, out_schema)
    # Each query brings k rows per block; Spark limits them per task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_graph(df: DataFrame, k: int, metric: str = "euclidean", n_rows: int | None = None) -> DataFrame:
    """Neighbour graph of a table on itself; k is kept within 2 and n - 1."""
    n = df.count() if n_rows is None else n_rows
    k = max(2, min(k, n - 1))
    corpus = df.select("id", "embedding", F.lit(None).cast("int").alias("label"))
    return knn_join(df, corpus, k, metric, skip_self=True, n_queries=n, n_corpus=n).drop("label")


def knn_vote(neighbors: DataFrame) -> DataFrame:
    """Majority label per query; a tie goes to the label of the nearer neighbour."""
    votes = neighbors.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    best = F.max_by("label", F.struct("n", -F.col("first")))
    return votes.groupBy("query_id").agg(best.alias("predicted"))


def knn_accuracy(df: DataFrame, k: int = 5, val_frac: float = 0.2, seed: int = 0) -> DataFrame:
    """Held-out vote accuracy of ``(id, embedding, label)``: one row (n_train, n_val, accuracy).

    NULL accuracy where there are fewer than two classes or no split.
    """
    from .ranking import stratified_split

    # Read several times below (pivots, cells, both sides), so the split is written once.
    split = materialize(stratified_split(df.select("id", "embedding", "label"), "id", "label", val_frac, seed), "split")
    sizes = split.groupBy().agg(
        F.count_if(~F.col("is_val")).alias("t"), F.count_if("is_val").alias("v"), F.min("label").alias("a"), F.max("label").alias("b")
    ).first()
    spark = df.sparkSession
    schema = "n_train long, n_val long, accuracy double"
    if not sizes["t"] or not sizes["v"] or sizes["a"] == sizes["b"]:
        return literal_table(spark, [(sizes["t"], sizes["v"], None)], schema)
    val = split.where("is_val")
    neighbors = knn_join(val, split.where("not is_val"), min(k, sizes["t"]), n_queries=sizes["v"], n_corpus=sizes["t"])
    scored = knn_vote(neighbors).join(val.select(F.col("id").alias("query_id"), "label"), "query_id")
    return scored.agg(
        F.lit(sizes["t"]).cast("long").alias("n_train"),
        F.count(F.lit(1)).alias("n_val"),
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"),
    )


def label_points(points: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """Plotted tiles with their confirmed category, "unlabeled" where there is none."""
    return points.join(records.select(*key, "category"), key, "left").withColumn(
        "category", F.coalesce("category", F.lit("unlabeled"))
    )


def label_legend(points: DataFrame) -> DataFrame:
    return points.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def embedding_health(pairs: DataFrame, weights=(25.0, 25.0, 1.0)) -> DataFrame:
    """Agreement of two views and collapse of either: one row (sim, std, cov, total).

    ``pairs`` is ``(z1, z2)`` arrays. Each task adds up its own second moments
    with a matrix product and sends d * d sums, never the pairs of dimensions
    of every row.
    """
    def moments(batches):
        gram, plain, rows, sse = {}, {}, 0, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            z = [np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("z1", "z2")]
            sse += float(((z[0] - z[1]) ** 2).sum())
            rows += len(pdf)
            for v in (0, 1):
                gram[v] = gram.get(v, 0.0) + z[v].T @ z[v]
                plain[v] = plain.get(v, 0.0) + z[v].sum(axis=0)
        for v in gram:
            i, j = np.indices(gram[v].shape)
            yield pd.DataFrame({"view": v, "i": i.ravel(), "j": j.ravel(), "s": gram[v].ravel()})
            yield pd.DataFrame({"view": v, "i": np.arange(len(plain[v])), "j": -1, "s": plain[v]})
            yield pd.DataFrame({"view": [v], "i": [-1], "j": [-1], "s": [float(rows)]})
        if rows:
            yield pd.DataFrame({"view": [2], "i": [-1], "j": [-1], "s": [sse]})

    sums = (
        pairs.select("z1", "z2")
        .mapInPandas(moments, "view int, i int, j int, s double")
        .groupBy("view", "i", "j")
        .agg(F.sum("s").alias("s"))
    )
    # d * d products, d sums and a count per view from here on.
    si = sums.where("view < 2 and i >= 0 and j = -1").select("view", "i", F.col("s").alias("si"))
    sj = si.select("view", F.col("i").alias("j"), F.col("si").alias("sj"))
    n = sums.where("view < 2 and i = -1").select("view", F.col("s").alias("n"))
    cov = (
        sums.where("i >= 0 and j >= 0").join(si, ["view", "i"]).join(sj, ["view", "j"]).join(n, "view")
        .withColumn("c", (F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1))
    )
    d = F.max("i") + 1
    same = F.col("i") == F.col("j")
    hinge = F.greatest(F.lit(0.0), 1.0 - F.sqrt(F.greatest(F.col("c"), F.lit(0.0)) + 1e-4))
    shape = cov.agg(
        F.max("n").alias("n"),
        d.alias("d"),
        (F.sum(F.when(same, hinge)) / d).alias("std"),
        (F.sum(F.when(~same, F.col("c") * F.col("c"))) / d).alias("cov"),
    )
    sse = sums.where("view = 2").agg(F.sum("s").alias("sse"))
    both = shape.unionByName(sse, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in ("n", "d", "std", "cov", "sse")])
    parts = both.select((F.col("sse") / F.col("n") / F.col("d")).alias("sim"), "std", "cov")
    a, b, c = weights
    return parts.withColumn("total", a * F.col("sim") + b * F.col("std") + c * F.col("cov"))
