"""Near-duplicate vectors: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

1. Vectors of one length form an index of their own. For each of the ``FITTED`` most frequent lengths of a sample of ``SAMPLE``
   vectors, rotations are fitted: principal axes (at most ``BITS``), then alternating sign codes and Procrustes rotations.
   Any other length gets rotations fitted on seeded random vectors, whose bits differ with probability angle / pi.
2. A code of one bit for each axis is cut into parts; two vectors meet if some part of some rotation differs in at most one bit.
   How many rotations, how many parts, and how much of the mean is taken off first follow from the sample: pairs of cosine
   exactly ``cosine`` are made from it, in its own directions and in random ones, and of the settings by which at least
   ``TARGET`` of these meet, the one is taken that costs least at the number of vectors there are. So parts grow longer
   as vectors become more, and vectors that share a direction are not pulled apart by centring. If no setting reaches the
   target, the one with most recall is taken. ``Index.recall`` says what was measured.
3. Pairs that meet are tested on the whole code, by a bound that 99.9 % of the made pairs keep, and reranked by the cosine
   of the original vectors in double precision.

Equal vectors of one label form a class that is looked up once; its size counts in the links of others and its own.

Defined results: null ids or labels, null, empty or zero vectors, vectors with null or non-finite components have no links and are
their own component; vectors of unlike length are never linked; repeated rows count as links of one another, and a vec_id
with several vectors has a row for each, with the links of that vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, sample_rows, stored

SAMPLE, ROUNDS, BITS, FITTED = 8192, 20, 64, 16
TARGET, ROTATIONS, TRIALS = 0.98, 8, 1024
SHARES = (1.0, 0.5, 0.0)
WIDTHS = (32, 22, 16, 13, 11, 8, 6, 4)


@dataclass(frozen=True)
class Index:
    """Settings of one vector length: what to subtract, projections, bits of each part, most differing bits, measured recall."""

    centre: np.ndarray
    projections: list[np.ndarray]
    widths: list[int]
    most: int
    recall: float


def fit_rotation(x: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """A projection to at most BITS axes; ``sign(x @ projection)`` is the code of rows that are centred already."""
    _, axes = np.linalg.eigh(x.T @ x + 1e-12 * np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :BITS]
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return axes @ r


def _codes(unit: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(unit), 64), np.uint8)
    bits[:, : projection.shape[1]] = (unit - centre) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _cut(bits: int, width: int) -> list[int]:
    """``bits`` in parts of ``width`` at most, as equal as can be."""
    n = -(-bits // width)
    return [(k + 1) * bits // n - k * bits // n for k in range(n)]


def _parts(codes: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    low = np.cumsum([0, *widths])
    return [codes >> np.uint64(a) & np.uint64((1 << w) - 1) for a, w in zip(low, widths)]


def _met(x: np.ndarray, y: np.ndarray, widths: list[int]) -> np.ndarray:
    return np.any([np.bitwise_count(p ^ q) <= 1 for p, q in zip(_parts(x, widths), _parts(y, widths))], axis=0)


def _meetings(codes: np.ndarray, widths: list[int]) -> float:
    """The share of all ordered pairs that meet in a part, counted once for every part."""
    found = 0
    for part, w in zip(_parts(codes, widths), widths):
        values, counts = np.unique(part, return_counts=True)
        for other in [values, *[values ^ np.uint64(1 << b) for b in range(w)]]:
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            found += int((counts * np.where(values[at] == other, counts[at], 0)).sum())
    n = len(codes)
    return max(0, found - n * len(widths)) / max(1, n * (n - 1))


def _at_cosine(x: np.ndarray, cosine: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors of exactly this cosine: half of them apart in a direction of the sample, half in a random one."""
    rng = np.random.default_rng(seed)
    base = x[rng.integers(0, len(x), 2 * TRIALS)]
    away = x[rng.integers(0, len(x), 2 * TRIALS)] - x[rng.integers(0, len(x), 2 * TRIALS)]
    away[TRIALS:] = 0
    away = away - (away * base).sum(axis=1, keepdims=True) * base
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    flat = np.linalg.norm(away, axis=1) < 1e-6
    away[flat] = noise[flat]
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    return base, cosine * base + np.sqrt(1 - cosine**2) * away


def fit_index(x: np.ndarray, cosine: float, mates: float) -> Index:
    """The cheapest setting that reaches TARGET on both kinds of made pairs, for vectors (unit rows like ``x``) that are
    compared with ``mates`` others each."""
    left, right = _at_cosine(x, cosine)
    best = None
    for share in SHARES:
        centre = share * x.mean(axis=0)
        projections, sides, codes = [], [], []
        for width in WIDTHS:
            widths = _cut(min(x.shape[1], BITS), width)
            met = np.zeros(len(left), bool)
            for n in range(ROTATIONS):
                if n == len(projections):
                    projections.append(fit_rotation(x - centre, seed=7 + n))
                    sides.append((_codes(left, centre, projections[n]), _codes(right, centre, projections[n])))
                    codes.append(_codes(x[:2048], centre, projections[n]))
                met |= _met(*sides[n], widths)
                recall = float(min(met[:TRIALS].mean(), met[TRIALS:].mean()))
                # a probe is a row that moves; a meeting is a comparison of two codes
                cost = (n + 1) * (sum(w + 1 for w in widths) + 0.3 * mates * _meetings(codes[0], widths))
                rank = (recall < TARGET, cost if recall >= TARGET else -recall)
                if best is None or rank < best[0]:
                    apart = np.concatenate([np.bitwise_count(a ^ b) for a, b in sides[: n + 1]])
                    best = rank, Index(centre, projections[: n + 1], widths, int(np.quantile(apart, 0.999)) + 1, recall)
                if recall >= TARGET or best[0][0] is False and cost >= best[0][1]:
                    break
    return best[1]


@lru_cache(maxsize=64)
def _unfitted(size: int, cosine: float) -> Index:
    x = np.random.default_rng(size).normal(size=(512, size))
    return fit_index(x / np.linalg.norm(x, axis=1, keepdims=True), cosine, 100.0)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _coder(indexes: dict[int, Index], cosine: float):
    """One row for each vector and rotation: its code, the parts of it and their widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                unit = _unit(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                index = indexes.get(int(size)) or _unfitted(int(size), cosine)
                for turn, projection in enumerate(index.projections):
                    codes = _codes(unit, index.centre, projection)
                    parts = np.stack(_parts(codes, index.widths), axis=1).astype(np.int64)
                    n = len(rows)
                    same = lambda value, kind: pa.array([value] * n, kind)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id"), rows.column("label"), same(int(size), pa.int32()), same(turn, pa.int32()), same(index.most, pa.int32()), pa.array(codes.view(np.int64)),
                         pa.array(list(parts), pa.list_(pa.int64())), same(index.widths, pa.list_(pa.int32()))],
                        names=["id", "label", "size", "turn", "most", "code", "parts", "widths"],
                    )

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy())
        for size in np.unique(sizes):
            rows = batch.filter(pa.array(sizes == size))
            unit = _unit(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("m"), pa.array(list(unit), pa.list_(pa.float64()))], names=["id", "m", "unit"])


def fit_indexes(sound: DataFrame, cosine: float) -> dict[int, Index]:
    """Settings of the most frequent lengths; ``sound`` has vec_id, label, v."""
    sample = sample_rows(sound.select("vec_id", "v"), SAMPLE, "vec_id").toPandas()
    lengths = sample["v"].map(len)
    common = [int(s) for s in lengths.value_counts().index[:FITTED]]
    per_label = sound.where(F.size("v").isin(common)).groupBy(F.size("v").alias("size"), "label").agg(F.count(F.lit(1)).cast("double").alias("c"))
    mates = {r["size"]: r["mates"] for r in per_label.groupBy("size").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("mates")).collect()}
    groups = {s: _unit(np.stack(sample["v"][lengths == s].to_numpy())) for s in common}
    # a rotation needs as many vectors as it has axes
    return {s: fit_index(x, cosine, mates[s]) for s, x in groups.items() if len(x) >= min(s, BITS)}


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (columns vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    sound = rows.where(usable)
    indexes = fit_indexes(sound, cosine)

    # one row for each distinct vector of a label, with a number of its own; written before the number is used
    classes = stored(
        sound.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("m")).select(F.monotonically_increasing_id().alias("id"), "label", "v", "vec_id", "m"),
        "classes",
    )
    coded = stored(classes.select("id", "label", "v").mapInArrow(_coder(indexes, cosine), "id long, label long, size int, turn int, most int, code long, parts array<long>, widths array<int>"), "codes")
    entries = coded.select("id", "label", "size", "turn", "most", "code", "widths", F.posexplode("parts").alias("part", "value"))
    one_off = F.transform(F.sequence(F.lit(0), F.col("widths")[F.col("part")] - 1), lambda b: F.col("value").bitwiseXOR(F.expr("1L").cast("long") * F.pow(F.lit(2.0), b).cast("long")))
    probes = entries.withColumn("value", F.explode(F.concat(F.array("value"), one_off)))
    place = ["label", "size", "turn", "part", "value"]
    same = F.lit(True)
    for c in place:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    pairs = (
        probes.select("id", "code", "most", *place).alias("x")
        .join(entries.select("id", "code", *place).alias("y"), same & (F.col("x.id") < F.col("y.id")) & (F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= F.col("x.most")))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    )
    units = stored(classes.select("id", "m", "v").mapInArrow(_units, "id long, m long, unit array<double>"), "units")
    dot = F.aggregate(F.zip_with("x.unit", "y.unit", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    links = stored(
        pairs.join(units.alias("x"), F.col("a") == F.col("x.id")).join(units.alias("y"), F.col("b") == F.col("y.id"))
        .where(dot >= cosine).select("a", "b", F.col("x.m").alias("m_a"), F.col("y.m").alias("m_b")),
        "links",
    )
    degree = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("m_b").alias("m")), F.struct(F.col("b").alias("id"), F.col("m_a").alias("m")))).alias("e")).groupBy("e.id").agg(F.sum("e.m").alias("others"))
    own = stored(
        classes.select("id", "vec_id", "label", "v", "m").join(degree, "id", "left").join(components(links), "id", "left")
        .select("label", "v", "vec_id", "m", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "id").alias("component")),
        "own",
    )
    least = stored(own.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    facts = stored(join_counted(own, least, "component", "members").select(F.struct("label", "v").alias("vector"), "m", "links", "component_id"), "facts")
    found = join_counted(sound.select("vec_id", F.struct("label", "v").alias("vector")), facts, "vector", "m").select("vec_id", F.col("links").alias("n_links"), "component_id")
    apart = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
