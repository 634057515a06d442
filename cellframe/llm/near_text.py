"""Near-duplicate documents by MinHash bands, sequential Bayesian verification and exact comparison.

1. Documents with the same set of word shingles form a class, which has a number of its own and its smallest doc_id.
2. A class gets ``BANDS`` band keys of ``ROWS`` minimum hashes each, and ``HASHES`` four-bit MinHashes, 64 to four words
   of one bit of each. Two of them agree with probability J + (1 - J) / 16 for Jaccard similarity J.
3. Classes that share a band are candidates. After each of ``BATCHES`` hashes the posterior of J given the agreements
   so far, from a uniform prior, is known; a pair is dropped as soon as P(J >= threshold) falls below ``miss``. The
   bounds are a table of the most disagreements that a batch may end with.
4. Survivors are compared on their full shingle sets.
5. Links become components. To spare the square of a group: first every member of a band is compared with one member of
   the band, the pivot; ``STARS`` times more, a new pivot outside the band's largest component is compared with the
   members of other components. Only members of a band that are still in different
   components are then compared with each other, inside the join, which gives out confirmed links alone. A pair that is
   left out lies in one component already, so components are those of all pairs that meet in a band. Bands of more than
   ``BLOCK`` are cut by set size, where only neighbouring sizes can be similar enough, and by hash into blocks, so that no
   band is one task.

Sets are compared as 64-bit hashes of shingles: a shingle is taken for another with probability 2**-64.
A pair of similarity 0.75 is lost with probability 5e-6 + 4.1e-5: it misses all bands, (1 - 0.75 ** ROWS) ** BANDS, or is
dropped by the sequential test (simulated; 1e-5 at similarity 0.76).

Defined results: null text or text without words has an empty set, 0 shingles and no links; texts of fewer words than
a shingle have one shingle; repeated doc_ids are separate rows, each with the component of its own text; a null doc_id is larger
than any other and is kept only in a component without ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, mix64, stored
from .tokens import give_back, release_encoders

SHINGLE, BANDS, ROWS, HASHES = 5, 32, 4, 384
BATCHES = (64, 192, 384)
MISS = 1e-5
MARKS = 1 << 24
BLOCK = 1024
PIECE = 1 << 20
STARS = 1


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (lower-cased A-Z; split at space and 0x09-0x0D).

    A word's hash is the mixed sum of one pseudorandom number for each (place in the word, byte), so two words that differ
    agree with probability 2**-64. Long texts are taken in pieces that end after a space.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    out = np.zeros(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(end, begin[first] + PIECE, "right")))
        low, high = begin[first], end[last - 1]
        starts = begin[first:last] - low
        place = np.arange(high - low) - np.repeat(starts, np.diff(np.append(starts, high - low)))
        values = mix64((place.astype(np.uint64) << np.uint64(8) | raw[low:high]) + np.uint64(0x9E3779B97F4A7C15))
        values[space[low:high]] = 0
        out[first:last] = mix64(np.add.reduceat(values, starts) ^ (end - begin)[first:last].astype(np.uint64))
        first = last
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    words = _word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = max(BANDS * ROWS, HASHES)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[None, :], rng.integers(0, 1 << 32, n, dtype=np.uint32)[None, :]


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed four-bit hashes of a non-empty set."""
    a, b = _functions()
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(a.shape[1], np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 256):
        values = x[i : i + 256] * a
        values += b
        np.minimum(low, values.min(axis=0), out=low)
    keys = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + low[: BANDS * ROWS].reshape(BANDS, ROWS)[:, r])
    four = mix64(low[:HASHES].astype(np.uint64)) & np.uint64(15)
    planes = (four.reshape(-1, 1, 64) >> np.arange(4, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(planes, axis=2).reshape(-1, 8).copy().view("<i8").ravel()


def digest(s: np.ndarray) -> bytes:
    """128 bits of a set and its size; sets that differ agree with probability 2**-128."""
    i = np.arange(1, len(s) + 1, dtype=np.uint64)
    return b"%016x%016x%x" % (int(np.bitwise_xor.reduce(mix64(s))), int((s * mix64(i)).sum(dtype=np.uint64)), len(s))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches: what is made of a slice is larger than its texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_encoders()
    for batch in _small(batches):
        ids, texts = batch.column("doc_id"), batch.column("text")
        sizes, digests, keys, words = [], [], [], []
        for text in texts:
            s = shingle_set(text.as_py())
            sizes.append(len(s))
            if len(s):
                k, w = signature(s)
                digests.append(digest(s))
                keys.append(k)
                words.append(w)
            else:
                digests.append(None)
                keys.append(None)
                words.append(None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "digest", "bands", "bits"],
        )
    give_back()


def most_disagreements(threshold: float, miss: float = MISS) -> list[int]:
    """After each of BATCHES four-bit hashes: the most disagreements at which P(J >= threshold | data) is at least ``miss``."""
    grid = (np.arange(20000) + 0.5) / 20000
    agree = np.log(grid + (1 - grid) / 16), np.log((1 - grid) * 15 / 16)
    bounds = []
    for n in BATCHES:
        d = 0
        while d < n:
            like = agree[0] * (n - d - 1) + agree[1] * (d + 1)
            p = np.exp(like - like.max())
            if p[grid >= threshold].sum() < miss * p.sum():
                break
            d += 1
        bounds.append(d)
    return bounds


def _plausible(threshold: float):
    """The sequential test on the packed words of both sides, as one condition that stops at the first batch that fails."""
    test = F.lit(True)
    for n, most in zip(BATCHES, most_disagreements(threshold)):
        differ = F.lit(0)
        for i in range(0, n // 16, 4):
            planes = [F.get("x.bits", F.lit(i + k)).bitwiseXOR(F.get("y.bits", F.lit(i + k))) for k in range(4)]
            differ = differ + F.bit_count(planes[0].bitwiseOR(planes[1]).bitwiseOR(planes[2].bitwiseOR(planes[3])))
        test = test & (differ <= most)
    return test


def _set_rows(marks: bytes):
    """Sets of the documents whose mark is there: all that are wanted, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        there = np.frombuffer(marks, np.uint64)
        for batch in _small(batches):
            at = batch.column("mark").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((there[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            digests = [digest(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])
        give_back()

    return run


def _mark(column: str):
    return F.pmod(F.xxhash64(column), F.lit(MARKS)).alias("mark")


def _marks(wanted: DataFrame) -> bytes:
    """A bitmap of MARKS bits (2 MB, whatever the input) that has the mark of every wanted doc_id: texts of other documents
    need not be moved. The more ids there are, the fewer texts it spares; the exact join follows."""
    rows = wanted.select(_mark("doc_id")).groupBy((F.expr("mark div 64")).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(mark % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the classes in ``ids``, made again from a document of each."""
    wanted = stored(classes.join(ids.distinct(), "id", "left_semi").select("id", "digest", "doc_id"), "wanted")
    made = docs.select("text", _mark("doc_id")).mapInArrow(_set_rows(_marks(wanted)), "digest binary, shingles array<long>")
    return stored(made.join(wanted.select("id", "digest"), "digest").select("id", "shingles").dropDuplicates(["id"]), "sets")


def _alike(percent: int):
    return (100 + percent) * F.size(F.array_intersect("x.shingles", "y.shingles")) >= percent * (F.size("x.shingles") + F.size("y.shingles"))


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets are similar enough. Only documents in some pair have their sets made again."""
    pairs = stored(pairs, "pairs")
    sets = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), classes, docs)
    return stored(
        pairs.join(sets.alias("x"), F.col("a") == F.col("x.id")).join(sets.alias("y"), (F.col("b") == F.col("y.id")) & _alike(percent)).select("a", "b"), "links")


def _cells(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of bands (band, key, id, component, n; main, the largest component of the band; m, how many it has; others,
    how many of them are outside main) twice, once for every cell that a member is in: left those outside main, right all.
    Two members of unlike components whose sizes ``percent`` allows share one cell of the left of one and the right of the
    other, and if both are outside main, one cell each way.

    A band of up to BLOCK members is one cell. A larger one has ranges of sizes by the allowed ratio, and both sides are
    cut by hash into blocks, each of which meets all blocks of the other side.
    """
    large = F.col("m") > BLOCK
    # allowed sizes are at most one range apart; the small stretch covers rounding
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9))).cast("long")
    lefts, rights = F.ceil(F.col("others") / BLOCK).cast("long"), F.ceil(F.col("m") / BLOCK).cast("long")
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("size", "x", "y")]))
    left = F.flatten(F.transform(F.sequence(size - 1, size + 1), lambda s: F.transform(up_to(rights), lambda b: F.struct(s.alias("size"), F.pmod(F.xxhash64("id"), lefts).alias("x"), b.alias("y")))))
    right = F.transform(up_to(lefts), lambda b: F.struct(size.alias("size"), b.alias("x"), F.pmod(F.xxhash64("id"), rights).alias("y")))
    cut = lambda rows, cells: rows.withColumn("cell", F.explode(F.when(large, cells).otherwise(one)))
    return cut(members.where("component != main"), left), cut(members, right)


def _mixed(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of bands that hold more than one component: with main, the component of most weight in the band, m, the
    band's weight, and others, the weight outside main. A member weighs one, and one more for every 1,024 shingles, so that
    a block of members is bounded in bytes too."""
    named = buckets.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    weight = F.sum(F.expr("1 + n div 1024"))
    parts = named.groupBy("band", "key", "component").agg(weight.alias("c"), F.min("id").alias("least"))
    most = parts.groupBy("band", "key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("most"))
    apart = parts.join(most, ["band", "key"]).where("component != most.component").groupBy("band", "key").agg(
        F.first("m").alias("m"), F.first("most.component").alias("main"), F.first(F.expr("m - most.c")).alias("others"), F.min("least").alias("pivot"))
    return stored(named.join(apart, ["band", "key"]), "mixed")


def _stars(members: DataFrame, sketch: DataFrame, plausible) -> DataFrame:
    """Plausible pairs ``(a, b)`` of a band's pivot a and each member b of another component."""
    pairs = members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    return pairs.join(sketch.alias("x"), F.col("a") == F.col("x.id")).join(sketch.alias("y"), (F.col("b") == F.col("y.id")) & plausible).select("a", "b")


def _thin(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: a member keeps the link to its smallest pivot, and its other pivots, one for
    each band at most, are linked with that one. Members of a group share pivots, so these links are few."""
    seen = links.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("pivots"))
    others = seen.select("a", F.explode("pivots").alias("b")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(seen.select("a", "b").unionByName(others.distinct()), "thin")


def _crossing(rest: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, plausible) -> DataFrame:
    """Links between members of a band that are still in different components.

    Cells are joined twice, and no candidate pair leaves a join: first for the members that have a plausible partner, then,
    with the full sets of these members only, for the links themselves.
    """
    met = F.lit(False)  # a pair is taken in the first band that it shares
    for k in range(BANDS - 1):
        met = met | ((F.col("x.band") > k) & (F.get("x.bands", F.lit(k)) == F.get("y.bands", F.lit(k))))
    meet = (
        (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.id") < F.col("y.id")) | (F.col("y.component") == F.col("y.main"))) & plausible
    )
    left, right = _cells(rest, percent)
    able = left.alias("x").join(right.alias("y"), meet, "left_semi").select("id").union(right.alias("y").join(left.alias("x"), meet, "left_semi").select("id"))
    sets = _sets(stored(able.distinct(), "able"), classes, docs)
    left, right = _cells(rest.join(sets, "id"), percent)
    return stored(
        left.alias("x").join(right.alias("y"), meet & ~met & _alike(percent)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")), "links")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs`` (columns doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "signed")
    # one row for each distinct set, with a number of its own; written before the number is used
    classes = stored(
        signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("n_shingles", "bands", "bits")).alias("s"))
        .select(F.monotonically_increasing_id().alias("id"), "digest", "doc_id", "copies", F.col("s.n_shingles").alias("n"), "s.bands", "s.bits"),
        "classes",
    )
    sketch = classes.select("id", "n", "bits")
    members = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    full = members.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = stored(members.join(full, ["band", "key"]).select("band", "key", "pivot", "id", "n"), "buckets")
    sizes_allow = (100 * F.least(F.col("x.n"), F.col("y.n")) >= percent * F.greatest(F.col("x.n"), F.col("y.n")))
    plausible = sizes_allow & _plausible(percent / 100)

    links = _thin(_confirm(_stars(buckets, sketch, plausible), classes, docs, percent))
    buckets = buckets.drop("pivot")
    groups = components(links)
    for _ in range(STARS):
        rest = _mixed(buckets, groups)
        if rest.isEmpty():
            break
        main = rest.where("id = pivot").select("band", "key", F.col("component").alias("own"))
        new = _thin(_confirm(_stars(rest.join(main, ["band", "key"]).where("component != own"), sketch, plausible), classes, docs, percent))
        if new.isEmpty():
            break
        links = links.unionByName(new)
        groups = components(links)
    else:
        rest = _mixed(buckets, groups)
    if not rest.isEmpty():
        rest = stored(rest.drop("pivot").join(classes.select("id", "bits", "bands"), "id"), "rest")
        groups = components(links.unionByName(_crossing(rest, classes, docs, percent, plausible)))

    own = classes.join(groups, "id", "left").select("id", "digest", "doc_id", "copies", F.coalesce("component", "id").alias("component"))
    least = stored(own.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    facts = stored(join_counted(stored(own, "own"), least, "component", "members").select("digest", "copies", "component_id"), "facts")
    rows = join_counted(signed.where("digest is not null").select("doc_id", "n_shingles", "digest"), facts, "digest", "copies").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
