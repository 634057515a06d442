"""Review order, paging, sampling, splits and last-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import natural_key
from ..session import materialize
from .skew import mark_first_by_hash, salted_join
from .tags import last_per_key


def review_order() -> list:
    """Category (untagged first), model tags by rising confidence, then human ones."""
    return [
        F.coalesce(F.col("category"), F.lit("")),
        F.col("confidence").isNull(),
        F.col("confidence"),
        F.col("cell_id"),
    ]


def review_queue(tagged: DataFrame) -> DataFrame:
    """A range-partitioned global sort."""
    return tagged.orderBy(*review_order())


def page(df: DataFrame, key: str, number: int, size: int, shallow: int = 10_000) -> DataFrame:
    """Page ``number`` (0-based, clamped to the last) in natural order of ``key``.

    Needs the row count to clamp, as a pager does. Early pages are a top-n. For
    a deep one the rows are written range-partitioned by the order, each with
    its range number; the counts per range tell which range the page starts in,
    and only those ranges are sorted.
    """
    pages = max(1, -(-df.count() // size))
    number = min(max(number, 0), pages - 1)
    skip = number * size
    order = [natural_key(key), F.col(key)]
    if skip + size <= shallow:
        return df.orderBy(*order).offset(skip).limit(size)
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    chosen, first, before = [], 0, 0
    for part, n in counts:
        if before < skip + size and before + n > skip:
            if not chosen:
                first = before
            chosen.append(part)
        before += n
    inside = ranged.where(F.col("_range").isin(chosen)).drop("_range")
    return inside.orderBy(*order).offset(skip - first).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)) / size)).alias("n_pages"))


def seeded_hash(key, seed: int):
    """Uniform hex hash of a key under a seed: the stand-in for a random shuffle."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows (all if fewer) in the hash order of a unique key.

    Counts per hash prefix give the hash at which ``n`` is reached; rows are compared with it where they lie, so a
    large sample passes through no single task.
    """
    one = df.withColumn("_all", F.lit(0))
    taken = mark_first_by_hash(one, ["_all"], seeded_hash(F.col(key), seed), lambda rows: F.least(rows, F.lit(n)), "_taken")
    return taken.where("_taken").select(*df.columns)


def stratified_split(
    df: DataFrame, key: str, label: str, val_frac: float = 0.2, seed: int = 0, out: str = "is_val"
) -> DataFrame:
    """Split every class on its own: max(1, round-half-even(n * frac)) rows validate, none of a single-row class.

    ``key`` is unique; membership follows the hash order of key and seed.
    """
    def n_val(n):
        return F.when(n > 1, F.greatest(F.lit(1.0), F.rint(n * F.lit(val_frac)))).otherwise(F.lit(0.0))

    return mark_first_by_hash(df, [label], seeded_hash(F.col(key), seed), n_val, out)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row of each key by a source order."""
    fields = [c for c in df.columns if c not in key]
    packed = df.withColumn("_order", F.struct(*order))
    return last_per_key(packed, key, "_order", *fields).select(*df.columns)


def concat_index(existing: DataFrame, records: DataFrame) -> DataFrame:
    """Union under the first frame's column types."""
    casts = [F.col(f.name).cast(f.dataType).alias(f.name) for f in existing.schema.fields]
    return existing.unionByName(records.select(*casts))


def upsert_tile_index(
    existing: DataFrame, records: DataFrame, fov_ids: DataFrame | None = None
) -> DataFrame:
    """Replace all rows of re-exported fields of view, even those that come back empty."""
    replaced = (fov_ids if fov_ids is not None else records).select("fov_id").distinct()
    kept = salted_join(existing, replaced, ["fov_id"], "left_anti", salt_on=["cell_id"])
    both = concat_index(kept.withColumn("_src", F.lit(0)), records.withColumn("_src", F.lit(1)))
    return keep_last(both, ["cell_id"], ["_src", "label", "fov_id", "crop_path"]).drop("_src")
