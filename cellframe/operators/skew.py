"""Building blocks that keep a hot key from landing in one task.

One project, field of view or category may hold a large part of all rows, so
nothing here ranks, joins or sorts a whole group in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def merge_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the data, such as pixels, cells or fields.

    Spark plans a stored table by its packed files, which may be a hundredth of what its rows take, and
    does not count what ``explode`` adds; left to itself it would broadcast such a table through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    salts: int | None = None,
    salt_on: list[str] | None = None,
    many: bool = False,
) -> DataFrame:
    """Join per-group facts (unique per key) onto rows whose key may be hot.

    The fact side is repeated once per salt, and each row of the big side picks
    one copy by its partition and columns: never at random, so a retried task
    picks the same, and equal rows from different tasks still part ways. The
    number of salts grows with the session's shuffle partitions. A fact table
    small enough is turned into a broadcast by adaptive execution, on its
    measured size. Facts known to be ``many`` are never broadcast: their size is
    planned from packed files and without the copies, far below what the driver
    would have to hold.
    """
    if salts is None:
        salts = min(128, max(8, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *(salt_on or big.columns)), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = merge_join(left, right, [*on, "_salt"], how) if many else left.join(right, [*on, "_salt"], how)
    return joined.drop("_salt")


def join_facts(
    big: DataFrame, facts: DataFrame, on: list[str], how: str = "inner", max_rows: int = 20_000, salt_on: list[str] | None = None
) -> DataFrame:
    """Join a small table made from a very large one back onto it.

    The facts (a few numbers per image, say) are written once and counted. Up
    to ``max_rows`` they are broadcast, and the big side, whose rows may hold
    whole planes, is not shuffled; beyond that the salted join takes over, so
    facts of many groups never pass through the driver.
    """
    return join_stored_facts(big, materialize(facts, "facts"), on, how, max_rows, salt_on)


def join_stored_facts(
    big: DataFrame, kept: DataFrame, on: list[str], how: str = "inner", max_rows: int = 20_000, salt_on: list[str] | None = None
) -> DataFrame:
    """``join_facts`` for facts that are written already, to be joined to several tables."""
    if kept.count() <= max_rows:
        return big.join(F.broadcast(kept), on, how)
    return salted_join(big, kept, on, how, salt_on=salt_on, many=True)


def mark_first_by_hash(df: DataFrame, group: list[str], hash_hex: Column, wanted, out: str, digits: int = 4) -> DataFrame:
    """Flag the first ``wanted(n)`` rows of each group of ``n``, in the order of a uniform hex hash of a unique key.

    Counts per leading hex digits find the one bucket where the wanted number is
    reached; only that bucket's rows are ranked, which gives each group a cutoff
    hash. Flagging is then a comparison on every row: however large a group is,
    its rows are never sorted and, the cutoffs being few, not even shuffled.
    """
    keyed = df.select(*group, hash_hex.alias("_h")).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_want", wanted(F.sum("_n").over(Window.partitionBy(*group))).cast("long")
    )
    edge = counts.where((F.col("_off") < F.col("_want")) & (F.col("_off") + F.col("_n") >= F.col("_want")))
    at_edge = join_facts(keyed, edge.drop("_n"), [*group, "_b"])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_h")) + F.col("_off")
    cutoff = at_edge.withColumn("_r", rank).where(F.col("_r") == F.col("_want")).select(*group, F.col("_h").alias("_cut"))
    marked = join_facts(df, cutoff, group, "left")
    return marked.withColumn(out, F.coalesce(hash_hex <= F.col("_cut"), F.lit(False))).drop("_cut")


def blocked_rank(df: DataFrame, group: list[str], key: str, out: str, block: int = 4096) -> DataFrame:
    """1-based rank of an integer key, unique in its group.

    Rows are cut into blocks of the key range; counts per block give each block
    its offset, so only rows of the same block are ever sorted together.
    """
    rows = df.withColumn("_b", F.floor(F.col(key) / F.lit(block)))
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key))
    return rows.join(offsets, [*group, "_b"]).withColumn(out, inside + F.col("_off")).drop("_off", "_b")


def _value_bin(v: Column) -> Column:
    """Monotone integer bin of a double: 256 bins per factor of two, mirrored for negatives.

    A bin holds at most 2**15 distinct float32 values, and far fewer camera counts. Infinities lie in bins of their own
    beyond all numbers.
    """
    size = F.when(F.abs(v) == F.lit(float("inf")), F.lit(600000)).otherwise(F.floor(F.log2(F.abs(v)) * 256) + 300000)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def _holds(index: Column, start: Column, n: Column) -> Column:
    return (index >= start) & (index < start + n)


def _wanted(percents: dict[str, float], start: Column, n: Column) -> Column:
    """Whether rows ``start`` to ``start + n`` of a group hold one of the order statistics asked for."""
    found = F.lit(False)
    for p in percents.values():
        spot = (F.col("_total") - 1) * F.lit(p / 100.0)
        for index in (F.floor(spot), F.ceil(spot)):
            found = found | _holds(index, start, n)
    return found


#: Parts into which a bin with too many rows is cut. Four cuts tell any two doubles of a first bin apart.
PARTS, CUTS = 4096, 6


def selected_bins(df: DataFrame, group: list[str], value: str, percents: dict[str, float], bin_rows: int) -> DataFrame:
    """Rows ``(group…, _v, _before, _n, _total)`` of the value bins that hold the wanted order statistics.

    ``_before`` is the number of rows of the group below the bin and names it. Bins start as in ``_value_bin``; those of more
    than ``bin_rows`` rows are cut into equal parts between their least and greatest value, and the parts that hold
    nothing wanted are dropped, until every bin is small or holds one value only. Cutting
    is monotone in the value, rounding included, so counts below a bin stay exact.
    """
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_part", _value_bin(F.col("_v")))
    size = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    hist = rows.groupBy(*group, "_part").agg(*size)
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("_before", below).withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    chosen = materialize(hist.where(_wanted(percents, F.col("_before"), F.col("_n"))), "bins")
    rows = join_facts(rows, chosen, [*group, "_part"]).drop("_part")
    large = (F.col("_n") > bin_rows) & (F.col("_lo") < F.col("_hi"))
    for _ in range(CUTS):
        if not chosen.where(large).limit(1).count():
            break
        part = F.when(large, F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS)).otherwise(F.lit(0)).cast("int")
        rows = materialize(rows.select(*group, "_v", "_before", "_total", part.alias("_part")), "rows")
        hist = rows.groupBy(*group, "_before", "_total", "_part").agg(*size)
        below = F.sum("_n").over(Window.partitionBy(*group, "_before").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        hist = hist.withColumn("_start", F.col("_before") + F.coalesce(below, F.lit(0)))
        chosen = materialize(hist.where(_wanted(percents, F.col("_start"), F.col("_n"))), "bins")
        rows = join_facts(rows, chosen.drop("_total"), [*group, "_before", "_part"]).drop("_part", "_before").withColumnRenamed("_start", "_before")
        chosen = chosen.drop("_before").withColumnRenamed("_start", "_before")
    return rows.select(*group, "_v", "_before", "_n", "_total")


def exact_percentiles(df: DataFrame, group: list[str], value: str, percents: dict[str, float], bin_rows: int = 1_000_000) -> DataFrame:
    """Exact linear-interpolated percentiles for groups of any size.

    A histogram per group (aggregated map-side) tells which bins hold the order
    statistics wanted, and bins of many rows are cut further (``selected_bins``),
    however close their values are. The rows left are counted by value map-side, so
    no task sees more than ``bin_rows`` distinct values of a bin.
    """
    chosen = selected_bins(df, group, value, percents, bin_rows)
    pairs = chosen.groupBy(*group, "_before", "_total", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*group, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    aggs = []
    for name, p in percents.items():
        spot = (F.col("_total") - 1) * F.lit(p / 100.0)
        low = F.max(F.when(_holds(F.floor(spot), F.col("_start"), F.col("_c")), F.col("_v")))
        high = F.max(F.when(_holds(F.ceil(spot), F.col("_start"), F.col("_c")), F.col("_v")))
        frac = F.max(spot - F.floor(spot))
        # no arithmetic on one value alone: it may be infinite
        aggs.append(F.when((low == high) | (frac == 0), low).otherwise(low + (high - low) * frac).alias(name))
    return pairs.groupBy(*group).agg(*aggs)
