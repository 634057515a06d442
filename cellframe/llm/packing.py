"""Sequences of fixed capacity from documents of any length: shortest pack first over the length histogram.

A document's ids are cut into whole sequences and a remainder. Only the histogram of remainder lengths (``capacity``
numbers at most) reaches the driver. There, as many packs are opened as the tokens need; lengths are placed longest
first, each into the pack that is filled least, whole groups of equal lengths and equal packs at a time. A length that
fits nowhere is cut: its head closes the pack, its tail is placed later. The placements refer to ranks within a length,
and are joined back to the documents by rank, which is computed from per-partition counters and a running sum over
partitions, so that a length shared by a third of all rows is never gathered in one task.

Defined results: a null or empty text has one token (the end id); repeated rows are packed as often as they occur; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import runs, stored
from .tokens import encoder, give_back, vocabulary_path

PLACEMENT = "length int, rank_from long, rank_to long, inner int, size int, pack_from long, pack_offset int"


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Placements ``(length, rank_from, rank_to, inner, size, pack_from, pack_offset)``.

    Items of ``length`` with ranks in [rank_from, rank_to) put their ids [inner, inner + size) into packs pack_from,
    pack_from + 1, ... at pack_offset. The number of placements depends on the capacity, not on the counts.
    """
    total = sum(n * c for n, c in histogram.items())
    if not total:
        return []
    segments = [(-n, n, 0, c, 0) for n, c in histogram.items() if c]  # -size, length, first rank, count, inner
    packs = [(0, 0, -(-total // capacity))]  # fill, first pack, count
    heapq.heapify(segments)
    out = []
    while segments:
        size, length, rank, count, inner = heapq.heappop(segments)
        fill, pack, free = heapq.heappop(packs)
        size, gap, n = -size, capacity - fill, min(count, free)
        put = min(size, gap)
        out.append((length, rank, rank + n, inner, put, pack, fill))
        if put < size:
            heapq.heappush(segments, (put - size, length, rank, n, inner + put))
        if n < count:
            heapq.heappush(segments, (-size, length, rank + n, count - n, inner))
        if n < free:
            heapq.heappush(packs, (fill, pack + n, free - n))
        if fill + put < capacity:
            heapq.heappush(packs, (fill + put, pack, n))
    return out


def _encode(path: str, end: int, capacity: int):
    """Tasks write, beside the ids, how many items of the same remainder and how many whole sequences came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks, whole = np.zeros(capacity, np.int64), 0
        for batch in batches:
            for start, texts in runs(batch, "text", 1_000_000):
                ids, sizes = encoder(path, True).encode(texts, end)
                rest, full = sizes % capacity, sizes // capacity
                order = np.argsort(rest, kind="stable")  # rank within the run and the remainder
                counts = np.bincount(rest, minlength=capacity)
                local = np.empty(len(rest), np.int64)
                local[order] = np.arange(len(rest)) - (np.cumsum(counts) - counts)[rest[order]]
                local += ranks[rest]
                before = whole + np.cumsum(full) - full
                ranks += counts
                whole += int(full.sum())
                width = np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32
                raw, ends = ids.astype(width).tobytes(), np.cumsum(sizes) * width().nbytes
                blobs = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), pa.array(blobs, pa.binary()), pa.array(np.full(len(rest), width().nbytes, np.int32)),
                     pa.array(sizes), pa.array(rest.astype(np.int32)), pa.array(np.full(len(rest), part, np.int32)), pa.array(local), pa.array(before)],
                    names=["doc_id", "ids", "width", "doc_tokens", "rest", "part", "local_rank", "local_whole"],
                )
                give_back()

    return run


def pack(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = 1024) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, width, doc_tokens, sequence_id, offset)`` of all documents.

    ``ids`` holds the piece's token ids, little-endian, ``width`` bytes each.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode(path, end, capacity),
        "doc_id long, ids binary, width int, doc_tokens long, rest int, part int, local_rank long, local_whole long",
    )
    coded = stored(coded, "tokens")
    held = coded.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("items"), F.sum(F.expr(f"doc_tokens div {capacity}")).alias("whole"))
    held = stored(held, "held")
    histogram = {r["rest"]: r["items"] for r in held.where("rest > 0").groupBy("rest").agg(F.sum("items").alias("items")).collect()}
    placed = coded.sparkSession.createDataFrame(plan_packs(histogram, capacity), PLACEMENT)
    packs = -(-sum(n * c for n, c in histogram.items()) // capacity)
    # ranks before a partition's items of one length; whole sequences before the partition's first
    by_length = Window.partitionBy("rest").orderBy("part")
    by_part = Window.orderBy("part")  # one row per input partition
    firsts = held.groupBy("part").agg(F.sum("whole").alias("whole")).select("part", (F.sum("whole").over(by_part) - F.col("whole")).alias("whole_before"))
    before = held.select("part", "rest", (F.sum("items").over(by_length) - F.col("items")).alias("rank_before")).join(firsts, "part")
    items = coded.join(before, ["part", "rest"]).withColumns({
        "rank": F.col("rank_before") + F.col("local_rank"),
        "first": F.lit(packs) + F.col("whole_before") + F.col("local_whole"),
        "n_whole": F.expr(f"doc_tokens div {capacity}"),
    })
    # a few thousand rows whatever the input: bounded by the capacity
    spots = F.broadcast(placed.select(F.col("length").alias("rest"), "rank_from", "rank_to", "inner", "size", "pack_from", "pack_offset"))
    hit = items.join(spots, (items["rest"] == spots["rest"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")), "left").drop(spots["rest"])
    own = F.when(
        F.coalesce(F.col("inner"), F.lit(0)) == 0,
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_whole") - 1, F.lit(0))), lambda i: F.struct(
            (i * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"),
            (F.col("first") + i).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))),
    )
    rest = F.array(F.struct(
        (F.col("n_whole") * capacity + F.col("inner")).cast("long").alias("start"), F.col("size").cast("long").alias("length"),
        (F.col("pack_from") + F.col("rank") - F.col("rank_from")).cast("long").alias("sequence_id"), F.col("pack_offset").cast("long").alias("offset")))
    none = F.array().cast("array<struct<start:long,length:long,sequence_id:long,offset:long>>")
    pieces = F.concat(F.when(F.col("n_whole") > 0, F.coalesce(own, none)).otherwise(none), F.when(F.col("size").isNotNull(), rest).otherwise(none))
    return hit.select("doc_id", "ids", "width", "doc_tokens", F.explode(pieces).alias("p")).select(
        "doc_id", "p.start", "p.length",
        F.expr("substring(ids, cast(p.start * width + 1 as int), cast(p.length * width as int))").alias("ids"),
        "width", "doc_tokens", "p.sequence_id", "p.offset",
    )


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids as unsigned 32-bit little-endian numbers in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(b, np.uint16 if w == 2 else np.uint32).astype("<u4").tobytes()) for b, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
            columns = {n: batch.column(n) for n in ("doc_id", "start", "length")} | {"ids_crc32": pa.array(sums, pa.int64())} | {n: batch.column(n) for n in ("doc_tokens", "sequence_id", "offset")}
            yield pa.RecordBatch.from_pydict(columns)

    return pieces.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
