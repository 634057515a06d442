"""The trie of conversation prefixes, its subtree totals by time-forward processing.

Conversations are rebuilt first (the head of one conversation of each block before the rest of another), then every
prefix of a rebuilt conversation is a node. A node is known by its smallest member and its depth: the nodes that belong
to one conversation lie one below the other, so ``(conv_id, depth)`` is unique and needs no text.

Totals flow from the leaves to the root. Nodes are dealt to shards of bounded size by ``(conv_id, depth)`` and sorted in
reverse level order by Spark's external sort; a task reads a shard once and hands each node's totals to its parent
through a priority queue that spills sorted runs. Where a parent lies in another shard, the piece of the trie below ends: its root's total
is a message across shards. The pieces form a small tree of their own, summed by pointer doubling in as many rounds as
the logarithm of its height. A second reading of the shards takes those messages in, added up by receiver, and gives all
nodes their totals.

No conversation, turn or prefix is ever gathered whole. Turns are ordered by range; a conversation that spans several
ranges gets offsets from their counts. Prefixes are chained sha256 hashes in blocks of positions: blocks are hashed side by side, and one
hash per block is carried on. Nodes are counts and minima, combined before the shuffle. Member lists come as
strings of 4,096 ids at most, and their sha256 is fed piece by piece.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or text is empty, and so is
an empty one; turns of equal number (null is one, before all others) are ordered by the sha256 of role and text, so the
order of rows never matters and repeated turns count twice; very long texts are hashed where they lie and not
shuffled; an empty table has no conversation and so no root; other columns are not looked at. Prefixes are told apart by 128 bits of
sha256: 10^10 prefixes meet by chance with odds of 10^-19.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 1024  # positions of a conversation that are chained in one go
SHARD_IDS, SHARD_DEPTH = 10, 12  # a shard spans 2**10 conv_ids and 2**12 levels: four million nodes at most
CHUNK = 12  # member lists come in pieces of 2**12 ids
WORD = r"[^\x20\x09-\x0D]+"


class SpillingQueue:
    """Smallest key first; beyond ``limit`` entries in memory, sorted runs go to unnamed files that vanish with the task."""

    ENTRY = struct.Struct("<qqqq")

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.heap: list[tuple[int, int, int, int]] = []
        self.runs: list[tuple[tuple[int, int, int, int], int]] = []  # next entry of each run
        self.files: list = []

    def push(self, entry: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            for e in sorted(self.heap):
                file.write(self.ENTRY.pack(*e))
            file.seek(0)
            self.heap = []
            self.files.append(file)
            self._advance(len(self.files) - 1)

    def _advance(self, run: int) -> None:
        data = self.files[run].read(self.ENTRY.size)
        if data:
            heapq.heappush(self.runs, (self.ENTRY.unpack(data), run))
        else:
            self.files[run].close()

    def pop(self, key: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """Takes out the values of all entries of this key, which no smaller key may precede."""
        while self.heap and self.heap[0][:2] == key:
            yield heapq.heappop(self.heap)[2:]
        while self.runs and self.runs[0][0][:2] == key:
            entry, run = heapq.heappop(self.runs)
            self._advance(run)
            yield entry[2:]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range a row lies in and its position among the rows of its conversation there."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        at = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        if ids[0] == last:
            at[: first[1] if len(first) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(at.astype(np.int64)), batch.column("said"), batch.column("words")],
            names=["conv_id", "part", "at", "said", "words"],
        )


def ordered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as ``conv_id, pos, said`` (sha256 of role and text) and ``words``; conversations as ``conv_id, n``."""
    role, text = F.coalesce(turns["role"].cast("string"), F.lit("")), F.coalesce(turns["text"].cast("string"), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].alias("turn"), said.alias("said"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "said", "row"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "said", "words")
    placed = stored(placed.mapInArrow(_positions, "conv_id long, part int, at long, said binary, words long"), "trie-turns")
    counts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one conversation of each range began in an earlier one, so this has no more rows than there are ranges
    later = counts.select("conv_id", "part", before.alias("skipped")).where("skipped > 0")
    placed = placed.join(F.broadcast(later), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("skipped", F.lit(0))).alias("pos"), "said", "words"), counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt_turns(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The first h turns of the block's first conversation, then a conversation's own after its first h.

    h is the unsigned crc32 of the decimal conv_id modulo ``most``. Gives turns as ``conv_id, depth`` (from 1), ``said``, ``words``
    and conversations as ``conv_id, length``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.select("conv_id", "n", base.alias("base"), h.alias("h")).join(sizes, "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "trie-convs")
    short = convs.where("lent < h").select("conv_id", (F.col("h") - F.col("lent")).alias("short"))
    own = turns.where(F.col("pos") >= h).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") + 1 - F.coalesce("short", F.lit(0))).alias("depth"), "said", "words")
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs.select("conv_id", "base", "h"), "base").where("pos < h")
    return own.unionByName(lent.select("conv_id", (F.col("pos") + 1).alias("depth"), "said", "words")), convs.select("conv_id", "length")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the hashes of a block's turns; needs rows sorted by conversation and depth."""
    sha = hashlib.sha256
    last, state = None, b""
    for batch in batches:
        links, befores = [], []
        for key, said in zip(zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist()), batch.column("said").to_pylist()):
            if key != last:
                last, state = key, b""
            befores.append(state)
            state = sha(state + said).digest()[:16]
            links.append(state)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "depth", "block", "words")), pa.array(links, pa.binary()), pa.array(befores, pa.binary())],
            names=["conv_id", "depth", "block", "words", "link", "up"],
        )


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the last link of each full block to the link carried into the next one."""
    last, carry = None, b""
    for batch in batches:
        out = []
        for conv, link in zip(batch.column("conv_id").to_pylist(), batch.column("link").to_pylist()):
            if conv != last:
                last, carry = conv, b""
            carry = hashlib.sha256(carry + link).digest()[:16] if carry else link
            out.append(carry)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(out, pa.binary())], names=["conv_id", "block", "carry"])


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per turn: ``conv_id, depth, words``, ``link`` (the prefix up to it) and ``up`` (the prefix before it)."""
    keys = ["conv_id", "block"]
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / block)).repartition(*keys).sortWithinPartitions(*keys, "depth")
    schema = "conv_id long, depth long, block long, words long, link binary, up binary"
    rows = stored(rows.select("conv_id", "depth", "block", "words", "said").mapInArrow(_chains, schema), "trie-chains")
    full = rows.where(F.col("depth") % block == 0).select("conv_id", "block", "link")
    carry = full.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_carried, "conv_id long, block long, carry binary")
    later = rows.where("block > 0").join(carry.select("conv_id", (F.col("block") + 1).alias("block"), "carry"), keys)

    def after(link: str) -> Column:
        return F.substring(F.unhex(F.sha2(F.concat("carry", link), 256)), 1, 16)

    later = later.select("conv_id", "depth", "words", after("link").alias("link"), F.when((F.col("depth") - 1) % block == 0, F.col("carry")).otherwise(after("up")).alias("up"))
    return rows.where("block = 0").select("conv_id", "depth", "words", "link", "up").unionByName(later)


def trie_nodes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes as ``conv_id, depth, parent, n_convs, own`` (tokens saved at the node itself) and pieces of the lists of conversations that end at them as ``conv_id, depth, piece, ids``."""
    nodes = rows.groupBy("depth", "link").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("up").alias("up"))
    nodes = stored(nodes, "trie-nodes")
    root = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("link"), "node", "n_convs")
    named = nodes.select("depth", "link", "node", "n_convs").unionByName(root)
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("link").alias("up"), F.col("node").alias("parent"))
    whole = nodes.join(parents, ["depth", "up"]).select(F.col("node").alias("conv_id"), "depth", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    top = root.select(F.col("node").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("own"))

    ends = rows.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("conv_id", "depth", "link")
    ends = ends.unionByName(convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("link")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "link", F.shiftright("conv_id", CHUNK).alias("piece")).agg(ids.alias("ids"))
    pieces = pieces.join(named.select("depth", "link", "node"), ["depth", "link"]).select(F.col("node").alias("conv_id"), "depth", "piece", "ids")
    return stored(whole.unionByName(top), "trie-tree"), pieces


MESSAGE, MEMBERS, NODE = 0, 1, 2
_COLUMNS = "conv_id long, depth long, kind int, piece long, parent long, n_convs long, children long, leaves long, saved long, ids string"
_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PIECES = "conv_id long, part long, root long, root_depth long, parent long, leaves long, saved long"


def _shard(conv, depth, ids: int, levels: int):
    return conv >> ids, depth >> levels


def _forward(ids: int, levels: int, limit: int, whole: bool):
    """Time-forward processing of the shards of a partition.

    ``whole``: gives the nodes with their totals. Otherwise gives, per run of nodes of one conversation in a shard, the root of the piece
    of the trie it lies in, and with each piece's root its totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue(limit)
        children = leaves = saved = 0
        members, listed = hashlib.sha256(), False
        heads: dict[int, tuple] = {}
        names = [f.split()[0] for f in (_RESULT if whole else _PIECES).split(", ")]
        kinds = [pa.int64()] * 7 + ([pa.string()] if whole else [])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        def pieces() -> list[tuple]:
            """Runs of the finished shard, the smallest conversation first: a parent is never a larger one."""
            roots, out = {}, []
            for conv in sorted(heads):
                depth, parent, own = heads[conv]
                within = parent is not None and _shard(parent, depth - 1, ids, levels) == shard
                roots[conv] = root = roots[parent] if within else (conv, depth)
                out.append((conv, shard[1], *root, *((None, None, None) if within else (parent, *own))))
            return out

        for batch in batches:
            out: list[tuple] = []
            for conv, depth, kind, _, parent, n_convs, more, below, tokens, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (here := _shard(conv, depth, ids, levels)) != shard:
                    if heads and not whole:
                        out += pieces()
                    shard, heads = here, {}
                if kind == MESSAGE:
                    children, leaves, saved = children + more, leaves + below, saved + tokens
                elif kind == MEMBERS:
                    members.update((("," if listed else "") + text).encode())
                    listed = True
                else:
                    for below, spared in queue.pop((-depth, conv)):
                        children, leaves, saved = children + 1, leaves + below, saved + spared
                    leaves, saved = leaves if children else 1, saved + tokens
                    if parent is not None and _shard(parent, depth - 1, ids, levels) == shard:
                        queue.push((1 - depth, parent, leaves, saved))
                    if whole:
                        out.append((conv, depth, parent, n_convs, children, leaves, saved, members.hexdigest()))
                    else:
                        heads[conv] = depth, parent, (leaves, saved)  # the last one seen is the highest
                    children = leaves = saved = 0
                    members, listed = hashlib.sha256(), False
            if out:
                yield table(out)
        if heads and not whole:
            yield table(pieces())

    return run


def subtree_totals(nodes: DataFrame, members: DataFrame, ids: int = SHARD_IDS, levels: int = SHARD_DEPTH, limit: int = 1_000_000, max_rounds: int = 64) -> DataFrame:
    """Nodes with the totals of their subtrees."""
    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    zero = F.lit(0).cast("long")
    shard = [F.shiftright("conv_id", ids), F.shiftright("depth", levels)]
    own = nodes.select("conv_id", "depth", F.lit(NODE).alias("kind"), zero.alias("piece"), "parent", "n_convs", zero.alias("children"), zero.alias("leaves"), F.col("own").alias("saved"), none("string").alias("ids"))

    def sent(messages: DataFrame) -> DataFrame:
        return messages.select("conv_id", "depth", F.lit(MESSAGE).alias("kind"), zero.alias("piece"), none("long").alias("parent"), none("long").alias("n_convs"), "children", "leaves", "saved", none("string").alias("ids"))

    def forward(rows: DataFrame, whole: bool, schema: str) -> DataFrame:
        order = [*shard, F.desc("depth"), "conv_id", "kind", "piece"]
        return rows.repartition(*shard).sortWithinPartitions(*order).mapInArrow(_forward(ids, levels, limit, whole), schema)

    apart = (F.shiftright("parent", ids) != shard[0]) | (F.shiftright(F.col("depth") - 1, levels) != shard[1])
    crossing = nodes.where(F.col("parent").isNotNull() & apart).select(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    crossing = crossing.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("children"), zero.alias("leaves"), zero.alias("saved"))
    runs = stored(forward(own.unionByName(sent(crossing)), False, _PIECES), "trie-runs")

    roots = runs.where("leaves IS NOT NULL").select("conv_id", F.col("root_depth").alias("depth"), "parent", "leaves", "saved")
    name = F.struct(F.col("root").alias("conv_id"), F.col("root_depth").alias("depth"))
    places = runs.select(F.col("conv_id").alias("parent"), F.col("part").alias("at"), name.alias("up"))
    pieces = roots.withColumn("at", F.shiftright(F.col("depth") - 1, levels)).join(places, ["parent", "at"], "left")
    pieces = stored(pieces.select(F.struct("conv_id", "depth").alias("id"), "parent", "up", "leaves", "saved"), "trie-pieces")
    sums = pieces.select("id", "up", "leaves", "saved")
    for _ in range(max_rounds):  # a piece knows the sums below it to twice the distance after each round
        moving = sums.where("up IS NOT NULL")
        if not moving.limit(1).count():
            break
        below = moving.groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("spared"))
        further = sums.select(F.col("id").alias("up"), F.col("up").alias("beyond"))
        added = sums.join(below, "id", "left").join(further, "up", "left")
        total = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "more"), ("saved", "spared"))]
        sums = stored(added.select("id", F.col("beyond").alias("up"), *total), "trie-sums")
    else:
        raise RuntimeError("the pieces of the trie do not form a tree")
    linked = pieces.where("up IS NOT NULL").select("id", F.col("parent").alias("conv_id"), (F.col("id.depth") - 1).alias("depth"))
    messages = linked.join(sums, "id").groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    listed = members.select("conv_id", "depth", F.lit(MEMBERS).alias("kind"), "piece", none("long").alias("parent"), none("long").alias("n_convs"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ids")
    return forward(own.unionByName(sent(messages)).unionByName(listed), True, _RESULT)


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4, block: int = BLOCK, **shards) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``every`` and ``most`` rule how conversations are rebuilt; ``shards`` goes to ``subtree_totals``.
    """
    turns, convs = rebuilt_turns(*ordered_turns(conversations), every, most)
    rows = stored(prefixes(turns, block), "trie-rows")
    nodes, members = trie_nodes(rows, convs)
    return subtree_totals(nodes, members, **shards)


def oracle_sql() -> str:
    """The same in DuckDB SQL, with whole prefixes as keys and every node joined with all nodes above it."""
    said = "concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))"
    # crc32 bit by bit: eight shifts a byte; 3988292384 is its reversed polynomial (fixed value)
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    digits = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))"
    h = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, b: {byte}), 4294967295) % 4"
    return rf"""WITH t AS (SELECT conv_id, coalesce(text, '') AS text, sha256({said}) AS said,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256({said})) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
        cv AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {h} AS h FROM t GROUP BY conv_id),
        k AS (SELECT cv.*, least(cv.h, coalesce(b.n, 0)) AS lent FROM cv LEFT JOIN cv b ON b.conv_id = cv.base),
        r AS (SELECT k.conv_id, pos + 1 AS depth, said, text FROM k JOIN t ON t.conv_id = k.base AND pos < h
          UNION ALL SELECT k.conv_id, pos - h + lent + 1, said, text FROM k JOIN t USING (conv_id) WHERE pos >= h),
        p AS (SELECT conv_id, depth, text, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS whole FROM r UNION ALL SELECT conv_id, 0, '', '' FROM cv),
        o AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, whole) AS node FROM p),
        n AS (SELECT node AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS own FROM o GROUP BY node, depth),
        w AS (SELECT n.*, up.node AS parent FROM n LEFT JOIN o up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
        below AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM w WHERE parent IS NOT NULL GROUP BY 1, 2),
        whole AS (SELECT a.node AS conv_id, a.depth, CAST(sum(w.own) AS BIGINT) AS saved_tokens, count(*) FILTER (b.n_children IS NULL) AS n_leaves
          FROM w LEFT JOIN below b ON b.conv_id = w.conv_id AND b.depth = w.depth JOIN o a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY 1, 2),
        ends AS (SELECT node AS conv_id, o.depth, string_agg(CAST(o.conv_id AS VARCHAR), ',' ORDER BY o.conv_id) AS ids
          FROM o JOIN (SELECT conv_id, max(depth) AS depth FROM o GROUP BY 1) l ON l.conv_id = o.conv_id AND l.depth = o.depth GROUP BY 1, 2)
        SELECT conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM w LEFT JOIN below USING (conv_id, depth) JOIN whole USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""
