"""Log probability of texts: prediction by partial matching over bytes, and an add-one word model beside it.

The byte model is a trie of contexts of up to ``ORDER`` bytes, counted over all training texts (lower-cased A-Z, a byte
0xFF, which UTF-8 never has, before and after each). In a context with total T and D distinct next bytes, a byte seen c
times has (c - 1/2) / T, and the escape D / 2T goes to the next shorter context, whose seen bytes are excluded: their
mass in the shorter context is divided out. Below the empty context all 256 bytes are alike. Because exclusion depends
on the context alone, each entry and each escape is one stored number, and a text is scored by looking up whole arrays.

The whole trie is kept, as a table dealt out by the last two bytes of the context, so that a context of two bytes or more
lies in one range with all that follows it and with its longer forms. Contexts of fewer bytes have 65,792 entries at most
and go to every range. The distinct keys of a run of documents go to their ranges and return with their log probability.

Both counts are distributed: tasks count 64-bit keys in arrays, and arrays are dealt out by hash range and merged there,
so that a shuffle moves blocks of numbers, not rows of words. Counts of words and log
probabilities of bytes return to the runs of documents they came from.

Defined results: a null or empty text has one token, the end; without training rows N = V = 0 and every token has
log10 1; repeated rows are learned and scored as often as they occur; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_array, ids_of, in_fold, mix64, runs, stored

ORDER = 5
_END = np.uint64(0x5EED0F7E17)  # stands for the end token among word hashes
_TAG = np.uint64(56)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text closed by the end token, and the number of tokens of each."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    size = end - begin
    h = mix64(size.astype(np.uint64))
    rest = np.arange(len(begin))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    k = 0
    while len(rest):  # eight bytes of every word at a time
        at = begin[rest] + k
        word = np.zeros(len(rest), np.uint64)
        for j in range(8):
            inside = at + j < end[rest]
            word |= np.where(inside, padded[np.minimum(at + j, len(padded) - 1)], 0).astype(np.uint64) << np.uint64(8 * j)
        h[rest] = mix64(h[rest] * np.uint64(0x9E3779B97F4A7C15) + word)
        k += 8
        rest = rest[size[rest] > k]
    ends = np.cumsum([len(t) + 1 for t in texts])  # of the texts in the buffer
    counts = np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))
    out = np.full(len(h) + len(texts), _END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts)] = h
    return out, counts + 1


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and the end of each text: the key of the byte and the ORDER bytes before it; numbers per text."""
    pad = b"\xff" * ORDER
    raw = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keys = np.zeros(max(len(raw) - ORDER, 0), np.uint64)
    for j in range(ORDER + 1):
        keys = keys << np.uint64(8) | raw[j : len(raw) - ORDER + j]
    ends = np.cumsum(sizes + ORDER)  # the first ORDER windows after a text's end straddle the next pad
    keep = np.ones(len(keys), bool)
    for e in range(ORDER):
        at = ends[:-1] + e - ORDER
        keep[at] = False
    return keys[keep], sizes


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _pack(a: np.ndarray, rising: bool = False, level: int = 1) -> bytes:
    """Compressed numbers, byte planes apart; of rising ones the steps."""
    a = np.diff(a, prepend=a.dtype.type(0)) if rising else a
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True) if raw else b"")


def _unpack(blob: bytes, kind: type, rising: bool = False) -> np.ndarray:
    size, item = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b""
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(item, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys with the bytes of the context the other way round, the nearest first; turned twice they are as before."""
    out = np.zeros(len(keys), np.uint64)
    for j in range(1, ORDER + 1):
        out = out << np.uint64(8) | keys >> np.uint64(8 * j) & np.uint64(255)
    return out << np.uint64(8) | keys & np.uint64(255)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Compressed keys of bytes in context. Turned they must rise: those of a range share their nearest bytes, so steps are short."""
    return _pack(_turned(keys), True)


def _unpack_keys(blob: bytes) -> np.ndarray:
    return _turned(_unpack(blob, np.uint64, True))


def _pack_repeated(a: np.ndarray) -> bytes:
    """Compressed floats of which many are equal: the values that occur and their numbers."""
    values, at = np.unique(a, return_inverse=True)
    head = _pack(values.view(np.uint32), True)
    return len(head).to_bytes(8, "little") + head + _pack(at.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32))


def _unpack_repeated(blob: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(blob[:8], "little")
    values = _unpack(blob[8:end], np.uint32, True).view(np.float32)
    return values[_unpack(blob[end:], np.uint16 if len(values) <= 1 << 16 else np.uint32)]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.unique(keys, return_counts=True)
    return k, c.astype(np.int64)


def _gram_range(keys: np.ndarray, n: int) -> np.ndarray:
    """By the last two bytes of the context: all bytes that follow it, and all longer contexts, lie together."""
    return (mix64(keys >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(n)).astype(np.int64)


RUN = "kind int, run long, range int, keys binary, counts binary, texts binary"
NAMES = ["kind", "run", "range", "keys", "counts", "texts"]


def _gather(ranges: int, mod: int, held: int, run_size: int):
    """Per run: its words with their training counts by range (kind 0), its documents' texts (kind 1), and its distinct keys of bytes in context by range (kind 3); per task: such keys with
    training counts by range (kind 2)."""

    def by_range(kind: int, run: int, keys: np.ndarray, counts: np.ndarray, rng: np.ndarray) -> pa.RecordBatch:
        cut = np.searchsorted(rng, np.arange(ranges + 1))
        n = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), kind, np.int32)), pa.array(np.full(len(n), run, np.int64)), pa.array(n.astype(np.int32)),
             pa.array([_pack_keys(keys[cut[i] : cut[i + 1]]) if kind else _pack(keys[cut[i] : cut[i + 1]], True) for i in n], pa.binary()), pa.array([_pack(counts[cut[i] : cut[i + 1]]) if len(counts) else b"" for i in n], pa.binary()), pa.nulls(len(n), pa.binary())],
            names=NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 32
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held_grams = 0
        for batch in batches:
            for start, texts in runs(batch, "text", run_size):
                run += 1
                ids = ids_of(batch, start, len(texts))
                train = np.array([i != NO_ID and zlib.crc32(b"%d" % i) % mod != held for i in ids.tolist()])
                raw = [_bytes(t) for t in texts]
                hashes, sizes = word_hashes(raw)
                words, at = np.unique(hashes, return_inverse=True)
                counts = np.bincount(at, np.repeat(train, sizes), len(words)).astype(np.uint32)
                yield by_range(0, run, words, counts, _word_range(words, ranges))
                lengths = np.array([len(t) for t in raw], np.uint32)
                head = np.concatenate([ids.astype(np.int64).view(np.uint32), lengths])
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([run], pa.int64()), pa.array([-1], pa.int32()), pa.array([head.tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([_pack(np.frombuffer(b"".join(raw), np.uint8), level=9)], pa.binary())], names=NAMES)
                keys, sizes = gram_keys(raw)
                learned = np.repeat(train, sizes)
                own = _counted(keys[learned])
                wanted = np.union1d(own[0], keys[~learned])
                order, rng = _range_order(wanted, ranges)
                yield by_range(3, run, wanted[order], np.zeros(0, np.uint8), rng)
                if train.any():
                    grams.append(own)
                    held_grams += len(own[0])
                if held_grams > 3_000_000:
                    grams = [_merge(*map(list, zip(*grams)))]
                    held_grams = len(grams[0][0])
                    if held_grams > 2_000_000:
                        yield spread(grams[0])
                        grams, held_grams = [], 0
        if grams:
            yield spread(_merge(*map(list, zip(*grams))))

    def spread(table: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        keys, counts = table
        order, rng = _range_order(keys, ranges)
        return by_range(2, -1, keys[order], counts[order].astype(np.uint32), rng)

    return work


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of some ranges: total counts, sent back block by block; and N and V of the ranges (run -1)."""
    blocks = [b for batch in batches for b in zip(*(batch.column(n).to_pylist() for n in ("run", "range", "keys", "counts")))]
    for rng in sorted({b[1] for b in blocks}):
        own = [b for b in blocks if b[1] == rng]
        keys = [_unpack(b[2], np.uint64, True) for b in own]
        total, count = _merge(keys, [_unpack(b[3], np.uint32).astype(np.int64) for b in own])
        out = [_pack(count[np.searchsorted(total, k)]) for k in keys]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in own] + [-1], pa.int64()), pa.array([rng] * (len(own) + 1), pa.int32()), pa.array(out + [b""], pa.binary()),
             pa.array([0] * len(own) + [int(count.sum())], pa.int64()), pa.array([0] * len(own) + [int((count > 0).sum())], pa.int64())],
            names=["run", "range", "counts", "n", "v"])


def _word_range(words: np.ndarray, ranges: int) -> np.ndarray:
    """Stretches of equal size: rising words have rising ranges."""
    return ((words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _range_order(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by range and then turned, and the ranges in that order."""
    order = np.argsort(_turned(keys))
    rng = _gram_range(keys, ranges)[order]
    by_range = np.argsort(rng, kind="stable")
    return order[by_range], rng[by_range]


def _answer(short: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Blocks in order of range, in each those of the trie (kind 2) first: log10 of the keys of every other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, model, keys, counts, held = None, None, [], [], 0
        for batch in batches:
            for kind, run, at, k, c in zip(batch.column("kind").to_pylist(), batch.column("run").to_pylist(), batch.column("range").to_pylist(), batch.column("keys"), batch.column("counts")):
                if at != rng:
                    rng, model, keys, counts, held = at, None, [], [], 0
                k = _unpack_keys(k.as_py())
                if kind == 2:
                    keys.append(k)
                    counts.append(_unpack(c.as_py(), np.uint32).astype(np.int64))
                    held += len(k)
                    if held > 8_000_000:
                        merged = _merge(keys, counts)
                        keys, counts, held = [merged[0]], [merged[1]], 0
                    continue
                if model is None:
                    k_all, c_all = _merge(keys, counts)
                    tables, keys, counts = dict(short), [], []
                    for order in range(ORDER, 1, -1):
                        k_all, c_all = _merge([k_all & np.uint64((1 << 8 * (order + 1)) - 1)], [c_all])
                        tables[order] = (k_all, c_all)
                    model = ByteModel(tables)
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([at], pa.int32()), pa.array([_pack_repeated(model.log10(k).astype(np.float32))], pa.binary())], names=["run", "range", "logs"])

    return run


class HashTable:
    """Positions of 64-bit keys, looked up by arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([keys, np.zeros(1, np.uint64)])
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]  # the last of several wins
            lost = self.slots[at] != rest
            at, rest = (at[lost] + 1) & (len(self.slots) - 1), rest[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys ^ keys >> np.uint64(29)
        return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where absent."""
        at = self._slot(q)
        out = self.slots[at]
        rest = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        while len(rest):
            at_rest = (at[rest] + 1) & (len(self.slots) - 1)
            at[rest] = at_rest
            found = self.slots[at_rest]
            out[rest] = found
            rest = rest[(found >= 0) & (self.keys[found] != q[rest])]
        return out


class ByteModel:
    """Entries ``(order, key) -> log10 p`` and contexts ``(order, context) -> log10 of what escape multiplies``."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        keys, logs, contexts, escapes = [], [], [], []
        lower_k, lower_p = np.zeros(0, np.uint64), np.zeros(0)
        for order in range(ORDER + 1):
            k, c = tables.get(order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            if not len(k):
                break
            context, group = np.unique(k >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(group, c), np.bincount(group)
            p = (c - 0.5) / total[group]
            below = np.full(len(k), 1 / 256) if order == 0 else lower_p[np.searchsorted(lower_k, k & np.uint64((1 << 8 * order) - 1))]
            left = np.maximum(1 - np.bincount(group, below), 1e-9)
            keys.append(k | np.uint64(order + 1) << _TAG)
            logs.append(np.log10(p))
            contexts.append(context | np.uint64(order + 1) << _TAG)
            escapes.append(np.log10(0.5 * distinct / total / left))
            lower_k, lower_p = k, p
        self.entries, self.log = HashTable(np.concatenate([np.zeros(0, np.uint64), *keys])), np.concatenate([np.zeros(0), *logs]).astype(np.float32)
        self.contexts, self.escape = HashTable(np.concatenate([np.zeros(0, np.uint64), *contexts])), np.concatenate([np.zeros(0), *escapes]).astype(np.float32)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        rest, q = np.arange(len(keys)), keys
        for order in range(ORDER, -1, -1):
            q = q & np.uint64((1 << 8 * (order + 1)) - 1)
            tag = np.uint64(order + 1) << _TAG
            at = self.entries.find(q | tag)
            hit = at >= 0
            out[rest[hit]] += self.log[at[hit]]
            miss = ~hit
            rest, q = rest[miss], q[miss]
            up = self.contexts.find(q >> np.uint64(8) | tag)
            known = up >= 0
            out[rest[known]] += self.escape[up[known]]
        out[rest] += -np.log10(256)
        return out


def _short(grams: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of contexts of one and no byte: 65,792 entries at most."""
    two = grams.mapInArrow(_byte_pairs, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).toPandas()
    k, c = two["key"].to_numpy().astype(np.uint64), two["count"].to_numpy().astype(np.int64)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for order in (1, 0):
        k, c = _merge([k & np.uint64((1 << 8 * (order + 1)) - 1)], [c])
        tables[order] = (k, c)
    return tables


def _byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for k, c in zip(batch.column("keys"), batch.column("counts")):
            np.add.at(total, (_unpack_keys(k.as_py()) & np.uint64(0xFFFF)).astype(np.int64), _unpack(c.as_py(), np.uint32).astype(np.int64))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["key", "count"])


def _sums(ranges: int):
    """A run's documents with the counts of its words and the logs of its keys, both in order of range: tokens, known
    tokens, sum of log10(c + 1), log10 of the byte model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, raw, counts, logs = (batch.column(n)[i] for n in ("docs", "texts", "counts", "logs"))
                head = np.frombuffer(docs.as_buffer(), np.uint32)
                n = len(head) // 3
                ids, lengths, raw = head[: 2 * n].view(np.int64), head[2 * n :].tolist(), _unpack(raw.as_py(), np.uint8).tobytes()
                ends = np.cumsum(head[2 * n :].astype(np.int64)).tolist()
                texts = [raw[end - size : end] for end, size in zip(ends, lengths)]
                hashes, sizes = word_hashes(texts)
                words, at = np.unique(hashes, return_inverse=True)
                c = np.concatenate([_unpack(x["counts"], np.int64) for x in sorted(counts.as_py(), key=lambda x: x["range"])])
                first = np.cumsum(sizes) - sizes
                keys, grams = gram_keys(texts)
                keys, place = np.unique(keys, return_inverse=True)
                found = np.empty(len(keys))
                found[_range_order(keys, ranges)[0]] = np.concatenate([_unpack_repeated(x["logs"]) for x in sorted(logs.as_py(), key=lambda x: x["range"])])
                yield pa.RecordBatch.from_arrays(
                    [id_array(ids), pa.array(sizes), pa.array(np.add.reduceat((c > 0)[at].astype(np.int64), first)), pa.array(np.add.reduceat(np.log10(c + 1.0)[at], first)),
                     pa.array(np.add.reduceat(found[place], np.cumsum(grams) - grams))],
                    names=["doc_id", "n_tokens", "n_known", "logs", "score"])

    return run


def language_scores(docs: DataFrame, mod: int = 7, held: int = 2, run_size: int = 2_000_000) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``."""
    spark = docs.sparkSession
    ranges = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gathered = stored(named.mapInArrow(_gather(ranges, mod, held, run_size), RUN), "gathered")
    words = stored(gathered.where("kind = 0").select("run", "range", "keys", "counts").repartition(ranges, "range").mapInArrow(_merge_words, "run long, range int, counts binary, n long, v long"), "words")
    n, v = words.where("run = -1").select(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    short = _short(gathered.where("kind = 2").select("keys", "counts"))
    grams = gathered.where("kind in (2, 3)").select("kind", "run", "range", "keys", "counts").repartition(ranges, "range").sortWithinPartitions("range", "kind")
    answers = grams.mapInArrow(_answer(short), "run long, range int, logs binary")
    # the blocks of a run are bounded by its size
    counts = words.where("run >= 0").groupBy("run").agg(F.collect_list(F.struct("range", "counts")).alias("counts"))
    logs = answers.groupBy("run").agg(F.collect_list(F.struct("range", "logs")).alias("logs"))
    rows = gathered.where("kind = 1").select("run", F.col("keys").alias("docs"), "texts").join(counts, "run").join(logs, "run").select("docs", "texts", "counts", "logs").mapInArrow(
        _sums(ranges), "doc_id long, n_tokens long, n_known long, logs double, score double")
    return rows.select(
        "doc_id", in_fold("doc_id", mod, held).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score")
