"""Token ids in files of patched frame-of-reference blocks, in ascending order of doc_id.

A file (one row ``(part, first_doc, local_start, n_docs, n_ids, content)`` of a Parquet table, because only Spark's
writers reach a cluster's shared storage) holds whole documents:

    magic "PFOR1", then little-endian: n_docs u4, n_ids u4, n_blocks u4, n_exceptions u4
    doc_id i8 x n_docs, tokens per document u4 x n_docs
    per block of 256 ids: minimum u4, width u1, exceptions u2, index of its first packed word u4
    packed words u4; positions of the exceptions in their block u1; values of the exceptions u4

Each block stores ``id - minimum`` in ``width`` bits, where ``width`` suffices for ``percentile`` of the block's
values; larger values are exceptions, stored whole. A block has 8 lanes of 32 values; lane j holds values j, j + 8, ...
in ``width`` words. The last block is filled up with its last id. ``decode_range`` reads any range of ids from the
blocks that hold it, by their indexed starts.

Defined results: a null or empty text has one id (the end id); repeated rows are written as often as they occur;
an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_array, ids_of, runs, stored
from .tokens import encoder, vocabulary_path

BLOCK, LANES, MAGIC = 256, 8, b"PFOR1"
FILE_SCHEMA = "part int, first_doc long, local_start long, n_docs int, n_ids int, content binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 256) numbers under 2**width -> (blocks, width * 8) words."""
    v = values.reshape(len(values), 32, LANES)
    words = np.zeros((len(values), max(width, 1), LANES), np.uint32)
    for k in range(32 if width else 0):
        word, shift = divmod(k * width, 32)
        words[:, word] |= v[:, k] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= v[:, k] >> np.uint32(32 - shift)
    return words[:, :width].reshape(len(values), width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), width, LANES)
    out = np.zeros((len(words), 32, LANES), np.uint32)
    mask = np.uint32(0xFFFFFFFF >> (32 - width)) if width else np.uint32(0)
    for k in range(32 if width else 0):
        word, shift = divmod(k * width, 32)
        x = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | w[:, word + 1] << np.uint32(32 - shift)
        out[:, k] = x & mask
    return out.reshape(len(words), BLOCK)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each number."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.95) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    v = np.concatenate([ids, np.full(n_blocks * BLOCK - len(ids), ids[-1] if len(ids) else 0, np.uint32)]).astype(np.uint32).reshape(n_blocks, BLOCK)
    low = v.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    d = v - low[:, None]
    k = min(BLOCK - 1, int(percentile * BLOCK))
    width = _bits(np.partition(d, k, axis=1)[:, k]) if n_blocks else np.zeros(0, np.int64)
    out = (d >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0) & (width < 32)[:, None]
    where_block, where = np.nonzero(out)
    values = d[where_block, where]
    d[out] = 0
    starts = np.concatenate([[0], np.cumsum(width * LANES)]).astype(np.int64)
    words = np.zeros(int(starts[-1]), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        words[(starts[rows][:, None] + np.arange(w * LANES)).ravel()] = _pack(d[rows], int(w)).ravel()
    table = np.zeros(n_blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u4")]))
    table["low"], table["width"], table["exceptions"], table["start"] = low, width, np.bincount(where_block, minlength=n_blocks), starts[:-1]
    return b"".join([
        MAGIC, struct.pack("<4I", len(doc_ids), len(ids), n_blocks, len(values)), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
        table.tobytes(), words.astype("<u4").tobytes(), where.astype(np.uint8).tobytes(), values.astype("<u4").tobytes(),
    ])


class TokenFile:
    """Reads a file made by ``encode_file``."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, n_blocks, n_out = struct.unpack_from("<4I", content, len(MAGIC))
        at = len(MAGIC) + 16

        def take(dtype, n):
            nonlocal at
            x = np.frombuffer(content, dtype, n, at)
            at += x.nbytes
            return x

        self.doc_ids, self.lengths = take("<i8", n_docs), take("<u4", n_docs).astype(np.int64)
        self.blocks = take(np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u4")]), n_blocks)
        self.words = take("<u4", int((self.blocks["width"].astype(np.int64) * LANES).sum()))
        self.where, self.values = take("u1", n_out), take("<u4", n_out)
        if at != len(content):
            raise ValueError("token file has a wrong size")
        self.first_exception = np.concatenate([[0], np.cumsum(self.blocks["exceptions"].astype(np.int64))])

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        a, b = start // BLOCK, -(-stop // BLOCK)
        blocks = self.blocks[a:b]
        out = np.zeros((b - a, BLOCK), np.uint32)
        for w in np.unique(blocks["width"]):
            rows = np.flatnonzero(blocks["width"] == w)
            at = blocks["start"][rows].astype(np.int64)[:, None] + np.arange(int(w) * LANES)
            out[rows] = _unpack(self.words[at.ravel()].reshape(len(rows), -1), int(w))
        x, y = self.first_exception[a], self.first_exception[b]
        out[np.repeat(np.arange(b - a), blocks["exceptions"]), self.where[x:y]] = self.values[x:y]
        out += blocks["low"][:, None]
        return out.ravel()[start - a * BLOCK : stop - a * BLOCK]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        ids, at = self.decode_range(0, self.n_ids), 0
        for doc, n in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            yield doc, ids[at : at + n]
            at += n


def _write(path: str, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, sizes, ids, held, done
            d, n, i = np.concatenate(docs), np.concatenate(sizes), np.concatenate(ids)
            row = [[part], [int(d[0])], [done], [len(d)], [len(i)], [encode_file(d, n, i)]]
            done, docs, sizes, ids, held = done + len(i), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "first_doc", "local_start", "n_docs", "n_ids", "content"])

        for batch in batches:
            for start, texts in runs(batch, "text"):
                i, n = encoder(path, False).encode(texts, end)
                docs.append(ids_of(batch, start, len(texts)))
                sizes.append(n)
                ids.append(i)
                held += len(i)
                if held >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str | None = None, end: int = 1, file_ids: int = 1_000_000) -> DataFrame:
    """Encode all documents and write the files; returns the table of files, ordered by part and local_start."""
    path = path or vocabulary_path("word_bpe_49k.json")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(_write(path, end, file_ids), FILE_SCHEMA), "tokenfiles", "uncompressed")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: ``(doc_id, start, n_tokens, ids_crc32)``; start counts all ids before it."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip((batch.column("first").to_numpy(zero_copy_only=False)).tolist(), batch.column("content")):
                file = TokenFile(content.as_py())
                starts = at + np.cumsum(file.lengths) - file.lengths
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in file.documents()]
                yield pa.RecordBatch.from_arrays(
                    [id_array(file.doc_ids), pa.array(starts), pa.array(file.lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    # one row per write partition
    rows = files.join(F.broadcast(sums), "part").select((F.col("before") + F.col("local_start")).alias("first"), "content")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
