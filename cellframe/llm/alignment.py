"""Two tokenizers' ids of the same bytes, aligned once per distinct text.

Documents are shuffled by their full text, so copies meet whatever their number (they combine before the shuffle), and
each distinct text is tokenised and aligned once. What its id pairs count is weighted by the number of its documents;
its measures return to the documents by a join on the text's sha256.

Both tokenizers begin a token at a space that follows a character other than white space, so a text is the sum of its
pieces between such spaces, and pieces repeat: each is aligned once per worker while the cache holds it; a full cache forgets
those met only once. A text with a piece that the two tokenizers do not give back byte by byte goes through them whole.

Pair counts are needed by every text and are never sent whole to anyone. Texts are gathered into runs of bounded size; a run
asks for the counts of its own distinct pairs, gets them by a join, and hands them to its texts.

Defined results: a text that is null, empty or not given back by one of the tokenizers has no tokens (zeros and an
empty digest); very long texts are a run of their own; repeated rows are documents of their own and count as such; a
null doc_id stays a row; an empty table gives no rows; other columns are not looked at. Copies are told by whole texts;
measures find their documents by sha256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, stored
from .tokens import _BYTES, _PLAIN, give_back, one_thread, vocabulary_path

PAIR = 15  # bits of the second id in a pair code; vocabularies of at most 2**16 and 2**15 ids
_CUT = re.compile(r"(?<=\S) ")
_SPACE_AFTER_SPACE = re.compile(r"\s ")


class Aligner:
    """Ids of both tokenizers, groups of tokens between common byte offsets, and links of overlapping tokens."""

    AT_ONCE = 4096  # what the libraries say beside the ids is large

    def __init__(self, path_a: str, path_b: str, limit: int = 150_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = {chr(b): b for b in _PLAIN} | {chr(c): b for b, c in _BYTES.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << PAIR:
            raise ValueError("vocabularies too large for a pair code")
        self.a_size, self.b_size = (np.array([len(x) for x in names], np.int64) for names in (self.a_bytes, self.b_bytes))
        #: An id followed by a comma, or by the mark that ends its side of a group.
        self.marks = [b"%d%s" % (i, m) for names, end in ((self.a_bytes, b"|"), (self.b_bytes, b";")) for i in range(len(names)) for m in (b",", end)]
        self.space = self.b.piece_to_id("▁")
        self.limit = limit
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of a, of b, groups, links; all 0 where bytes differ
        self.written: list[bytes] = []
        self.links, self.starts, self.met = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces met most often, of those met more than once, up to half of either bound."""
        keep = np.flatnonzero(self.met > 1)
        keep = keep[np.argsort(-self.met[keep], kind="stable")][: self.limit // 2]
        keep = np.sort(keep[np.cumsum(np.diff(self.starts)[keep]) <= 10 * self.limit])
        sizes = np.diff(self.starts)[keep]
        self.links = self._gather(keep, sizes)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.numbers, self.met = self.numbers[keep], self.met[keep]
        pieces = list(self.index)
        self.index = {pieces[k]: n for n, k in enumerate(keep.tolist())}
        self.written = [self.written[k] for k in keep.tolist()]

    def _gather(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Links of the pieces with these numbers, one piece after another."""
        return self.links[np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def _aligned(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Numbers, groups as text, numbers of links and links of texts that each follow a space.

        The texts' bytes are laid end to end. Between two neighbouring ends of tokens of either kind lies exactly one
        token of each, so every such stretch is one link; ends that both kinds have close a group.
        """
        ids_a = [c.ids for c in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = [b if t else [self.space] for t, b in zip(texts, self.b.encode(texts, num_threads=1))]
        size = np.array([len(t.encode()) + 1 for t in texts], np.int64)
        sound = np.array([self._same(t, a, b) for t, a, b in zip(texts, ids_a, ids_b)])
        for i in np.flatnonzero(~sound).tolist():
            ids_a[i], ids_b[i], size[i] = [], [], 0
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        end_a, end_b, end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(size)
        close = np.intersect1d(end_a, end_b, assume_unique=True)
        stretch = np.union1d(end_a, end_b)
        links = a[np.searchsorted(end_a, stretch)] << PAIR | b[np.searchsorted(end_b, stretch)]
        groups, n_links = (np.diff(np.searchsorted(x, end, side="right"), prepend=0) for x in (close, stretch))
        # written out group by group, first the ids of a and then those of b; the last of each carries another mark
        group = np.concatenate([np.searchsorted(close, end_a) * 2, np.searchsorted(close, end_b) * 2 + 1])
        last = np.concatenate([np.isin(end_a, close, assume_unique=True), np.isin(end_b, close, assume_unique=True)])
        order = np.argsort(group, kind="stable")
        code = (np.concatenate([a, b + len(self.a_bytes)]) * 2 + last)[order].tolist()
        parts = [self.marks[c] for c in code]
        stops = np.cumsum(n_a + n_b).tolist()
        written = [b"".join(parts[s:e])[:-1] for s, e in zip([0, *stops], stops)]
        return np.stack([n_a, n_b, groups, n_links], axis=1), written, n_links, links

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both give back space + text."""
        return b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]) == b" " + text.encode()

    def _lookup(self, parts: list[str]) -> np.ndarray:
        fresh = [p for p in dict.fromkeys(parts) if p not in self.index]
        if fresh:
            numbers, written, sizes, links = zip(*(self._aligned(fresh[k : k + self.AT_ONCE]) for k in range(0, len(fresh), self.AT_ONCE)))
            self.index.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh))))
            self.numbers = np.concatenate([self.numbers, *numbers])
            self.written += chain.from_iterable(written)
            self.links = np.concatenate([self.links, *(x.astype(np.int32) for x in links)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
        at = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        self.met += np.bincount(at, minlength=len(self.met))
        return at

    def measure(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that are not empty: numbers and digests, and the distinct links of each as (text, pair code, occurrences), sorted."""
        if len(self.index) > self.limit or len(self.links) > 20 * self.limit:
            self._forget()
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text[0] == " " or _SPACE_AFTER_SPACE.search(text):
                cut = _CUT.split(" " + text)
                cut[0] = cut[0][1:]
            else:
                cut = text.split(" ")
            parts += cut
            counts[i] = len(cut)
        at = self._lookup(parts)
        ends = np.cumsum(counts)
        numbers = np.add.reduceat(self.numbers[at], ends - counts, axis=0)
        broken = np.add.reduceat(self.numbers[at, 0] == 0, ends - counts) > 0
        digests = []
        for s, e, b in zip((ends - counts).tolist(), ends.tolist(), broken.tolist()):
            digests.append("" if b else hashlib.sha256(b";".join([self.written[k] for k in at[s:e].tolist()])).hexdigest())
        of = np.repeat(np.arange(len(texts)), counts)
        sound = ~broken[of]
        at, of = at[sound], of[sound]
        size = self.starts[at + 1] - self.starts[at]
        codes = [np.repeat(of << 32, size) | self._gather(at, size)]
        for i in np.flatnonzero(broken).tolist():  # whole, as no piece may be told from its neighbours
            row, written, _, own = self._aligned([texts[i]])
            numbers[i] = row[0]
            digests[i] = hashlib.sha256(written[0]).hexdigest() if row[0, 0] else ""
            codes.append(i << 32 | own)
        codes, times = np.unique(np.concatenate(codes), return_counts=True)
        return numbers, digests, codes >> 32, codes & 0xFFFFFFFF, times


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, kept between tasks."""
    one_thread()
    return Aligner(path_a, path_b)


TEXTS, ASKED = 1, 0
_MADE = "run long, kind int, sha binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>, weights array<long>"
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    starts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(values, kind))


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sum of the weights of each."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(weights[order], first) if len(first) else weights


def _align_texts(path_a: str, path_b: str, run_links: int):
    """From distinct texts and their numbers of documents to rows of texts, and per run the pairs it holds with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        pairs, merged, waiting, held = [], 0, 0, 0  # sums of slices, the first of them of the merged ones
        names = [f.split()[0] for f in _MADE.split(", ")]

        def asked() -> pa.RecordBatch:
            code, total = _summed(*map(np.concatenate, zip(*pairs)))
            one = [[number], [ASKED], None, None, None, None, None, None, [code], None, [total]]
            return pa.RecordBatch.from_arrays([pa.nulls(1, t) if v is None else pa.array(v, t) for v, t in zip(one, _KINDS)], names=names)

        for batch in batches:
            for start, texts in runs(batch, "text", 500_000):
                documents = batch.column("n").slice(start, len(texts)).to_numpy()
                numbers, digests, owner, codes, times = aligner.measure(texts)
                n = len(texts)
                shas = [hashlib.sha256(t.encode()).digest() for t in texts]
                columns = [np.full(n, number), np.full(n, TEXTS, np.int32), shas, *numbers.T, digests]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(columns, _KINDS)), _lists(codes, owner, n, pa.int32()), _lists(times, owner, n, pa.int32()), pa.nulls(n, _KINDS[-1])], names=names
                )
                pairs.append(_summed(codes.astype(np.int32), documents[owner]))
                waiting += len(pairs[-1][0])
                held += len(codes)
                if waiting > max(merged, 200_000):
                    pairs = [_summed(*map(np.concatenate, zip(*pairs)))]
                    merged, waiting = len(pairs[0][0]), 0
                if held > run_links:
                    yield asked()
                    number, pairs, merged, waiting, held = number + 1, [], 0, 0, 0
                give_back()
        if held:
            yield asked()

    return run


_MEASURES = "sha binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answer_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run, the counts of its pairs first, each run's by pair; gives the measures of its texts."""
    if _aligner.cache_info().currsize:  # not needed any more
        _aligner.cache_clear()
        give_back()
    run, known, pieces = None, None, []
    for batch in batches:
        number = batch.column("run").to_numpy()
        kind = batch.column("kind").to_numpy()
        cuts = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
            if s == e:
                continue
            if number[s] != run:
                run, known, pieces = number[s], None, []
            part = batch.slice(s, e - s)
            if kind[s] == ASKED:
                pieces.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")])
                continue
            if known is None:
                known = [np.concatenate(x) for x in zip(*pieces)] if pieces else [np.zeros(0, np.int64)] * 3
            lists = part.column("pairs")
            ends = np.diff(lists.offsets.to_numpy())
            where = np.searchsorted(known[0], lists.flatten().to_numpy())
            times = part.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(part)), ends)
            best, total = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            np.add.at(best, owner, times * known[2][where])
            np.add.at(total, owner, times * known[1][where])
            keep = [part.column(c) for c in ("sha", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(best), pa.array(total), part.column("groups_sha256")], names=[f.split()[0] for f in _MEASURES.split(", ")])


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, run_links: int = 3_000_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    ``run_links`` bounds what a run of texts holds before it asks for counts (one slice of half a million bytes more, or one text).
    """
    path_a, path_b = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    docs = docs.select(docs["doc_id"], docs["text"])
    distinct = docs.where(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    made = stored(distinct.mapInArrow(_align_texts(path_a, path_b, run_links), _MADE), "align-runs")

    asked = made.where(F.col("kind") == ASKED).select("run", F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select("run", F.col("p.pairs").alias("pair"), F.col("p.weights").alias("weight"))
    counts = asked.groupBy("pair").agg(F.sum("weight").alias("count"))
    # an id of the first vocabulary has at most as many rows here as the second has ids
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", PAIR)))
    counts = stored(counts.select("pair", "count", (F.col("count") == top).alias("best")), "align-counts")
    answers = asked.select("run", "pair").join(counts, "pair")

    texts = made.where(F.col("kind") == TEXTS).drop("weights").withColumns({"pair": F.lit(None).cast("int"), "count": F.lit(None).cast("long"), "best": F.lit(None).cast("boolean")})
    rows = texts.unionByName(answers.withColumn("kind", F.lit(ASKED)), allowMissingColumns=True)
    rows = rows.repartition("run").sortWithinPartitions("run", "kind", "pair")
    measures = stored(rows.mapInArrow(_answer_texts, _MEASURES), "align-texts")

    keyed = docs.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    joined = keyed.join(measures, "sha", "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
