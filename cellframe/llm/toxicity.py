"""Toxic texts by a factorization machine over hashed terms.

A text is the set of its terms: words of letters in lower case, and their first 4, 5 and 6 letters, so that inflected
forms share terms; each is hashed to 32 bits. From at most ``SAMPLE`` labelled rows of each label, in the order of a
hash, terms are kept whose log odds ratio between the labels is surely not zero (``SURE`` standard errors); the sure
part of the ratio is the value of the term. The machine adds to linear weights an inner product of two factors for each
pair of terms, computed as ((sum v x)^2 - sum (v x)^2) / 2, which rewards combinations that no single word reveals. It
is trained by Adam on logistic loss. Rows with equal terms count once in the sample.

Labels, languages, sources and ids are never inputs of a score.

Defined results: null and empty texts get the score of a text without terms; without labels of both kinds, or without
terms that tell them apart, every score is 0; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, in_fold, sample_rows
from .tokens import release_encoders

SAMPLE, FACTORS, EPOCHS, BATCH, SURE, LEAST = 4000, 6, 15, 128, 2.5, 4
_WORD = re.compile(r"[^\W\d_]+")


def _hashes(word: str) -> tuple[int, ...]:
    """Of the word and of its beginnings."""
    raw = [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]
    return tuple(zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in raw)


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms."""
    found = set(_WORD.findall((text or "").lower()))
    return np.unique(np.array([h for w in found for h in _hashes(w)], np.uint32))


def select_terms(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms that surely tell the labels apart, and the sure part of their log odds ratios."""
    every, inverse = np.unique(np.concatenate([np.zeros(0, np.uint32), *rows]), return_inverse=True)
    of = np.repeat(y, [len(r) for r in rows])
    p, n = np.bincount(inverse[of == 1], minlength=len(every)), np.bincount(inverse[of == 0], minlength=len(every))
    P, N = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    ratio = np.log((p + 0.5) / (P - p + 0.5)) - np.log((n + 0.5) / (N - n + 0.5))
    error = np.sqrt(1 / (p + 0.5) + 1 / (P - p + 0.5) + 1 / (n + 0.5) + 1 / (N - n + 0.5))
    sure = np.maximum(np.abs(ratio) - SURE * error, 0) * np.sign(ratio)
    keep = (sure != 0) & (p + n >= LEAST)
    return every[keep], sure[keep].astype(np.float32)


class FactorizationMachine:
    """w0 + w . x + sum over pairs of <v_i, v_j> x_i x_j; a row is a list of term numbers, ``value`` has each term's x."""

    def __init__(self, value: np.ndarray, factors: int = FACTORS, l2: float = 1e-3, rate: float = 0.02, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.value, n = value, len(value)
        self.w0, self.w, self.v = 0.0, np.full(n, 0.1, np.float32), rng.normal(0, 0.01, (n, factors)).astype(np.float32)
        self.l2, self.rate, self.seed = l2, rate, seed

    def _flat(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        return at, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), self.value[at]

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        at, row, xr = self._flat(rows)
        n = len(rows)
        linear = np.bincount(row, self.w[at] * xr, minlength=n)
        total = linear + self.w0
        for f in range(self.v.shape[1]):
            vx = self.v[at, f] * xr
            total += 0.5 * (np.bincount(row, vx, minlength=n) ** 2 - np.bincount(row, vx * vx, minlength=n))
        return total

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> "FactorizationMachine":
        rng = np.random.default_rng(self.seed)
        k = self.v.shape[1]
        theta = np.concatenate([self.w[:, None], self.v], axis=1)
        m, s, bias, t = np.zeros_like(theta), np.zeros_like(theta), np.zeros(2), 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                t += 1
                part = order[a : a + BATCH]
                at, row, xr = self._flat([rows[i] for i in part])
                n = len(part)
                vx = theta[at, 1:] * xr[:, None]
                sums = np.stack([np.bincount(row, vx[:, f], minlength=n) for f in range(k)], axis=1)
                squares = np.bincount(row, (vx * vx).sum(axis=1), minlength=n)
                out = self.w0 + np.bincount(row, theta[at, 0] * xr, minlength=n) + 0.5 * ((sums**2).sum(axis=1) - squares)
                e = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / n
                g = np.empty((len(at), k + 1), np.float32)
                g[:, 0] = e[row] * xr
                g[:, 1:] = (e[row] * xr)[:, None] * (sums[row] - vx)
                used, inverse = np.unique(at, return_inverse=True)
                grad = np.stack([np.bincount(inverse, g[:, f]) for f in range(k + 1)], axis=1).astype(np.float32) + self.l2 * theta[used] / max(1, len(rows) // BATCH)
                m[used] = 0.9 * m[used] + 0.1 * grad
                s[used] = 0.99 * s[used] + 0.01 * grad * grad
                theta[used] -= self.rate * m[used] / (np.sqrt(s[used]) + 1e-6)
                bias = 0.9 * bias + 0.1 * np.array([e.sum(), 0])
                self.w0 -= self.rate * bias[0] * 2
        self.w, self.v = theta[:, 0].copy(), theta[:, 1:].copy()
        return self


def _cut(raw: np.ndarray, y: np.ndarray) -> float:
    """Between the raw scores: where the sum of both error shares is least; the middle of that stretch."""
    order = np.sort(raw)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    good = np.searchsorted(np.sort(raw[y == 0]), cuts) / (y == 0).sum() + 1 - np.searchsorted(np.sort(raw[y == 1]), cuts) / (y == 1).sum()
    best = cuts[good >= good.max() - 1e-9]
    return float(np.median(best))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1):
    """The machine and the raw score at its cut, or None if nothing can be learned. Every fourth row of the sample sets the cut."""
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", folds) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    picked = [sample_rows(known.where(F.col("y") == y), SAMPLE, "doc_id") for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * SAMPLE rows at most

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([terms(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["doc_id", "y", "terms"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = named.join(picked, "doc_id").mapInArrow(hashed, "doc_id long, y int, terms binary").toPandas()
    sample = sample.sort_values("doc_id").drop_duplicates(["y", "terms"])
    y = sample["y"].to_numpy().astype(int)
    if len(np.unique(y)) < 2:
        return None
    rows = [np.frombuffer(bytes(r), np.uint32) for r in sample["terms"]]
    check = np.arange(len(rows)) % 4 == 0
    if min(np.bincount(y[check], minlength=2).min(), np.bincount(y[~check], minlength=2).min()) == 0:
        check[:] = False
    kept, value = select_terms([r for r, c in zip(rows, check) if not c], y[~check])

    if not len(kept):
        return None

    def numbers(row: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(kept, row, assume_unique=True))

    rows = [numbers(r) for r in rows]
    machine = FactorizationMachine(value).fit([r for r, c in zip(rows, check) if not c], y[~check])
    judged = check if check.any() else ~check
    return kept, machine, _cut(machine.raw([r for r, c in zip(rows, judged) if c]), y[judged])


class _Finder:
    """Numbers of the kept terms in a text; words met before are looked up."""

    def __init__(self, kept: np.ndarray, limit: int = 100_000):
        self.number, self.limit, self.seen = {h: i for i, h in enumerate(kept.tolist())}, limit, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            hit = self.seen.get(word)
            if hit is None:
                if len(self.seen) >= self.limit:
                    self.seen.clear()
                hit = self.seen[word] = tuple(self.number[h] for h in _hashes(word) if h in self.number)
            if hit:
                found.update(hit)
        return np.array(sorted(found), np.int64)


def _scorer(model, threshold: float):
    """Scores of texts from a model that ``train`` made."""
    kept, machine, cut = model
    weights = (machine.w0, machine.w, machine.v, machine.value)  # terms of the bounded sample only
    shift = log(threshold / (1 - threshold))
    made: list = []

    def score(texts: pa.Array) -> np.ndarray:
        if not made:
            fm = FactorizationMachine(weights[3])
            fm.w0, fm.w, fm.v, fm.value = weights
            made.extend([fm, _Finder(kept)])
        fm, find = made
        raw = fm.raw([find(t.as_py()) for t in texts])
        return 1 / (1 + np.exp(-np.clip(raw - cut + shift, -40, 40)))

    return score


def _rejecter(model, threshold: float):
    """Batches without the rows that score ``threshold`` or more."""
    score = _scorer(model, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield part.filter(pa.array(score(part.column("text")) < threshold))

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; rows of the held fold are never learned from."""
    model = train(docs, labels, folds, held)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = in_fold("doc_id", folds, held).alias("held_out")
    if model is None:
        return named.select("doc_id", out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    score = _scorer(model, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(part.column("text")))], names=["doc_id", "score"])

    scored = named.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with all their columns, in one pass."""
    model = train(docs, labels, folds, held)
    return docs if model is None else docs.mapInArrow(_rejecter(model, threshold), docs.schema)
