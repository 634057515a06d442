"""Text quality by pairwise ranking: a Bradley-Terry score learned from preference pairs, cut at a score quantile.

Each text becomes a row of counts and shares (``FEATURES``), made in one pass over the documents; labels are joined to
these small rows, never to texts. Every labelled row outside the held-out fold is learned from, and every preference pair
counts: a row of label 1 beats each row of label 0. The weights maximise the mean of log sigma(w . (x_better - x_worse))
over all pairs with an L2 penalty, in up to ``ROUNDS`` BFGS steps. The loss of a step needs, per label, only the number and the
feature sums of the rows in each of ``BINS`` ranges of the present score, so a step is one pass over the rows in which tasks
add up their own, and the driver gets a few arrays of fixed size. The cut is the quantile of all training scores with the
best balanced accuracy, from counts in ``FINE`` ranges; scores are shifted so that the cut lies at ``threshold``, and squashed by
the logistic function.

Labels, languages, sources and ids are never inputs of a score.

Defined results: null and empty texts are scored by the features of a text without characters; without labels of both
kinds every score is 0.5; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, in_fold, stored

BINS, FINE, ROUNDS, GROUPS = 512, 8192, 12, 16

FEATURES = (
    "characters", "words", "word_length", "upper", "digits", "letters", "symbols", "space", "distinct_words", "top_word", "top_pair", "repeated_lines",
    "words_with_symbol", "short_words", "long_words", "upper_words", "sentence_length", "ends", "commas", "pipes", "line_length", "bullets", "exclamations",
    "line_ends", "links", "entropy", "distinct_characters", "next_same",
)
_LETTERS = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")


def text_features(text: str | None) -> list[float]:
    text = text or ""
    n = len(text) or 1
    words = text.split()
    m = len(words) or 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(lines) or 1
    pairs = Counter(zip(words, words[1:]))
    chars = Counter(text)
    upper = sum(v for c, v in chars.items() if c.isupper())
    digits = sum(v for c, v in chars.items() if c.isdigit())
    letters = sum(v for c, v in chars.items() if c.isalpha())
    space = sum(v for c, v in chars.items() if c.isspace())
    odd = [c for c in chars if _ODD.match(c)]
    symbols = sum(chars[c] for c in odd)
    ends = chars["."] + chars["!"] + chars["?"]
    marked = sum(v for w, v in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?'\")")
    return [
        log1p(len(text)), log1p(len(words)), (n - space) / m, upper / n, digits / n, letters / n, symbols / n, space / n,
        len(counts) / m ** 0.9, max(counts.values(), default=0) / m, max(pairs.values(), default=0) / m, 1 - len(set(lines)) / k,
        marked / m, sum(v for w, v in counts.items() if len(w) < 3) / m, sum(v for w, v in counts.items() if len(w) > 12) / m,
        sum(v for w, v in counts.items() if len(w) > 1 and w.isupper()) / m, log1p(m / (ends + 1)), ends / m, chars[","] / m, chars["|"] / m, log1p(n / k),
        sum(x.lstrip()[0] in "-*•·" for x in lines) / k, chars["!"] / m, sum(x.rstrip()[-1] in ".!?" for x in lines) / k, (text.count("http") + text.count("www")) / m,
        -sum(v / n * log(v / n) for v in chars.values()), len(chars) / 50, sum(v for (a, b), v in pairs.items() if a == b) / m,
    ]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [text_features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _expand(x: np.ndarray) -> np.ndarray:
    """Values and squares of values, so that a middle range can rank highest."""
    return np.concatenate([x, x * x], axis=1)


def _summed(rows: DataFrame, add) -> np.ndarray:
    """The sum of ``add(y, x)`` over all rows ``(y, x)``: tasks add up their own, groups of tasks theirs, and GROUPS arrays reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                part = add(batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def fold(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer()) for b in table["sums"])
        return pa.table([table["part"].slice(0, 1).cast(pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    schema = "part int, sums binary"
    return sum((np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, schema).groupBy("part").applyInArrow(fold, schema).orderBy("part").collect()), np.zeros(1))


def _by_slot(slot: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` with the same slot, n slots."""
    order = np.argsort(slot, kind="stable")
    there, first = np.unique(slot[order], return_index=True)
    out = np.zeros((n, values.shape[1]))
    out[there] = np.add.reduceat(values[order], first, axis=0)
    return out


class PairwiseRanker:
    """score(x) = w . phi(standardised x), learned from all pairs of a row of label 1 and a row of label 0."""

    def __init__(self, l2: float = 1e-3):
        self.l2 = l2

    def fit(self, rows: DataFrame) -> "PairwiseRanker | None":
        """``rows`` are ``(y, x)``; None where one label is missing."""
        k = len(FEATURES)
        plain = _summed(rows, lambda y, x: _by_slot(y, np.concatenate([np.ones((len(y), 1)), x, x * x], axis=1), 2).ravel())
        if plain.size == 1 or not (plain.reshape(2, -1)[:, 0] > 0).all():
            return None
        n, first, second = np.split(plain.reshape(2, -1).sum(axis=0), [1, 1 + k])
        self.mean = first / n
        self.scale = np.sqrt(np.maximum(second / n - self.mean**2, 0)) + 1e-9
        phi, d = self._phi, 2 * k

        def squares(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            f = np.concatenate([np.ones((len(y), 1)), phi(x)], axis=1)
            return np.stack([f[y == v].T @ f[y == v] for v in (0, 1)]).ravel()

        moments = _summed(rows, squares).reshape(2, d + 1, d + 1)
        moments = moments / moments[:, :1, :1]
        centre = moments[:, 0, 1:]
        inner = [moments[v, 1:, 1:] - np.outer(centre[v], centre[v]) for v in (0, 1)]
        apart = centre[1] - centre[0]
        self.centre, self.cov = centre.mean(axis=0), (inner[0] + inner[1]) / 2 + np.outer(apart, apart) / 4
        step = np.linalg.inv((inner[0] + inner[1] + np.outer(apart, apart)) / 4 + self.l2 * np.eye(d))
        w = np.zeros(d)
        loss, slope = self._loss(rows, w)
        for _ in range(ROUNDS):
            move = -step @ slope
            for _ in range(6):
                to_loss, to_slope = self._loss(rows, w + move)
                if to_loss <= loss + 1e-4 * slope @ move:
                    break
                move = move / 2
            else:
                break
            y, gain = to_slope - slope, loss - to_loss
            w, loss, slope = w + move, to_loss, to_slope
            if gain < 1e-4 * loss or move @ y <= 0:
                break
            turn = np.eye(d) - np.outer(move, y) / (move @ y)
            step = turn @ step @ turn.T + np.outer(move, move) / (move @ y)
        self.w = w
        return self

    def _place(self, w: np.ndarray, bins: int):
        """Ranges of scores: ``bins`` over eight standard deviations each way; what lies beyond is in the last ones."""
        low, width = self.centre @ w, 16 * (np.sqrt(max(w @ self.cov @ w, 0)) or 1.0) / bins
        low -= width * bins / 2
        return low, width, lambda s: np.clip(np.floor((s - low) / width), 0, bins - 1).astype(np.int64)

    def _loss(self, rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean of -log sigma(difference) over all pairs, and its gradient; scores in a range count as their mean."""
        phi, (_, _, place) = self._phi, self._place(w, BINS)

        def add(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            f = phi(x)
            return _by_slot(y * BINS + place(f @ w), np.concatenate([np.ones((len(y), 1)), f], axis=1), 2 * BINS).ravel()

        sums = _summed(rows, add).reshape(2, BINS, -1)
        share = sums[:, :, 0] / sums[:, :, 0].sum(axis=1, keepdims=True)
        mean = sums[:, :, 1:] / np.maximum(sums[:, :, :1], 1)
        score = mean @ w
        gap = score[1][:, None] - score[0][None, :]
        weight = share[1][:, None] * share[0][None, :]
        pull = -weight / (1 + np.exp(np.clip(gap, -500, 500)))
        return float((weight * np.logaddexp(0, -gap)).sum() + self.l2 / 2 * w @ w), pull.sum(axis=1) @ mean[1] - pull.sum(axis=0) @ mean[0] + self.l2 * w

    def _phi(self, x: np.ndarray) -> np.ndarray:
        return _expand(np.clip((x - self.mean) / self.scale, -6, 6))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._phi(x) @ self.w

    def best_quantile(self, rows: DataFrame) -> float:
        """The score at the quantile of all rows with the best balanced accuracy; the middle of the best stretch of quantiles."""
        low, width, place = self._place(self.w, FINE)
        counts = _summed(rows, lambda y, x: np.bincount(y * FINE + place(self.score(x)), minlength=2 * FINE).astype(float)).reshape(2, FINE)
        edges = low + width * np.arange(FINE + 1)
        below = np.concatenate([np.zeros((2, 1)), np.cumsum(counts, axis=1)], axis=1) / counts.sum(axis=1, keepdims=True)
        every = np.concatenate([[0.0], np.cumsum(counts.sum(axis=0))]) / counts.sum()
        cuts = np.interp(np.linspace(0.002, 0.998, 499), every, edges)
        good = np.interp(cuts, edges, below[0]) + 1 - np.interp(cuts, edges, below[1])
        return float(np.median(cuts[good >= good.max() - 1e-4]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; rows of fold 0 are never learned from."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, "doc_id long, x array<double>"), "features")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    learn = stored(rows.join(known, "doc_id").where(crc_mod("doc_id", folds) != 0).select(F.col("y").cast("long").alias("y"), "x"), "learn")
    held = in_fold("doc_id", folds, 0).alias("held_out")
    ranker = PairwiseRanker().fit(learn)
    if ranker is None:
        return rows.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    cut = ranker.best_quantile(learn)
    shift = log(threshold / (1 - threshold))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = 1 / (1 + np.exp(-np.clip(ranker.score(x) - cut + shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
