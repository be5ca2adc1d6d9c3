"""Quality scores from a factorisation machine.

Features are hashed words, binned structure statistics and the text's length;
pairs of them interact through low-rank factors. The pairwise term is taken in
linear time from the identity ``sum_i<j <v_i,v_j> x_i x_j =
(|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts

#: Buckets for hashed words, bins of each statistic, rank of the factors.
WORD_BUCKETS, BINS, RANK = 1 << 15, 10, 8
#: Most labelled rows that the model is fitted on, taken by the hash of their id.
FIT_ROWS = 6000
#: Rows whose crc32(doc_id) modulo FOLDS is HELD_OUT teach nothing.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_CLASSES = np.zeros((256, 8))
for _k, _bytes in enumerate((_UPPER, _LOWER, _DIGIT, b"!?", b"|", b"#$%&*<>{}[]=+^~_\\/", b".,;:'\"-()", range(128, 192))):
    _CLASSES[list(_bytes), _k] = 1
N_STATS = 16


class _WordIndex(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        i = self[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
        return i


def structure(text: str, words: list[str], distinct: set[str]) -> np.ndarray:
    """The statistics of a text: lengths, character classes, repetition, layout."""
    data = np.frombuffer(text.encode(), np.uint8)
    upper, lower, digit, bang, bar, symbol, stop, tail = np.bincount(data, minlength=256) @ _CLASSES
    n, w = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    once = len(set(lines))
    return np.array(
        [
            np.log1p(len(text)), np.log1p(len(words)), len(text) / w, len(distinct) / w,
            upper / max(upper + lower, 1), digit / n, bang / w, bar / w, symbol / n, symbol / w, stop / w, tail / n,
            np.log1p(len(lines)), 1 - once / max(len(lines), 1), w / max(len(lines), 1), sum(map(len, distinct)) / max(len(distinct), 1),
        ]
    )


def features(index: _WordIndex, text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    distinct = set(words)
    return np.fromiter(map(index.__getitem__, distinct), np.int32, len(distinct)), structure(text, words, distinct)


@dataclass
class FactorisationMachine:
    """``edges`` bin the statistics; ``table`` rows are weight, factors, squared norm of the factors."""

    bias: float
    edges: np.ndarray
    table: np.ndarray

    @staticmethod
    def bins(edges: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return WORD_BUCKETS + np.arange(len(stats)) * BINS + (edges < stats[:, None]).sum(1)

    def score(self, words: np.ndarray, stats: np.ndarray) -> float:
        x = 1 / np.sqrt(max(len(words), 1))
        bag = self.table[words].sum(0) if len(words) else np.zeros(RANK + 2)
        shape = self.table[self.bins(self.edges, stats)].sum(0) / np.sqrt(len(stats))
        y = self.bias + bag[0] * x + shape[0]
        total = bag[1:-1] * x + shape[1:-1]
        y += 0.5 * (total @ total - bag[-1] * x * x - shape[-1] / np.sqrt(len(stats)))
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, steps: int = 800, batch: int = 64, rate: float = 0.1, seed: int = 7) -> FactorisationMachine:
    """Fit by adaptive stochastic gradients on the log loss.

    At least ``steps`` batches are seen, however few the rows. With no rows the model scores every text 0.5; with labels of one kind it
    tends to that kind.
    """
    size = WORD_BUCKETS + N_STATS * BINS
    if not rows:
        return FactorisationMachine(0.0, np.zeros((N_STATS, BINS - 1)), np.zeros((size, RANK + 2)))
    rng = np.random.default_rng(seed)
    stats = np.array([r[1] for r in rows])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    inputs = []
    for words, s, _ in rows:
        own = FactorisationMachine.bins(edges, s)
        inputs.append((np.concatenate([words, own]), np.concatenate([np.full(len(words), 1 / np.sqrt(max(len(words), 1))), np.full(len(own), 1 / np.sqrt(len(own)))])))
    target = np.array([r[2] for r in rows], float)
    prior = np.clip(target.mean(), 0.01, 0.99)
    bias, w = float(np.log(prior / (1 - prior))), np.zeros(size)
    v = rng.normal(0, 0.02, (size, RANK))
    seen_w, seen_v, seen_b = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(max(epochs, -(-steps * batch // len(rows)) if len(rows) > batch else steps)):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            index = np.concatenate([inputs[i][0] for i in take])
            x = np.concatenate([inputs[i][1] for i in take])
            row = np.repeat(np.arange(len(take)), [len(inputs[i][0]) for i in take])
            vx = v[index] * x[:, None]
            total = np.stack([np.bincount(row, vx[:, f], len(take)) for f in range(RANK)], 1)
            y = bias + np.bincount(row, w[index] * x + -0.5 * (vx * vx).sum(1), len(take)) + 0.5 * (total * total).sum(1)
            g = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - target[take]
            gx = g[row] * x
            grad_w = np.bincount(index, gx, size) / len(take) + 1e-5 * w
            seen_w += grad_w**2
            w -= rate * grad_w / np.sqrt(seen_w)
            gv = gx[:, None] * (total[row] - vx)
            touched, slot = np.unique(index, return_inverse=True)
            grad_v = np.stack([np.bincount(slot, gv[:, f], len(touched)) for f in range(RANK)], 1) / len(take) + 1e-4 * v[touched]
            seen_v[touched] += grad_v**2
            v[touched] -= 0.5 * rate * grad_v / np.sqrt(seen_v[touched])
            seen_b += g.mean() ** 2
            bias -= rate * g.mean() / np.sqrt(seen_b)
    table = np.concatenate([w[:, None], v, (v * v).sum(1, keepdims=True)], 1)
    return FactorisationMachine(bias, edges, table)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, by hash of id.

    Labels of a repeated doc_id count as 1 if any of them is 1; null labels
    and null ids teach nothing.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("__label").alias("label"), "text")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> FactorisationMachine:
    """Fit on a bounded sample of labelled rows; only their features reach the driver."""
    sample = labelled(docs, labels, "quality", FOLDS, HELD_OUT, rows)

    def make():
        index = _WordIndex()

        def one(text: str) -> tuple:
            words, stats = features(index, text)
            return np.sort(words).astype("<i4").tobytes(), stats.tolist()

        return one

    found = map_texts(sample, "words binary, stats array<double>", make, key="label").collect()
    rows_ = sorted(((r.words, tuple(r.stats), r.label) for r in found))
    return fit([(np.frombuffer(a, "<i4"), np.array(b), c) for a, b, c in rows_])


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, score``: how likely each whole text is of good quality.

    Null and empty texts are scored as texts without words. One row per input
    row, repeated ids included.
    """

    def make():
        index = _WordIndex()
        return lambda text: (model.score(*features(index, text)),)

    return map_texts(docs, "score double", make)
