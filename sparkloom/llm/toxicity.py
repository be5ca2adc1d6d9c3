"""Toxicity scores of deobfuscated text.

A disguised word is taken as a clean word sent through a noisy channel that
swaps letters for look-alikes, spreads them out and repeats them. Each
suspicious span becomes a lattice of characters; Viterbi decoding under a
character language model of the corpus restores it, and the restored text is
scored by a logistic model over word and word-stem evidence.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, map_texts
from .quality import labelled

#: Most labelled rows of each kind that the classifier is fitted on.
FIT_ROWS_EACH = 3000
#: Rows whose crc32(doc_id) modulo FOLDS is HELD_OUT teach nothing.
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Hash buckets of the evidence, most kept, and the G-squared that a kept one needs.
EVIDENCE_BITS, EVIDENCE_KEPT, EVIDENCE_LEAST = 22, 4000, 12.0
#: Ridge penalty of a weight.
SHRINK = 0.002
STEMS = (4, 5, 6)

#: What a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
GAPS = " .-_*~^"
#: Costs of the channel, in nats: a swap, a dropped gap, a dropped repeat, a kept repeat beyond two.
SWAP, DROP_GAP, DROP_REPEAT, KEEP_REPEAT = 0.7, 0.3, 0.2, 3.0

_UNIT = r"[^\W_]|[@$!|€+]"
_SPACED = re.compile(rf"(?<![^\W_])(?:(?:{_UNIT})[ .\-_*]{{1,2}}){{3,}}(?:{_UNIT})(?![^\W_])")
_ODD = re.compile(r"[0-9@$!|+€*_~^.\-]+")
_WORDS = re.compile(r"[^\W_]+")

#: The language model's classes: 0 is any other character, 1 to 26 the letters, the rest letters with marks.
CLASSES, ORDER = 32, 4


def _class_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for c in map(chr, range(128, 0x3000)):
        if c.isalpha():
            table[ord(c)] = 27 + ord(c) % 5
    for i in range(26):
        table[97 + i] = 1 + i
    return table


_TABLE = _class_table()


def _classes(text: str) -> np.ndarray:
    return _TABLE[np.frombuffer(text.lower().encode("utf-16-le", "replace"), np.uint16)]


_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
_UNITS = np.array([chr(i).isalnum() or chr(i) in "@$!|€+" for i in range(1 << 16)])


def _codes(text: str) -> np.ndarray:
    """One code for each character; those beyond 16 bits count as no letter."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram, n``: character four-grams of all texts, with three boundaries around each text.

    Counted per task first, so that at most 2^20 rows a task are shuffled.
    """

    def run(batches):
        lean()
        counts = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            gap = "\0" * (ORDER - 1)
            c = _classes(gap + gap.join(t or "" for t in batch.column(0).to_pylist()) + gap).astype(np.int32)
            counts += np.bincount(((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:], minlength=len(counts))
        (some,) = np.nonzero(counts)
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part], pa.int64())], ["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: DataFrame) -> np.ndarray:
    """Costs (negative logs) of a character class after three others, smoothed over shorter contexts.

    The table has at most 2^20 cells whatever the size of the corpus.
    """
    found = grams.toArrow()
    n4 = np.zeros(CLASSES**ORDER)
    n4[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    n4 = n4.reshape((CLASSES,) * ORDER)
    p = np.full(CLASSES, 1 / CLASSES)
    for kept in (1, 2, 3, 4):
        n = n4.sum(axis=tuple(range(ORDER - kept)))
        total = n.sum(-1, keepdims=True)
        p = (n + 2 * p) / (total + 2)
    return -np.log(p).astype(np.float32).ravel()


@dataclass
class Restorer:
    """Restores suspicious spans; ``costs`` is the language model."""

    costs: np.ndarray

    def __post_init__(self):
        self._known: dict[str, str] = {}

    def __getstate__(self):
        return {"costs": self.costs}

    def __setstate__(self, state):
        self.costs, self._known = state["costs"], {}

    def _lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, the strings that it may come from and their costs."""
        out, i = [], 0
        while i < len(span):
            c, j = span[i], i
            while j < len(span) and span[j] == c:
                j += 1
            n = j - i
            if c in GAPS:
                out.append([("", DROP_GAP * n), (" ", 0.0)])
            elif c in LOOKALIKES:
                drop = DROP_REPEAT * (n - 1)
                out.append([(c * n, 0.0), *[(x, SWAP + drop) for x in LOOKALIKES[c]], *[(x * 2, SWAP + drop) for x in LOOKALIKES[c] if n > 1]])
            elif n > 1 and c.isalpha():
                out.append([(c, DROP_REPEAT * (n - 1)), (c * 2, DROP_REPEAT * (n - 2)), *([(c * n, KEEP_REPEAT)] if n > 2 else [])])
            else:
                out.append([(c * n, 0.0)])
            i = j
        return out

    def decode(self, span: str) -> str:
        """The likeliest string behind the span, by exact Viterbi over the last three classes."""
        known = self._known.get(span)
        if known is not None:
            return known
        costs, mask = self.costs, CLASSES ** (ORDER - 1) - 1
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for choices in [*self._lattice(span.lower()), [(" ", 0.0)]]:
            after: dict[int, tuple[float, tuple | None]] = {}
            for text, price in choices:
                classes = [int(_TABLE[ord(c)]) if ord(c) < 65536 else 0 for c in text]
                for state, (cost, path) in states.items():
                    total, s = cost + price, state
                    for c in classes:
                        cell = s * CLASSES + c
                        total += float(costs[cell])
                        s = cell & mask
                    best = after.get(s)
                    if best is None or total < best[0]:
                        after[s] = (total, (path, text) if text else path)
            states = after
        path, parts = min(states.values(), key=lambda x: x[0])[1], []
        while path is not None:
            path, text = path
            parts.append(text)
        restored = "".join(parts[::-1])[:-1]
        if len(self._known) > 100_000:
            self._known.clear()
        self._known[span] = restored
        return restored

    @staticmethod
    def _spots(text: str) -> list[int]:
        """Where a word holds look-alikes or gaps, a letter thrice, or three doubled letters."""
        found = []
        for m in _ODD.finditer(text):
            i, j = m.span()
            before = i > 0 and text[i - 1].isalpha()
            after = text[j : j + 1].isalpha()
            if after and (before or ((i == 0 or text[i - 1].isspace()) and text[j + 1 : j + 2].isalpha() and m[0] != "-" and m[0] != ".")):
                found.append(i)
            elif before and m[0].isdigit() and (j == len(text) or text[j].isspace()):
                found.append(i)
        codes = _codes(text)
        same = (codes[1:] == codes[:-1]) & (_LETTER[codes[1:]])
        for step, many in ((1, 2), (2, 3)):
            if len(same) > step * (many - 1):
                hit = same[: len(same) - step * (many - 1)].copy()
                for k in range(1, many):
                    hit &= same[step * k : len(same) - step * (many - 1 - k)]
                found += np.flatnonzero(hit).tolist()
        return sorted(found)

    @staticmethod
    def _may_be_spaced(text: str) -> bool:
        """Whether four single letters stand within three places of each other."""
        unit = _UNITS[_codes(text)]
        alone = unit.copy()
        alone[1:] &= ~unit[:-1]
        alone[:-1] &= ~unit[1:]
        near = np.diff(np.flatnonzero(alone)) <= 3
        return bool(len(near) > 2 and (near[:-2] & near[1:-1] & near[2:]).any())

    def restore(self, text: str) -> str:
        """The whole text with suspicious spans restored; other spans are untouched."""
        if self._may_be_spaced(text):
            text = _SPACED.sub(lambda m: self.decode(m[0]), text)
        spots = self._spots(text)
        if not spots:
            return text
        out, done = [], 0
        for spot in spots:
            if spot < done:
                continue
            start = spot
            while start > done and not text[start - 1].isspace():
                start -= 1
            end = spot
            while end < len(text) and not text[end].isspace():
                end += 1
            out += [text[done:start], self.decode(text[start:end])]
            done = end
        return "".join([*out, text[done:]])


def evidence(word: str) -> list[int]:
    """Buckets of a lower-case word and its stems."""
    keys = [f"={word}", *[f"{n}{word[:n]}" for n in STEMS if len(word) >= n]]
    return [zlib.crc32(k.encode()) & ((1 << EVIDENCE_BITS) - 1) for k in keys]


def tokens(text: str) -> set[str]:
    """Distinct white-space tokens; words are taken from each."""
    return set(text.split())


class _Evidence(dict):
    """Maps a token to the evidence of its words that ``weights`` knows (all, if it is None)."""

    def __init__(self, weights: dict[int, float] | None):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        low = token.lower()
        words = (low,) if low.isalpha() else _WORDS.findall(low)
        found = [k for w in words if len(w) > 2 for k in evidence(w) if self.weights is None or k in self.weights]
        out = self[token] = tuple(found)
        return out


@dataclass
class ToxicityModel:
    restorer: Restorer
    bias: float
    weights: dict[int, float]

    def score(self, text: str, seen: _Evidence) -> float:
        found: set[int] = set()
        for keys in map(seen.__getitem__, tokens(self.restorer.restore(text))):
            if keys:
                found.update(keys)
        y = self.bias + sum(self.weights[k] for k in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(rows: list[tuple[np.ndarray, int]], prior: float, rounds: int = 1500) -> tuple[float, dict[int, float]]:
    """Choose evidence by G-squared of its document counts, then fit weights to it.

    ``prior`` is the share of toxic rows among all that may teach; the sample
    itself is balanced. With rows of one kind only, every text scores the
    prior.
    """
    prior = float(np.clip(prior, 0.001, 0.999))
    y = np.array([r[1] for r in rows])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return float(np.log(prior / (1 - prior))), {}
    size = 1 << EVIDENCE_BITS
    held = np.zeros((2, size), np.int32)  # documents of each label that hold a bucket
    for keys, label in rows:
        held[label][keys] += 1
    (some,) = np.nonzero((held[0] + held[1] >= 3) & (held[1] * np.float32(n0) > 4 * held[0] * np.float32(n1)))
    a, b = held[1][some].astype(float), held[0][some].astype(float)
    del held
    share, both = n1 / (n1 + n0), a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (a * np.log(a / (both * share)) + np.where(b > 0, b * np.log(b / (both * (1 - share))), 0))
    some, g2 = some[g2 >= EVIDENCE_LEAST], g2[g2 >= EVIDENCE_LEAST]
    some = some[np.argsort(-g2, kind="stable")][:EVIDENCE_KEPT]
    column = np.full(size, -1, np.int16)
    column[some] = np.arange(len(some))
    own = [column[keys] for keys, _ in rows]
    own = [c[c >= 0] for c in own]
    of, col = np.repeat(np.arange(len(rows)), [len(c) for c in own]), np.concatenate(own).astype(np.int64)
    del column, own
    w, bias = np.zeros(len(some)), 0.0
    mean, square = np.zeros(len(some) + 1), np.zeros(len(some) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(of, w[col], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        grad = np.append(np.bincount(col, g[of], len(some)) + SHRINK / len(rows) * w, g.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    bias += np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return float(bias), {int(k): float(v) for k, v in zip(some, w, strict=True) if abs(v) > 1e-6}


def train(docs: DataFrame, labels: DataFrame, rows_each: int = FIT_ROWS_EACH) -> ToxicityModel:
    """A language model of every document, and a classifier fitted on a bounded sample.

    Up to ``rows_each`` rows of each label outside the held-out fold are
    taken, by the hash of their ids; only their evidence reaches the driver.
    """
    restorer = Restorer(language_model(count_grams(docs)))
    known = labels.where(F.col("toxic").isNotNull())
    teach = known.where(F.expr(f"crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} != {HELD_OUT}"))
    totals = teach.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("int")).alias("t")).first()

    def make():
        seen = _Evidence(None)

        def one(text: str) -> tuple:
            found: set[int] = set()
            for keys in map(seen.__getitem__, tokens(restorer.restore(text))):
                found.update(keys)
            return (np.sort(np.fromiter(found, "<i4", len(found))).tobytes(),)

        return one

    rows = []
    for kind in (0, 1):
        sample = labelled(docs, teach.where(F.col("toxic").cast("int") == kind), "toxic", FOLDS, HELD_OUT, rows_each)
        rows += sorted((r.evidence, kind) for r in map_texts(sample, "evidence binary", make, key="label").collect())
    bias, weights = fit([(np.frombuffer(k, "<i4"), kind) for k, kind in rows], (totals.t or 0) / max(totals.n, 1))
    return ToxicityModel(restorer, bias, weights)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text: str = "text", name: str = "score") -> DataFrame:
    """``doc_id, score``, or the columns of ``keep`` and one called ``name``: how likely each whole text is toxic.

    Null and empty texts score what a text without evidence does. One row per
    input row, repeated ids included; texts of any length count whole; an
    empty table gives no rows. Only the columns asked for are read, so others
    may have any names.
    """

    def make():
        seen = _Evidence(model.weights)
        return lambda text: (model.score(text, seen),)

    return map_texts(docs, f"{name} double", make, keep or "doc_id", text)


def restore(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, restored``: each whole text with its disguised words restored."""
    return map_texts(docs, "restored string", lambda: lambda text: (model.restorer.restore(text),))
