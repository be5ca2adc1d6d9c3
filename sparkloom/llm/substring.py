"""Incremental removal of passages that repeat across documents.

A window is ``WINDOW`` consecutive words. Each window is represented by its
anchor, the ``GRAM`` words in it with the least hash; consecutive windows with
one anchor form a segment, so a text has about one segment for twenty words,
and equal windows have equal anchors whatever surrounds them.

The index is log-structured. Each batch of documents adds an immutable run of
segment fingerprints, sorted by anchor, with the first document of each;
runs are merge-joined with the next batch and compacted when there are
several. A segment that an earlier document holds whole is settled by that
join. Where documents share an anchor but not the segment around it (the ends
of a shared passage), their windows are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sheltered, lean, sifted

WINDOW, GRAM = 50, 12
#: Batches of ascending doc_id that the query feeds, and runs that are compacted into one.
BATCHES, FAN_IN = 2, 4
#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def words_of(text: str) -> list[bytes]:
    """Words are runs of other bytes than space and \\t to \\r."""
    return text.encode().split()


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_128_intdigest(word)
        return h


@lru_cache(maxsize=4)
def _powers(side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[side]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(size, base), np.full(size, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of a text's words, from prefix sums; the two sides are independent."""

    def __init__(self, words: list[bytes], known: _WordHash):
        self.n = len(words)
        wide = b"".join([known[w].to_bytes(16, "little") for w in words])
        halves = np.frombuffer(wide, "<u8").reshape(-1, 2)
        size = max(1 << max(self.n, 1).bit_length(), 4096)
        self._sums, self._down = [], []
        for side in (0, 1):
            up, down = _powers(side, size)
            self._sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(halves[:, side] * up[: self.n], dtype=np.uint64)]))
            self._down.append(down)

    def runs(self, side: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        sums = self._sums[side]
        return _mix((sums[start + length] - sums[start]) * self._down[side][start])


def segments(words: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first window and number of windows of each segment."""
    n = words.n - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    grams = words.runs(0, np.arange(words.n - GRAM + 1), GRAM)
    span = WINDOW - GRAM + 1
    anchor = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[at : min(at + (1 << 16), n) + span - 1], span)
        anchor[at : at + len(view)] = view.argmin(1) + np.arange(at, at + len(view))
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(start, n))
    return grams[anchor[start]], words.runs(1, start, count + (WINDOW - 1)), start, count


_SEGMENT = "id bigint, row bigint, n_words bigint, sha string, fp bigint, seg bigint, start int, n int"


def extract(docs: DataFrame) -> DataFrame:
    """For each document a row with its word count and digest, and a row for each segment.

    ``row`` is a hash of the text: rows that repeat an id are told apart by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        known = _WordHash()
        for batch in batches:
            ids, heads, parts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                row = xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)
                key = LAST if doc_id is None else doc_id
                heads.append((key, row, len(words), sha256(b" ".join(words)).hexdigest()))
                if len(words) >= WINDOW:
                    fp, seg, start, n = segments(Rolling(words, known))
                    parts.append((fp, seg, start, n))
                    ids.append((key, row, len(fp)))
            yield _table(heads, None, None)
            if ids:
                yield _table(None, ids, [np.concatenate(c) for c in zip(*parts, strict=True)])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SEGMENT)


def _table(heads, ids, parts) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["id", "row", "n_words", "sha", "fp", "seg", "start", "n"]
    if heads is not None:
        size = len(heads)
        columns = [pa.array([h[i] for h in heads], k) for i, k in enumerate(kinds[:4])] + [pa.nulls(size, k) for k in kinds[4:]]
    else:
        many = [c for _, _, c in ids]
        size = sum(many)
        columns = [pa.array(np.repeat(np.array([i[k] for i in ids], np.int64), many)) for k in (0, 1)]
        columns += [pa.nulls(size, k) for k in kinds[2:4]]
        columns += [pa.array(parts[0].view(np.int64)), pa.array(parts[1].view(np.int64)), pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names)


class FingerprintIndex:
    """Sorted immutable runs of segments seen so far: ``fp, seg, first, row, start, n``.

    ``first`` is the least id that holds the segment, the rest says where.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs, self._made = scratch, [], 0

    def all(self) -> DataFrame | None:
        out = None
        for run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, found: DataFrame) -> DataFrame:
        """Write a run of the batch's segments, pre-aggregated and sorted by anchor."""
        run = found.groupBy("fp", "seg").agg(F.min(F.struct("id", "row", "start", "n")).alias("at"), F.max("id").alias("last"))
        run = run.select("fp", "seg", F.col("at.id").alias("first"), F.col("at.row").alias("row"), F.col("at.start").alias("start"), F.col("at.n").alias("n"), "last")
        self._made += 1
        own = self.scratch.write(run.sortWithinPartitions("fp", "seg"), f"run{self._made}")
        self.runs.append(own)
        return own

    def compact(self) -> None:
        """Merge all runs into one that keeps each segment's first place."""
        merged = self.all().groupBy("fp", "seg").agg(F.min(F.struct("first", "row", "start", "n")).alias("at"), F.max("last").alias("last"))
        merged = merged.select("fp", "seg", "at.*", "last")
        self._made += 1
        self.runs = [self.scratch.write(merged.sortWithinPartitions("fp", "seg"), f"run{self._made}")]


def _few(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, text`` of the documents whose ids are wanted, and of a few others; most others are left out before any shuffle."""
    return sifted(docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text"), wanted, ["id"])[1]


class IncrementalDedup:
    """Feeds batches of documents to the index; each batch must hold greater ids than those before."""

    def __init__(self, scratch: Scratch, history: FingerprintIndex | None = None):
        self.scratch, self.index = scratch, history or FingerprintIndex(scratch)
        self._batch = 0
        self._texts: list[DataFrame] = []

    def process(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(heads, ranges)`` of a batch.

        ``heads``: id, row, n_words, sha of every row. ``ranges``: id, row,
        ``windows`` (array of first window and number) to remove.
        """
        self._batch += 1
        name = f"batch{self._batch}"
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        self._texts.append(docs)
        found = self.scratch.write(extract(docs), name)
        heads = found.where("n_words is not null").select("id", "row", "n_words", "sha")
        places = found.where("fp is not null").select("id", "row", "fp", "seg", "start", "n")
        self.index.add(places)
        known = self.index.all()
        # anchors that some document of the batch shares with one before it
        shared = known.groupBy("fp").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("kinds")).where("hi > lo")
        first = known.groupBy("fp", "seg").agg(F.min(F.struct("first", "row", "start", "n")).alias("at"))
        first = first.join(shared, "fp").select("fp", "seg", "at.*", "lo", "kinds")
        first = self.scratch.write(first, f"{name}-shared")
        settled = places.join(first.select("fp", "seg", "first", "lo"), ["fp", "seg"]).where("id > lo")
        whole = settled.where("id > first").select("id", "row", "start", "n")
        # the rest: each window around a shared anchor, once for each different surrounding
        open_ = first.where("kinds > 1")
        open_ = open_.join(open_.where("first > lo").select("fp").distinct(), "fp", "left_semi")
        asked = self.scratch.write(
            open_.groupBy(F.col("first").alias("id"), "row").agg(F.collect_list(F.struct("fp", "seg", "start", "n")).alias("asked")), f"{name}-asked"
        )
        texts = self._texts[0]
        for more in self._texts[1:]:
            texts = texts.unionByName(more)
        windows = self.scratch.write(self._windows(_few(texts, asked), asked), f"{name}-windows")
        least = windows.groupBy("fp", "window").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
        parts = windows.join(least.select("fp", "window", "first"), ["fp", "window"]).where("id > first").select("id", "fp", "seg", "offset")
        # their verdict holds at every place where the document has the segment
        parts = places.join(parts, ["id", "fp", "seg"]).select("id", "row", (F.col("start") + F.col("offset")).alias("start"), F.lit(1).alias("n"))
        ranges = whole.unionByName(parts).groupBy("id", "row").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
        ranges = self.scratch.write(ranges, f"{name}-ranges")
        self.scratch.drop(*[f"{name}-{x}" for x in ("shared", "asked", "windows")])
        if len(self.index.runs) >= FAN_IN:
            self.index.compact()
        return heads, ranges

    @staticmethod
    def _windows(texts: DataFrame, asked: DataFrame) -> DataFrame:
        """Each window of the asked segments, by content hash, and its offset in the segment."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            known = _WordHash()
            for batch in batches:
                for key, row, text, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row != xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63):
                        continue
                    words = Rolling(words_of(text or ""), known)
                    n = np.array([a["n"] for a in asks])
                    start = np.concatenate([np.arange(a["start"], a["start"] + a["n"]) for a in asks])
                    offset = start - np.repeat([a["start"] for a in asks], n)
                    fp, seg = (np.repeat(np.array([a[k] for a in asks], np.int64), n) for k in ("fp", "seg"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(fp), pa.array(words.runs(1, start, WINDOW).view(np.int64)),
                            pa.array(np.full(len(fp), key, np.int64)), pa.array(seg), pa.array(offset.astype(np.int32)),
                        ],
                        ["fp", "window", "id", "seg", "offset"],
                    )

        joined = texts.join(asked, "id")
        return joined.select("id", "row", "text", "asked").mapInArrow(run, "fp bigint, window bigint, id bigint, seg bigint, offset int").distinct()


def kept_words(text: str, windows: list) -> tuple[list[bytes], int]:
    """The words outside all removed windows, and how many there were."""
    words = words_of(text)
    edge = np.zeros(len(words) + 1, np.int32)
    for w in windows:
        edge[w["start"]] += 1
        edge[min(w["start"] + w["n"] + WINDOW - 1, len(words))] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g], len(words)


def _cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``id, row, text, n_removed`` of the documents that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            out = []
            for key, row, text, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63):
                    kept, n = kept_words(text or "", windows)
                    out.append((key, row, b" ".join(kept).decode(), n - len(kept)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["id", "row", "kept", "n_removed"]
            )

    joined = _few(docs, ranges).join(ranges, "id").select("id", "row", "text", "windows")
    return joined.mapInArrow(run, "id bigint, row bigint, kept string, n_removed bigint").dropDuplicates(["id", "row"])


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The documents in ranges of ascending doc_id of about equal size; null ids come last."""
    if batches < 2:
        return [docs]
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("bigint"), [i / batches for i in range(1, batches)], 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    edges = [None, *cuts, None]
    return [docs.where((F.lit(True) if a is None else key > a) & (F.lit(True) if b is None else key <= b)) for a, b in zip(edges, edges[1:], strict=False)]


def dedup(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """``doc_id, row, n_words, n_removed, sha, kept`` of each document.

    A word goes if a window over it also starts in a document with a smaller
    doc_id. ``kept`` is the remaining text, words joined by one space, and
    null where nothing is removed; ``sha`` is the digest of all words of the
    input. Windows are judged on the input. Null texts have no words; texts
    under 50 words lose none; rows with one doc_id don't affect each other;
    a null doc_id comes after all others.
    """
    work = IncrementalDedup(scratch)
    out = None
    for batch in batches_of(docs, batches):
        heads, ranges = work.process(batch)
        cut = _cut(batch.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ranges)
        part = heads.join(cut, ["id", "row"], "left").select(
            F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "row", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), "sha", "kept"
        )
        out = part if out is None else out.unionByName(part)
    return out


def cut_documents(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """The documents with repeated passages cut from ``text``, and ``n_chars`` of the new text.

    Texts that lose nothing stay as they are; the words left of others are
    joined by one space, so a text that repeats wholly becomes empty.
    """
    done = dedup(docs, scratch, batches).where("kept is not null").select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row", "kept")
    done = scratch.write(done.distinct(), "cut")
    own = Sheltered(docs)
    rows = own.df.withColumn("id", F.coalesce(own.col("doc_id").cast("bigint"), F.lit(LAST)))
    same, some = sifted(rows, done, ["id"])
    hit = _with_row(some, own.inner["text"]).join(done, ["id", "row"], "left")
    new = {"text": F.coalesce("kept", own.col("text"))}
    if "n_chars" in own.names:
        new["n_chars"] = F.when(F.col("kept").isNull(), own.col("n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return own.restore(same).unionByName(own.restore(hit, new))


def _with_row(rows: DataFrame, text: str) -> DataFrame:
    """Add ``row``, the hash that tells texts with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            own = [xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "row"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `row` bigint")
