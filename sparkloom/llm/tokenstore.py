"""Compact binary files of token ids.

A file holds the documents of one range of ids, as chunks one after the other;
a chunk holds whole documents in order: a document index, the statistics of
its ids, and their blocks, coded by ``rangecoder``. Each block is coded on its
own and has a checksum of its ids; another covers all before the blocks. A
Parquet table lists the chunks: file, place, number of ids.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HELD, Scratch, gathered, lean
from .rangecoder import BLOCK, Corrupt, Statistics, decode_blocks, encode_blocks

MAGIC = b"CMRC2\0\0\0"
#: Ids of a chunk before it is closed at the end of a document.
CHUNK = 1 << 23
#: Bytes of rows that are encoded together.
TEXT_BYTES = 8 << 20


def pack_chunk(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A chunk: magic, sizes, document index (id, whether it is null, number of ids), statistics, block table, blocks."""
    known = Statistics.of(ids)
    blocks, stats = encode_blocks(ids, known), known.packed()
    sums = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u2").tobytes()) for i in range(len(blocks))]
    head = MAGIC + struct.pack("<QQQQ", len(doc_ids), len(ids), len(blocks), len(stats))
    index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(counts, "<u8").tobytes()
    table = np.array([[len(b), s] for b, s in zip(blocks, sums, strict=True)], "<u4").tobytes()
    body = head + index + stats + table
    return body + struct.pack("<I", zlib.crc32(body)) + b"".join(blocks)


def unpack_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids of a chunk; raises ``Corrupt``."""
    try:
        if data[:8] != MAGIC:
            raise Corrupt("no chunk")
        docs, total, count, size = struct.unpack_from("<QQQQ", data, 8)
        if 40 + 17 * docs + size + 8 * count + 4 > len(data):
            raise Corrupt("length")
        at = 40
        names = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, "u1", docs, at + 8 * docs)
        counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        stats = at + 17 * docs
        at = stats + size
        table = np.frombuffer(data, "<u4", 2 * count, at).reshape(-1, 2)
        at += 8 * count
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
            raise Corrupt("index checksum")
        at += 4
        ends = at + np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        if ends[-1] != len(data) or counts.sum() != total:
            raise Corrupt("length")
        ids = decode_blocks([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], total, Statistics.unpacked(data[stats : stats + size]))
        for i, s in enumerate(table[:, 1]):
            if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u2").tobytes()) != s:
                raise Corrupt(f"checksum of block {i}")
    except (struct.error, IndexError) as e:
        raise Corrupt(str(e)) from e
    return [None if z else int(d) for d, z in zip(names, nulls, strict=True)], counts, ids


#: Words of letters up to U+024F (but for U+0130, whose lower case is two characters) with marks behind, other than apostrophes.
_SIMPLE = "^(?P<core>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<tail>[!-&(-/:-@\\[-^`{-~]*)$"


class WordTokens:
    """Ids of a tokenizer that drops white space and looks at no more than one word at a time.

    So a word's ids are the same wherever it stands: the distinct words of a
    batch are encoded and the batch is put together from them. Most words are
    letters with marks behind; these two parts go to the tokenizer many at a
    time, in lower case, without its normalizer and pattern, which would leave
    them as they are; the end-of-word suffix tells their ids apart. That way
    is taken only where the tokenizer's own agrees with it on ``_PROBES``.
    Up to ``remembered`` parts of at most ``LONGEST`` characters are kept.
    """

    LONGEST = 64
    _PROBES = ("a", "Word", "WORDS", "école", "Straße", "x...", "end.", "no###", "y!?", "ñandú,", "ÿ%%%", "qwrtzp")

    def __init__(self, path: str, remembered: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        def opened():
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            return tokenizer

        self._tokenizer, self._bare = opened(), opened()
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        if self.vocabulary > 1 << 16:
            raise ValueError(f"ids of {self.vocabulary} tokens don't fit the 16 bits of a token file")
        self._known: dict[str, bytes] = {}
        self._most = remembered
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self._ends = np.zeros(1 << 16, bool)
        self._ends[[i for t, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        self._bare.normalizer = None
        self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._simple = bool(suffix) and self._lowers()
        probes = pa.array(self._PROBES)
        self._simple = self._simple and [x.tolist() for x in self.ids(probes)] == [self._plainly([x])[0].tolist() for x in self._PROBES]

    def _lowers(self) -> bool:
        """Whether the normalizer makes lower case of each letter up to U+024F and changes nothing else of a word."""
        letters = [chr(i) for i in range(33, 0x250) if not chr(i).isspace()]
        normal = self._tokenizer.normalizer
        return normal is not None and all(normal.normalize_str(c) == c.lower() for c in letters)

    def _plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str], barely: bool) -> np.ndarray:
        """The packed ids of distinct parts, as an array of bytes objects; ``barely`` if they need no normalizer."""
        known = self._known
        out = list(map(known.get, parts))
        where = [i for i, x in enumerate(out) if x is None]
        if where:
            if len(known) > self._most:
                known.clear()
            new = [parts[i] for i in where]
            if barely:
                ids = np.array(self._bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u2")
                cuts, data = (2 * np.flatnonzero(self._ends[ids]) + 2).tolist(), ids.tobytes()
                made = [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                made = [x.astype("<u2").tobytes() for x in self._plainly(new)]
            for i, x in zip(where, made, strict=True):
                out[i] = x
            known.update(zip(new, made, strict=True))
            for p in new:
                if len(p) > self.LONGEST:
                    del known[p]
        return out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Words are what ASCII white space parts; others' white space is the tokenizer's to see."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        pair = np.zeros((len(distinct), 2), np.int64)  # the two parts of each word; part 0 is empty
        packed = [b""]

        def add(parts: pa.Array, barely: bool, into: np.ndarray, side: int) -> None:
            own = parts.dictionary_encode()
            values = own.dictionary.to_numpy(zero_copy_only=False).tolist()
            pair[into, side] = np.asarray(own.indices) + len(packed)
            packed.extend(self._learn(values, barely) if values else [])

        filled = np.flatnonzero(np.asarray(pc.binary_length(distinct)))
        if self._simple:
            found = pc.extract_regex(distinct, _SIMPLE)
            simple = np.asarray(found.is_valid())
            some = found.filter(pa.array(simple))
            core, tail = some.field("core"), some.field("tail")
            add(pc.utf8_lower(core), True, np.flatnonzero(simple), 0)
            ended = np.asarray(pc.binary_length(tail)) > 0
            add(tail.filter(pa.array(ended)), True, np.flatnonzero(simple)[ended], 1)
            filled = filled[~simple[filled]]
        add(distinct.take(pa.array(filled)), False, filled, 0)
        data, size = np.frombuffer(b"".join(packed), "<u2"), np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        data, size = _picked(data, size, pair.ravel())  # of each distinct word
        size = size.reshape(-1, 2).sum(1)
        ids, many = _picked(data, size, np.asarray(words.indices))
        ends = np.concatenate([[0], np.cumsum(many)])
        edge = ends[np.cumsum(np.asarray(split.value_lengths()))]
        return np.split(ids, edge[:-1]) if len(texts) else []


def _picked(data: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``data``, of ``size`` each, put together in the order of ``which``, and their sizes."""
    many = size[which]
    ends = np.cumsum(many)
    shift = (np.cumsum(size) - size)[which] - ends + many
    at = np.repeat(shift, many)
    at += np.arange(len(at))
    return data.take(at), many


@lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


HELD["tokens"] = _tokens.cache_clear

_INDEX = "part int, seq int, file string, place bigint, size bigint, n_docs bigint, n_ids bigint"


def _opened(uri: str):
    """``(file system, path)`` of a URI of the shared folder: any store that pyarrow opens."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return FileSystem.from_uri(uri)


def write(docs: DataFrame, path: str, scratch: Scratch, end: int = 1) -> DataFrame:
    """Encode documents, write them as files in ascending order of doc_id, and return the table of their chunks.

    There is a file for each range of ids, under the scratch folder; ``part,
    seq`` order the chunks, ``file, place, size`` say where each is. Null ids
    come last, equal ids by text; null texts are empty. Every document ends
    with id ``end``; an empty table makes no file. A task holds one chunk: at
    most ``CHUNK`` ids and one document. A task that runs again writes a file
    of its own; the table names that of the run that was committed.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_last()
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(parts, order).sortWithinPartitions(order, "text")
    folder = scratch.folder("files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("tokens")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, part, stop = _tokens(path), TaskContext.get().partitionId(), np.array([end], np.uint16)
        name, place, out = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.cmrc", 0, None
        names: list[int | None] = []
        texts: list[np.ndarray] = []
        found: list[tuple] = []
        held = 0

        def close_chunk() -> None:
            nonlocal out, place, held
            ids = np.concatenate([x for t in texts for x in (t, stop)])
            data = pack_chunk(names, [len(t) + 1 for t in texts], ids)
            if out is None:
                fs, at = _opened(name)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(at)
            out.write(data)
            found.append((part, len(found), name, place, len(data), len(names), len(ids)))
            place, held = place + len(data), 0
            names.clear(), texts.clear()

        for batch in gathered(batches, TEXT_BYTES):
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.ids(pc.fill_null(batch.column(1), "")), strict=True):
                names.append(doc_id)
                texts.append(ids)
                held += len(ids) + 1
                if held >= CHUNK:
                    close_chunk()
        if names:
            close_chunk()
        if out is not None:
            out.close()
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["part", "seq", "file", "place", "size", "n_docs", "n_ids"])

    return scratch.write(ordered.mapInArrow(run, _INDEX), "chunks")


def read(chunks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files of a chunk table; ``ids`` are little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before. Only chunk sizes are
    summed: first those of each part, then those within it. A damaged chunk
    raises ``Corrupt``.
    """
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", before).select("part", "base")
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = chunks.withColumn("inside", inside).join(parts, "part").select((F.col("base") + F.col("inside")).alias("first"), "file", "place", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for first, file, place, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = _opened(file)
                with fs.open_input_file(at) as f:
                    data = f.read_at(size, place)
                if len(data) != size:
                    raise Corrupt("length")
                names, counts, ids = unpack_chunk(data)
                wide = ids.astype("<u4")
                edge = np.concatenate([[0], np.cumsum(counts)])
                for a in range(0, len(names), 2000):
                    z = min(a + 2000, len(names))
                    own = [wide[x:y].tobytes() for x, y in itertools.pairwise(edge[a : z + 1])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[a:z], pa.int64()), pa.array(first + edge[a:z]), pa.array(counts[a:z]), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
                    )

    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartitionByRange(tasks, "first").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
