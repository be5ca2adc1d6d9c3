"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a piece exactly one token can end its encoding. A keyword
automaton over the vocabulary yields, at each position, the tokens that are
suffixes of the prefix; a token ends the prefix if it is compatible with the
last token of the prefix before it, that is, if no merge would cross their
common border. Following the stored last tokens back gives the ids that the
merge procedure itself would give.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import HELD, map_texts

#: The pre-tokenizer pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and pairs that a worker remembers before it starts afresh.
REMEMBERED_PIECES, REMEMBERED_PAIRS = 200_000, 400_000


def byte_symbols() -> dict[str, int]:
    """The printable symbol that vocabulary files write for each byte.

    Visible Latin-1 characters stand for themselves; the other bytes, in
    order, take the code points from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Remembered(dict):
    """Maps a piece to its packed ids, encoding it when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = self[piece] = np.array(self.encode(piece), "<u4").tobytes()
        return packed


class BpeCodec:
    """Encoder and decoder of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = {token: bytes(symbols[c] for c in token) for token in spec["model"]["vocab"] if all(c in symbols for c in token)}
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *added.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, data in raw.items():
            self.token_bytes[vocab[token]] = data
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.added = added
        self._added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._merge: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self._merge[a, b] = rank
            if whole in parts:
                raise ValueError(f"token {whole} is made by two merges")
            parts[whole] = (a, b, rank)
        self._parts = parts
        self._spines: dict[int, list[tuple[int, float]]] = {}
        self._automaton = ahocorasick.Automaton()
        for token, data in raw.items():
            if token not in added:
                self._automaton.add_word(data.decode("latin-1"), (vocab[token], len(data)))
        self._automaton.make_automaton()
        self._pieces = regex.compile(PIECES)
        self._compatible: dict[int, bool] = {}
        self._known = _Remembered(self.encode_piece)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at a token's edge while it is built, and the rank of the merge that takes it up."""
        key = token << 1 | side
        spine = self._spines.get(key)
        if spine is None:
            spine, until, parts = [(token, math.inf)], math.inf, self._parts
            while token in parts:
                until = parts[token][2]
                token = parts[token][side]
                spine.append((token, until))
            self._spines[key] = spine
        return spine

    def compatible(self, first: int, second: int) -> bool:
        """Whether the merges leave the border between the two tokens alone.

        A pair at the border is merged if its rank comes before both of its
        sides are taken up within their own tokens; between equal ranks the
        merge further left comes first.
        """
        key = first << 20 | second
        known = self._compatible.get(key)
        if known is None:
            merge, left = self._merge, self._spine(second, 0)
            known = True
            for x, x_until in self._spine(first, 1):
                for y, y_until in left:
                    rank = merge.get((x, y))
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
                        break
                if not known:
                    break
            if len(self._compatible) >= REMEMBERED_PAIRS:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece of the pre-tokenizer."""
        data = piece.encode().decode("latin-1")
        last: list[tuple[int, int] | None] = [None] * len(data)
        compatible = self.compatible
        for end, (token, length) in self._automaton.iter(data):
            if last[end] is None:
                start = end - length
                if start < 0 or ((before := last[start]) is not None and compatible(before[0], token)):
                    last[end] = (token, length)
        ids, at = [], len(data) - 1
        while at >= 0:
            token, length = last[at]
            ids.append(token)
            at -= length
        return ids[::-1]

    def _plain(self, text: str) -> bytes:
        if len(self._known) > REMEMBERED_PIECES:
            self._known.clear()
        return b"".join(map(self._known.__getitem__, self._pieces.findall(text)))

    def encode_packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self._added_split is None or not any(a in text for a in self.added):
            return self._plain(text)
        return b"".join(
            np.array([self.added[part]], "<u4").tobytes() if i % 2 else self._plain(part)
            for i, part in enumerate(self._added_split.split(text))
        )

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, "<u4").tobytes())


@lru_cache(maxsize=1)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


HELD["bpe"] = codec.cache_clear


def encode(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids`` of each row's whole text.

    ``ids`` is binary, little-endian unsigned 32-bit integers. A null or empty
    text has no ids; repeated rows are encoded each; other columns are not
    read. The vocabulary file is bounded and opened once per worker.
    """

    def make():
        c = codec(vocab)

        def one(t: str) -> tuple:
            packed = c.encode_packed(t)
            return len(packed) // 4, packed

        return one

    return map_texts(docs, "n_tokens bigint, ids binary", make, key, text, "bpe")


def round_trip(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` with the text that decoding those ids gives, ``decoded``, in one pass."""

    def make():
        c = codec(vocab)

        def one(t: str) -> tuple:
            packed = c.encode_packed(t)
            return len(packed) // 4, packed, c.decode_packed(packed)

        return one

    return map_texts(docs, "n_tokens bigint, ids binary, decoded string", make, key, text, "bpe")


def decode(tokens: DataFrame, vocab: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded`` of packed ids; null ids decode to the empty text."""
    source = tokens.select(key, ids)
    out = f"{key} {source.schema[key].dataType.simpleString()}, decoded string"

    def run(batches):
        c = codec(vocab)
        for batch in batches:
            done = [c.decode_packed(b or b"") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], [key, "decoded"])

    return source.mapInArrow(run, out)
