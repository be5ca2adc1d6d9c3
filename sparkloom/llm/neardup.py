"""Near-duplicate classes from DartMinHash signatures.

A weighted set is a region for each element, as high as its weight. Darts are
thrown by hash at unit regions, in order of rank; each dart belongs to one of
``COORDINATES`` coordinates, and the earliest dart of a coordinate that hits
the set is its signature there. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. Few ranks are looked at, so
a signature takes time linear in the set. The sets of a batch of texts are
signed together, by array operations.

Texts with equal shingle sets are one node. Bands of the signature put nodes
into buckets; within a bucket nodes are compared with its centre instead of
with each other. What then stays apart in a bucket is compared with each other,
in blocks, by signatures and where these agree by whole sets. Links are checked
exactly; classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sheltered, lean, sifted, slices

SHINGLE, LEAST = 5, 0.8
#: 32 bands of 4: two sets of similarity 0.8 share none with probability 5e-8, less than SHARED with 1e-6.
COORDINATES, ROWS, SHARED = 128, 4, 2
#: Coordinates, by one byte each, that two nodes must agree in to be compared by their sets: 0.8 misses this with probability 3e-7.
AGREE = 80
#: Nodes and bytes of shingles in a block of what the centres leave open. A block's elements are counted by pairs
#: of nodes if at most FEW hold them, else by matrix products of so many columns.
BLOCK, BLOCK_BYTES, FEW, COLUMNS = 256, 4 << 20, 16, 4096
#: Bytes of text whose sets are made and signed together; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _levels(elements: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The region of each unit of an element's weight; its first is the element itself."""
    return np.where(level == 0, elements, _mix(elements + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def shingle_sets(texts: pa.Array, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct five-word shingles, sorted, one text after the other, and how many each has.

    A text of fewer words has one shingle of them all, one without words
    none. If ``counted``, a shingle that occurs n times has n regions.
    """
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    kinds = words.dictionary.cast(pa.binary()).to_pylist()
    filled = np.array([bool(w) for w in kinds], bool)
    at = np.asarray(words.indices)
    there = filled[at] if len(kinds) else np.zeros(0, bool)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in kinds], np.uint64)[at[there]] if len(kinds) else np.zeros(0, np.uint64)
    edges = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(np.asarray(split.value_lengths()))])]
    n = np.diff(edges)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, n > 0)
    begin = _begins(many)
    out = np.empty(many.sum(), np.uint64)
    total = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + len(total)] * _MULTIPLIERS[i]
    long = n >= SHINGLE
    own = np.repeat(edges[:-1][long] - _begins(many[long]), many[long]) + np.arange(many[long].sum())
    out[np.repeat(long, many)] = _mix(total[own])
    for d in np.flatnonzero((n > 0) & ~long):
        few = h[edges[d] : edges[d + 1]]
        out[begin[d]] = _mix((few * _MULTIPLIERS[: n[d]]).sum(keepdims=True) + np.uint64(n[d]))[0]
    for a, z in zip(begin.tolist(), (begin + many).tolist(), strict=True):
        out[a:z].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[many > 0]] = True
    if counted:
        first = np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))
        out = _levels(out, np.arange(len(out)) - first)
        for a, z in zip(begin.tolist(), (begin + many).tolist(), strict=True):
            out[a:z].sort()
        return out, many
    return out[new], np.bincount(np.repeat(np.arange(len(n)), many)[new], minlength=len(n))


def shingles(text: str, counted: bool = False) -> np.ndarray:
    """The set of one text."""
    return shingle_sets(pa.array([text]), counted)[0]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(regions: np.ndarray, sizes: np.ndarray, heights: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart of each coordinate, a row for each set; ``heights`` are 1 if not given. No set may be empty."""
    out = np.zeros((len(sizes), COORDINATES), np.uint64)
    left = np.arange(len(sizes))
    owner = np.repeat(left, sizes)
    weight = sizes.astype(np.float64) if heights is None else np.bincount(owner, heights, len(sizes))
    reach = (COORDINATES * np.log(COORDINATES) + 2 * COORDINATES) / weight
    start = _mix(regions ^ np.uint64(0xE7037ED1A0B428DB))
    while len(left):
        slot, ranks, darts = [], [], []
        state, own, high = start, owner, heights
        rank = -np.log(_uniform(state))
        while True:
            near = rank <= reach[own]
            if not near.any():
                break
            state, rank, own = state[near], rank[near], own[near]
            dart = _mix(state + np.uint64(0x8EBC6AF09C88C6E3))
            hit = slice(None)
            if high is not None:
                high = high[near]
                hit = _uniform(_mix(dart)) < high
            darts.append(dart[hit])
            ranks.append(rank[hit])
            slot.append(own[hit] * COORDINATES + (dart[hit] % np.uint64(COORDINATES)).astype(np.int64))
            state = _mix(state ^ np.uint64(0x589965CC75374CC3))
            rank = rank - np.log(_uniform(state))
        slot, rank, dart = np.concatenate(slot), np.concatenate(ranks), np.concatenate(darts)
        least = np.full(out.size, np.inf)
        np.minimum.at(least, slot, rank)
        best = rank == least[slot]
        out.reshape(-1)[slot[best]] = dart[best]
        open_ = ~np.isfinite(least.reshape(out.shape)).all(1)
        open_[np.setdiff1d(np.arange(len(sizes)), left)] = False
        left = np.flatnonzero(open_)
        reach = reach * 2
        keep = open_[owner]
        start, owner, heights = start[keep], owner[keep], None if heights is None else heights[keep]
    return out


def signature(elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The signature of one weighted set; weights are 1 if not given. An empty set has none."""
    if not len(elements):
        return np.zeros(0, np.uint64)
    if weights is None:
        return signatures(elements, np.array([len(elements)]))[0]
    many = np.ceil(weights).astype(np.int64)  # a region for each unit of weight, the last as high as what is left
    level = np.arange(many.sum()) - np.repeat(_begins(many), many)
    return signatures(_levels(np.repeat(elements, many), level), np.array([many.sum()]), np.minimum(1.0, np.repeat(weights, many) - level))[0]


def bands(sigs: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    parts = sigs.reshape(len(sigs), -1, ROWS)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text``; ``row`` is a hash of the text that tells rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def sign(docs: DataFrame, counted: bool = False) -> DataFrame:
    """``doc_id, row, node_hi, node_lo, size, bands, sketch`` of each row.

    ``node`` is a 128-bit digest of the shingle set, ``size`` the number of its
    elements, ``sketch`` a byte of each coordinate of its signature. A text
    without words has no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, 2, BATCH_BYTES):
                values, sizes = shingle_sets(part.column(2), counted)
                begin = _begins(sizes)
                nodes = [blake2b(values[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
                node = np.frombuffer(b"".join(nodes), "<i8").reshape(-1, 2)
                signed = signatures(values, sizes[sizes > 0])
                keys, low = bands(signed).view(np.int64), iter(signed.astype(np.uint8))
                sketch = pa.array([next(low).tobytes() if n else b"" for n in sizes], pa.binary())
                edge = np.concatenate([[0], np.cumsum((sizes > 0) * (COORDINATES // ROWS))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(keys.ravel()))
                columns = [part.column(0), part.column(1), pa.array(node[:, 0]), pa.array(node[:, 1]), pa.array(sizes.astype(np.int64)), lists, sketch]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node_hi", "node_lo", "size", "bands", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, row bigint, node_hi bigint, node_lo bigint, size bigint, bands array<bigint>, sketch binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _checked(pairs: DataFrame, texts: DataFrame, least: float, counted: bool) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar, compared by their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for half in slices(batch, 2, BATCH_BYTES):
                for part in slices(half, 3, BATCH_BYTES):
                    alike = []
                    centres = part.column(3).dictionary_encode()
                    one, two = shingle_sets(part.column(2), counted), shingle_sets(centres.dictionary, counted)
                    starts = _begins(two[1])
                    for a, n, c in zip(_begins(one[1]).tolist(), one[1].tolist(), centres.indices.to_pylist(), strict=True):
                        alike.append(similarity(one[0][a : a + n], two[0][starts[c] : starts[c] + two[1][c]]) >= least)
                    yield part.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements any two of the sets share, above the diagonal."""
    m = len(sets)
    value, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    holders = np.diff(np.append(start, len(value)))
    column, held = np.repeat(np.cumsum(holders > FEW) - 1, holders), np.repeat(holders, holders)
    out = np.zeros((m, m))
    few = (held > 1) & (held <= FEW)
    v, o = value[few], owner[few]
    for apart in range(1, FEW):
        same = v[apart:] == v[:-apart]
        if not same.any():
            break
        out += np.bincount(o[:-apart][same] * m + o[apart:][same], minlength=m * m).reshape(m, m)
    o, c = owner[held > FEW], column[held > FEW]
    for at in range(0, int(c[-1]) + 1 if len(c) else 0, COLUMNS):
        lo, hi = np.searchsorted(c, [at, at + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)
        x[o[lo:hi], c[lo:hi] - at] = 1
        out += x @ x.T
    return np.triu(out, 1)


def likely(key: int, bands_: np.ndarray, sketches: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which nodes agree in ``AGREE`` coordinates with one of another class, where ``key`` is the first band that both have.

    A pair is so looked at in one bucket only. If a node is the centre of
    that bucket, which is not here, the pair has been compared before.
    """
    out = np.zeros(len(sketches), bool)
    for at in range(0, len(sketches), 32):
        agree = (sketches[at : at + 32, None] == sketches[None]).sum(2) >= AGREE
        i, j = np.nonzero(agree & (classes[at : at + 32, None] != classes[None]))
        same = bands_[i + at] == bands_[j]
        here = bands_[j, same.argmax(1)] == key
        out[i[here] + at] = True
    return out


def _blocked(left: DataFrame, own: DataFrame) -> DataFrame:
    """``key, lo, hi, id, class``: a bucket's nodes dealt to blocks of bounded size, any two of which meet in one group.

    Nodes of the bucket's largest class don't meet each other.
    """
    placed = left.join(own.select("id", (8 * F.col("size")).alias("bytes")), "id")
    parts = placed.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    most = parts.groupBy("key").agg(F.max(F.struct("n", "class", "bytes")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

    most = most.select(
        "key", F.col("most.class").alias("largest"), blocks(F.col("most.n"), F.col("most.bytes")).alias("p"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("q")
    )
    dealt = left.join(most, "key").withColumn("inside", F.col("class") == F.col("largest"))
    mine = F.when(F.col("inside"), F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("id"), F.col("q"))).cast("bigint")
    other = F.explode(F.sequence(F.when(F.col("inside"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1))
    dealt = dealt.withColumn("mine", mine).select("key", "id", "class", "mine", other.alias("other"))
    other = F.col("other").cast("bigint")
    return dealt.select("key", "id", "class", F.least("mine", other).alias("lo"), F.greatest("mine", other).alias("hi"))


def _compared(left: DataFrame, own: DataFrame, texts_of, least: float, counted: bool, scratch: Scratch) -> DataFrame:
    """The similar pairs ``a, b`` of any two nodes of different classes in a bucket of ``key, id, class``.

    Blocks are compared by sketches first; only nodes that are likely to have
    a partner in their block are compared by their whole sets.
    """

    def suspect(group: pa.Table) -> pa.Table:
        lean()
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        own = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sketches), -1)
        found = likely(group.column("key")[0].as_py(), own, sketches, group.column("class").to_numpy())
        return group.select(["key", "lo", "hi", "id", "class"]).filter(pa.array(found))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                values, sizes = shingle_sets(part.column(1), counted)
                found = [values[a : a + n].tobytes() for a, n in zip(_begins(sizes).tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["id", "own"])

    def compare(group: pa.Table) -> pa.Table:
        lean()
        ids, classes = (group.column(n).to_numpy() for n in ("id", "class"))
        found = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        size, both = np.array([len(x) for x in found]), overlaps(found)
        good = np.triu(both / (size[:, None] + size[None, :] - both) >= least, 1) & (classes[:, None] != classes[None, :])
        i, j = np.nonzero(good)
        return pa.table({"a": pa.array(np.minimum(ids[i], ids[j])), "b": pa.array(np.maximum(ids[i], ids[j]))})

    blocks = _blocked(left, own).join(own.select("id", "bands", "sketch"), "id").select("key", "lo", "hi", "id", "class", "bands", "sketch")
    some = scratch.write(blocks.groupBy("key", "lo", "hi").applyInArrow(suspect, "key bigint, lo bigint, hi bigint, id bigint, class bigint"), "suspects")
    whole = scratch.write(texts_of(some.select("id").distinct()).select("id", "text").mapInArrow(sets, "id bigint, own binary"), "open-sets")
    return some.join(whole, "id").groupBy("key", "lo", "hi").applyInArrow(compare, "a bigint, b bigint").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, class`` of the nodes that have links: the least id that links lead to.

    By label passing with pointer jumping. Only least labels are gathered, so
    a node with very many links is pre-aggregated; each round is written to
    the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write(both, f"{name}-ends")
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("class")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        new = labels.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "near").alias("to"))
        jump = new.select(F.col("id").alias("to"), F.col("to").alias("further"))
        new = new.join(jump, "to").select("id", "was", F.least("to", "further").alias("class"))
        step += 1
        new = scratch.write(new, f"{name}-{step}")
        if new.where("class != was").isEmpty():
            return new.select("id", "class")
        labels = new.select("id", "class")


def _merged(classes: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Classes after further links: labels pass between the classes that these join, not within them."""
    mine, yours = (classes.select(F.col("id").alias(x), F.col("class").alias(f"class_{x}")) for x in "ab")
    joined = links.join(mine, "a", "left").join(yours, "b", "left")
    ends = [F.coalesce(f"class_{x}", x) for x in "ab"]
    over = components(joined.select(ends[0].alias("a"), ends[1].alias("b")).where("a != b"), scratch, name)
    old = classes.join(over.select(F.col("id").alias("class"), F.col("class").alias("top")), "class", "left").select("id", F.coalesce("top", "class").alias("class"))
    new = over.join(classes, "id", "left_anti").select("id", "class")
    return scratch.write(old.unionByName(new), f"{name}-merged")


def links(nodes: DataFrame, texts_of, scratch: Scratch, least: float = LEAST, counted: bool = False) -> DataFrame:
    """``id, class`` of those nodes ``id, size, bands, sketch`` that have links.

    ``texts_of(ids)`` gives ``id, text`` of the asked ids. Of each bucket the
    node with the fullest buckets, its centre, is compared with all: as many
    pairs as there are nodes in buckets. Then the nodes besides the centre of
    a bucket that are in several classes are compared with each other, so no
    bucket has two classes that a link of its nodes would join.
    """
    met = nodes.select("id", F.explode("bands").alias("key"))
    full = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.write(met.join(full, "key"), "met")
    own = scratch.write(met.groupBy("id").agg(F.sum("n").alias("fame")).join(nodes, "id"), "fame")
    centre = met.join(own.select("id", "fame"), "id").groupBy("key").agg(F.max(F.struct("fame", "id")).alias("c"))
    centre = scratch.write(centre.select("key", F.col("c.id").alias("b")), "centres")
    around = met.select("key", "id").join(centre, "key").where("id != b")
    pairs = around.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    near = pairs.join(own.select(F.col("id").alias("a"), F.col("bands").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("bands").alias("y")), "b")
    close = scratch.write(near.where(F.size(F.array_intersect("x", "y")) >= SHARED).select("a", "b"), "pairs")
    texts = texts_of(close.select("a").union(close.select("b")).distinct().toDF("id"))
    classes = components(scratch.write(_checked(close, texts, least, counted), "links"), scratch, "classes")
    placed = around.select("key", "id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = placed.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("key")
    left = scratch.write(placed.join(mixed, "key", "left_semi"), "open")
    if not left.isEmpty():
        good = scratch.write(_compared(left, own, texts_of, least, counted, scratch), "links-open")
        if not good.isEmpty():
            classes = _merged(classes, good, scratch, "classes-open")
    return classes


def classify(docs: DataFrame, scratch: Scratch, least: float = LEAST, counted: bool = False) -> DataFrame:
    """``doc_id, row, class_id, first`` of each row.

    Classes are the texts that chains of links of at least ``least`` lead to,
    by similarity of the sets of five-word shingles (if ``counted``, each as
    often as it occurs). A text of fewer words has one shingle; null and empty
    texts and those without words are all equal. ``class_id`` is the least
    doc_id of the class, and ``first`` marks the row that has it; of several,
    the one with the least ``row``, a hash of the text. Rows that repeat a
    doc_id with unlike texts are in classes of their own, which may then bear
    one number. Rows without a doc_id come after all others; a class of only
    such rows has a negative number made of its least ``row``. Rows alike in
    doc_id and text are all marked if one is. An empty table has no classes.
    """
    signed = scratch.write(sign(docs, counted), "signed")
    sets = signed.groupBy("node_hi", "node_lo").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("least"), *[F.first(c).alias(c) for c in ("size", "bands", "sketch")])
    sets = scratch.write(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    nodes = sets.where("size > 0").select("id", "size", "bands", "sketch")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = scratch.write(sets.join(ids, "id", "left_semi").select("id", "least.doc_id", "least.row"), f"asked-{texts_of.turn}")
        texts_of.turn += 1
        some = sifted(_texts(docs), wanted, ["doc_id", "row"])[1]
        rows = some.alias("t").join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.row") == F.col("w.row")))
        return rows.groupBy("id").agg(F.first("text").alias("text"))

    texts_of.turn = 0
    classes = links(nodes, texts_of, scratch, least, counted)
    known = sets.select("node_hi", "node_lo", "id", "least").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    heads = known.groupBy("class").agg(F.min("least").alias("head"))
    known = scratch.write(known.join(heads, "class").select("node_hi", "node_lo", "head"), "known")
    scratch.keep("signed", "known")
    out = signed.select("doc_id", "row", "node_hi", "node_lo").join(known, ["node_hi", "node_lo"])
    class_id = F.coalesce("head.doc_id", -1 - F.shiftrightunsigned("head.row", 2))
    return out.select("doc_id", "row", class_id.alias("class_id"), (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row") == F.col("head.row"))).alias("first"))


def keep_first(docs: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """One row of each class, the one that ``classify`` marks, with the documents' own columns.

    Of rows alike in doc_id and text one stays. Null, empty and wordless texts
    are one class; an empty table stays empty; columns may have any names.
    """
    found = scratch.write(classify(docs, scratch, least), "found")
    many = found.where("first").groupBy("doc_id", "row").count().where("count > 1")
    gone = scratch.write(found.where("not first").select(F.col("doc_id").alias("id"), "row").distinct(), "gone")
    own = Sheltered(docs)
    rows = own.df.withColumn("id", own.col("doc_id").cast("bigint")).withColumn("row", F.xxhash64(F.coalesce(own.col("text"), F.lit(""))))
    repeated = scratch.write(many.select(F.col("doc_id").alias("id"), "row"), "repeated")
    others, some = sifted(rows, gone.unionByName(repeated), ["id", "row"])
    same = F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.row") == F.col("g.row"))
    kept = some.alias("r").join(gone.alias("g"), same, "left_anti")
    if not repeated.isEmpty():  # all other rows that are kept are the only ones of their id and text
        kept = kept.dropDuplicates(["id", "row"])
    return own.restore(others).unionByName(own.restore(kept))
