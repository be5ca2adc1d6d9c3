"""Bottom-k sketches of word shingles, with SQL functions only.

A sketch is the sorted array of the ``K`` least distinct hashes of a text's
five-word shingles. Sketches of parts merge into the sketch of the whole; two
sketches estimate resemblance and containment, one the number of distinct
shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

K, SHINGLE = 128, 5
_SPACE = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Add ``name``, the sketch of column ``text``.

    A text of fewer than five words but at least one has one shingle, all its
    words; a null or empty text has none and an empty sketch.
    """
    h = f"__{name}_words"
    words = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    at = [F.col(h)] * SHINGLE
    shingles = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(a, i + j) for j, a in enumerate(at)]))
    short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    made = F.when(F.size(h) >= SHINGLE, shingles).otherwise(short)
    return df.withColumn(h, words).withColumn(name, F.slice(F.sort_array(F.array_distinct(made)), 1, k)).drop(h)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each key of the parts' sketches; ties and repeats count once.

    The k least are kept before the shuffle and after it, so a key with many
    parts does not gather in one task.
    """
    hashes = df.select(*keys, F.explode_outer(sketch).alias("__h")).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("__h").asc_nulls_last()))
    return hashes.withColumn("__r", rank).where(F.col("__r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def with_resemblance(df: DataFrame, a: str, b: str, name: str, k: int = K) -> DataFrame:
    """Add ``name``, the estimated Jaccard similarity: 1 if both are empty, 0 if one is."""
    u = f"__{name}_union"
    both = F.size(F.array_intersect(F.array_intersect(u, a), F.col(b)))
    value = F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u)).cast("double")
    return df.withColumn(u, union(F.col(a), F.col(b), k)).withColumn(name, value).drop(u)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = F.element_at(sketch, -1).cast("double") / F.lit(2.0**64) + 0.5
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((F.lit(k) - 1) / largest)


def with_containment(df: DataFrame, a: str, b: str, name: str, k: int = K) -> DataFrame:
    """Add ``name``, the estimated share of a's shingles that b holds (1 if a has none)."""
    r, u = f"__{name}_r", f"__{name}_u"
    df = with_resemblance(df, a, b, r, k).withColumn(u, union(F.col(a), F.col(b), k))
    value = F.least(F.lit(1.0), F.col(r) * distinct_count(F.col(u), k) / distinct_count(F.col(a), k))
    return df.withColumn(name, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(value)).drop(r, u)


def text_form(sketch: Column) -> Column:
    """A sketch as text: its hashes in order, sixteen hex digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


_KEYS = ["id", "row"]
#: Stands for a null doc_id, which comes last in descending order.
NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key without nulls; ``row`` tells texts with one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"))


def following(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, row, third, next_id, next_row``: each document's successor by descending id.

    Only ids and lengths are sorted, in ranges; the last of each range is
    followed by the first of the next range that has rows, and the last of all
    by the first. Texts with one id follow each other by hash; identical rows
    are one document; null ids come last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = _keyed(docs).select(*_KEYS, F.expr("length(text) div 3").cast("int").alias("third"))
    slim = slim.repartitionByRange(parts, F.col("id").desc()).withColumn("part", F.spark_partition_id())
    slim = scratch.write(slim, "ids").distinct()
    order = [F.col("id").desc(), F.col("row")]
    here = W.partitionBy("part").orderBy(*order)
    own = slim.withColumn("next", F.lead(F.struct("id", "row")).over(here))
    # one row for each part: its first document, given to the part before it
    heads = slim.groupBy("part").agg(F.max(F.struct(F.col("id"), (-F.col("row") - 1).alias("back"))).alias("h"))
    heads = heads.select("part", F.struct(F.col("h.id").alias("id"), (-F.col("h.back") - 1).alias("row")).alias("head"))
    ring = W.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring))).select("part", "after")
    out = own.join(heads, "part").withColumn("next", F.coalesce("next", "after"))
    return scratch.write(out.select(*_KEYS, "third", F.col("next.id").alias("next_id"), F.col("next.row").alias("next_row")), "next")


def edited_fingerprints(docs: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """Sketches of each text, of its edited text, and how near they and the next text are.

    The edited text replaces the last third of the characters by the first as
    many of the next document. Each text is shuffled once, by its key; of the
    next document only the needed prefix and its sketch travel. An only
    document is its own successor.
    """
    links = following(docs, scratch)
    texts = _keyed(docs).repartition("id", "row")
    as_next = links.select(F.col("next_id").alias("id"), F.col("next_row").alias("row"), F.col("id").alias("to_id"), F.col("row").alias("to_row"), "third")
    lent = with_sketch(texts.join(as_next, _KEYS), "text", "next_sketch", k)
    lent = lent.select(F.col("to_id").alias("id"), F.col("to_row").alias("row"), "third", F.expr("substring(text, 1, third)").alias("tail"), "next_sketch")
    repeated = links.agg(F.count("*")).first()[0] != docs.count()
    if repeated:  # copies of a row lend the same
        lent = lent.groupBy("id", "row", "third").agg(F.first("tail").alias("tail"), F.first("next_sketch").alias("next_sketch"))
    both = texts.join(lent, _KEYS).withColumn("n_chars", F.length("text").cast("bigint"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - third)"), F.col("tail")))
    both = with_sketch(with_sketch(both, "text", "sketch", k), "edited", "edited_sketch", k)
    both = with_resemblance(with_resemblance(both, "sketch", "edited_sketch", "near_edited", k), "sketch", "next_sketch", "near_next", k)
    # the id is taken back from the key, so that both uses of the shuffled texts read the same exchange
    return both.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited", "sketch", "edited_sketch", "near_edited", "near_next")
