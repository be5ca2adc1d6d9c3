"""The queries of the training-data operators, over whole tables.

Each applies its operator with production parameters; the digest columns that
a query returns are derived here from the operator's real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, html, mixing, neardup, quality, substring, tokenstore, toxicity
from .common import Scratch, crc_mod, documents, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    coded = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _verdicts(scored: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _verdicts(quality.score(docs, model), quality.FOLDS, quality.HELD_OUT, quality.THRESHOLD)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a repeated window of fifty words covers, removed from every document."""
    done = substring.dedup(documents(spark, sf_dir), Scratch(spark, "substring"))
    kept = F.when(F.col("kept").isNull(), F.col("sha")).otherwise(F.sha2(F.col("kept").cast("binary"), 256))
    return done.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text."""
    made = fingerprints.edited_fingerprints(documents(spark, sf_dir), Scratch(spark, "fingerprints"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.text_form(F.col("sketch")).alias("fingerprint"),
        fingerprints.text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document; one of each class is kept."""
    found = neardup.classify(documents(spark, sf_dir), Scratch(spark, "neardup"))
    return found.select("doc_id", "class_id", F.col("first").alias("kept"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages"), html.train(), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _verdicts(toxicity.score(docs, model), toxicity.FOLDS, toxicity.HELD_OUT, toxicity.THRESHOLD)


def op8_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to compact files and read back."""
    written = tokenstore.write(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), Scratch(spark, "tokenstore"))
    return tokenstore.read(written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and epochs that the production mixture takes."""
    return mixing.mix(documents(spark, sf_dir), Scratch(spark, "mixing"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every fiftieth embedding."""
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(rows, ann.every_fiftieth(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_substring": op3_substring,
    "op4_fingerprints": op4_fingerprints,
    "op5_neardup": op5_neardup,
    "op6_html": op6_html,
    "op7_toxicity": op7_toxicity,
    "op8_tokenstore": op8_tokenstore,
    "op9_mixing": op9_mixing,
    "op10_ann": op10_ann,
}

_WORDS = r"select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents"

#: Every window of every document, against the least id that holds it.
SUBSTRING_SQL = f"""
with w as ({_WORDS}),
win as (select doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50)),
least_id as (select h, min(doc_id) as f from win group by h),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as i from win join least_id using (h) where doc_id > f),
word as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as t, count(*) as n from word left join (select *, true as g from gone) using (doc_id, i) where g is null group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""

#: All pairs that share a shingle, and what their links lead to.
NEARDUP_SQL = f"""
with recursive w as ({_WORDS}),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) else [array_to_string(ws, ' ')] end) as x from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as p, b.doc_id as q, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
link as (select p, q from shared join n a on a.doc_id = p join n b on b.doc_id = q where 5 * c >= 4 * (a.n + b.n - c)),
edge as (select p, q from link union all select q, p from link),
reach(doc_id, other) as (select doc_id, doc_id from w union select doc_id, q from reach join edge on other = p)
select doc_id, min(other) as class_id, min(other) = doc_id as kept from reach group by doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op3_substring": SUBSTRING_SQL,
    "op5_neardup": NEARDUP_SQL,
    "op9_mixing": mixing.oracle_sql(),
}
