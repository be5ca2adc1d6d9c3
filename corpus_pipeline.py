"""The corpus pipeline: five operators in a row over the documents.

Each stage is written as Parquet and read again as the next one's input. All
but the last return the columns of the documents, whatever others there are
and whatever they are called. Null texts count as empty, texts of any length
are worked on whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixing, neardup, substring, toxicity
from sparkloom.llm.common import Scratch, Sheltered, documents, table
from sparkloom.llm.queries import BYTE_BPE

#: Production mixture of the pipeline: nine tenths of the words that are left, each document once.
BUDGET_PERCENT, EPOCHS = 90, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the stage's own input.

    Every row is judged by its own text, rows that repeat an id too. Null and
    empty texts stay unless most of what the model learnt from is toxic;
    without labels nothing is rejected.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    own = Sheltered(docs)
    scored = toxicity.score(own.df, model, list(own.inner.values()), own.inner["text"])
    return own.restore(scored.where(F.col("score") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates.

    It is the one with the least id, and of rows that repeat it with texts of
    one class the one whose text hashes least; rows without an id come last.
    Rows that repeat an id with unlike texts are in classes of their own. All
    texts without words are one class, of which one stays.
    """
    return neardup.keep_first(docs, Scratch(spark, "neardup"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document's windows cover.

    Rows of one id don't affect each other, a null id comes after all others;
    texts under fifty words and those that lose nothing stay as they are. No
    row is dropped: a text that repeats wholly becomes empty.
    """
    return substring.cut_documents(docs, Scratch(spark, "substring"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target mixture takes, each once.

    Ties of the seeded order go to the smaller id; rows that repeat an id are
    taken together; null languages and sources are leaves of their own; texts
    without words use up nothing.
    """
    return mixing.mixed_documents(docs, Scratch(spark, "mixing"), percent=BUDGET_PERCENT, epochs=EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, as digests: a row for each row; the null text has those of the empty one."""
    coded = bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Models and rolling hashes are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each read from what the one before wrote; what stages wrote for themselves is removed."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with Scratch.removed():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
