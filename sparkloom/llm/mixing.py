"""Mixing of sources to target weights, with DataFrame functions only.

The token budget runs down a tree of domain, language and source. At each node
the children share by weight; a child that cannot use its share (its tokens
times the epochs allowed) leaves the rest to its siblings, and only what a
whole subtree cannot use goes to the siblings of an ancestor. Each leaf then
takes whole epochs, and of one more epoch the documents that come first in
that epoch's seeded order, as far as its tokens go.

All arithmetic is on integers, so any partitioning gives the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, Sheltered

LEVELS = ("domain", "lang", "source")
#: Production parameters: weights by level (others weigh OTHER), budget in percent of all tokens, epochs, seed.
WEIGHTS = {"domain": {"note": 20, "article": 50, "book": 30}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
OTHER, BUDGET_PERCENT, EPOCHS, SEED = 10, 60, 2, 17
#: An order key has 60 bits; leaves are summed in 2^12 ranges of it.
KEY_DIGITS, RANGE_SHIFT = 15, 48


def domain_of(text: Column) -> Column:
    """The default domain, by the form of the text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 1000, "note").when(n < 8000, "article").otherwise("book")


def leaf_columns(docs: DataFrame, domain: Column | None = None) -> list[Column]:
    """Names of a document's leaf; a null language or source is the empty name."""
    return [
        (domain_of(F.col("text")) if domain is None else F.coalesce(domain, F.lit(""))).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
    ]


def order_key(doc_id: Column, epoch: Column, seed: int = SEED) -> Column:
    """A document's place in an epoch: 60 bits of a digest of seed, epoch and id (null id: empty)."""
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("bigint")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    own = weights.get(level, {})
    return reduce(lambda c, kv: F.when(F.col(level) == kv[0], F.lit(kv[1])).otherwise(c), own.items(), F.lit(OTHER)).cast("bigint")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Deal each parent's ``budget`` to its children by ``weight``, at most their ``room``.

    Children are taken by rising room for each unit of weight; one is filled
    if even an even share of what is left would be more than its room. The
    rest is shared by those not filled.
    """
    group = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = group.orderBy(F.col("room") / F.col("weight"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    full = F.col("room") * F.sum("weight").over(onward) <= (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0))) * F.col("weight")
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(group), F.lit(0))
    return (
        nodes.where("weight > 0").withColumn("full", full)
        .withColumn("left", left).withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
        .withColumn("got", F.when(F.col("full"), F.col("room")).otherwise(F.expr("left * weight div open")))
        .drop("full", "left", "open")
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, got``: the tokens that each leaf gets.

    ``leaves`` has one row per leaf with its ``tokens``; leaves without tokens
    or weight get nothing and are left out.
    """
    nodes = leaves.where("tokens > 0").withColumn("room", F.col("tokens") * epochs)
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parent, own = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        children = nodes.groupBy(*own).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(level, weights))
        if above is None:  # the domains are few; the whole budget is a sum over them
            all_tokens, all_room = (F.sum(c).over(W.partitionBy(F.lit(0))) for c in ("tokens", "room"))
            children = children.withColumn("all", all_tokens).withColumn("budget", F.least(F.expr(f"all * {percent} div 100"), all_room)).drop("all")
        else:
            children = children.join(above, parent)
        above = _share(children, parent, level).select(*own, *(["tokens"] if depth == 2 else []), F.col("got").alias("budget"))
    return above.withColumnRenamed("budget", "got")


def plan(docs: DataFrame, scratch: Scratch, weights: dict | None = None, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(slim, cuts)``.

    ``slim``: doc_id, leaf and n_tokens (words) of each document. ``cuts``:
    for each leaf, ``whole`` epochs that it takes in full and ``cut``, the
    last order key taken from the next epoch (-1: none). Documents with equal
    keys (repeated rows) are taken or left together.
    """
    leaf = list(LEVELS)
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    slim = scratch.write(docs.select("doc_id", *leaf_columns(docs, domain), words.alias("n_tokens")), "slim")
    leaves = slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    got = scratch.write(
        budgets(leaves, WEIGHTS if weights is None else weights, percent, epochs)
        .withColumn("whole", F.expr("got div tokens")).withColumn("rest", F.expr("got % tokens")),
        "budgets",
    )
    keyed = slim.where("n_tokens > 0").join(got.where("rest > 0").select(*leaf, "whole", "rest"), leaf).withColumn("key", order_key(F.col("doc_id"), F.col("whole") + 1, seed))
    keyed = keyed.withColumn("span", F.shiftright("key", RANGE_SHIFT))
    spans = keyed.groupBy(*leaf, "span", "rest").agg(F.sum("n_tokens").alias("t"))  # 4096 rows a leaf at most
    upto = F.sum("t").over(W.partitionBy(*leaf).orderBy("span"))
    edge = spans.withColumn("base", upto - F.col("t")).where("base <= rest and base + t > rest").select(*leaf, "span", "base")
    inside = keyed.join(edge, [*leaf, "span"]).groupBy(*leaf, "span", "base", "rest", "key").agg(F.sum("n_tokens").alias("t"))
    run = F.sum("t").over(W.partitionBy(*leaf, "span").orderBy("key"))
    inside = inside.withColumn("sum", F.col("base") + run).groupBy(*leaf, "span").agg(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("key"))).alias("at"))
    inside = inside.withColumn("cut", F.coalesce("at", F.shiftleft("span", RANGE_SHIFT) - 1)).select(*leaf, "cut")
    cuts = got.select(*leaf, "whole").join(inside, leaf, "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("bigint")))
    return slim, scratch.write(cuts, "cuts")


def taken(rows: DataFrame, cuts: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (with leaf columns and doc_id) once for each ``epoch`` in which they are taken.

    Only the small table of cuts is joined; the rows themselves stay where
    they are while it is small enough to be broadcast by the planner.
    """
    more = (order_key(F.col("doc_id"), F.col("whole") + 1, seed) <= F.col("cut")).cast("bigint")
    return (
        rows.join(cuts, list(LEVELS)).withColumn("__times", F.col("whole") + more).where("__times > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times")))).drop("__times", "whole", "cut")
    )


def mix(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch`` for each taken document and epoch.

    Documents without words are never taken; an empty table gives no rows.
    """
    slim, cuts = plan(docs, scratch, **how)
    return taken(slim.where("n_tokens > 0"), cuts, how.get("seed", SEED)).select("doc_id", *LEVELS, "n_tokens", "epoch")


def mixed_documents(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The documents that the mixture takes, with their own columns, once for each epoch."""
    _, cuts = plan(docs, scratch, **how)
    own = Sheltered(docs)
    leaf = [c.alias(name) for c, name in zip(leaf_columns(docs, how.get("domain")), LEVELS, strict=True)]
    rows = docs.where(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    rows = rows.select(*[F.col(f"`{n}`").alias(i) for n, i in own.inner.items()], *leaf, F.col("doc_id"))
    return own.restore(taken(rows, cuts, how.get("seed", SEED)))


def oracle_sql() -> str:
    """The same mixture in DuckDB SQL, from the same parameters."""

    def weight(level: str) -> str:
        whens = "".join(f" when {level} = '{k}' then {v}" for k, v in WEIGHTS[level].items())
        return f"(case{whens} else {OTHER} end)::bigint" if whens else f"{OTHER}::bigint"

    steps = []
    for depth, level in enumerate(LEVELS):
        own, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"partition by {parent} " if depth else ""
        above = f"join got{depth} using ({parent})" if depth else "cross join whole"
        steps.append(f"""
kids{depth} as (select {own}, sum(room)::hugeint room, sum(tokens)::hugeint tokens, {weight(level)} weight from leaves group by {own}),
fill{depth} as (select *, room * sum(weight) over ({by}order by room / weight::double, {level} rows between current row and unbounded following)
    <= (budget - coalesce(sum(room) over ({by}order by room / weight::double, {level} rows between unbounded preceding and 1 preceding), 0)) * weight as is_full
  from kids{depth} {above}),
got{depth + 1} as (select {own}, tokens, case when is_full then room else
    (budget - coalesce(sum(room) filter (is_full) over ({by.strip()}), 0)) * weight // sum(weight) filter (not is_full) over ({by.strip()}) end as budget
  from fill{depth})""".replace("select *, room", f"select kids{depth}.*, budget, room"))
        if depth < 2:
            steps[-1] = steps[-1].replace(f"got{depth + 1} as (select {own}, tokens,", f"got{depth + 1} as (select {own},")
    return f"""
with slim as (select doc_id, case when length(coalesce(text, '')) < 1000 then 'note' when length(coalesce(text, '')) < 8000 then 'article' else 'book' end as domain,
    coalesce(lang, '') as lang, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::hugeint tokens, sum(n_tokens)::hugeint * {EPOCHS} room from slim group by all having sum(n_tokens) > 0),
whole as (select least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(room)) budget from leaves),{",".join(steps)},
parts as (select domain, lang, source, (budget // tokens)::bigint as n_whole, budget % tokens as rest from got3),
keyed as (select slim.*, n_whole, rest, sum(n_tokens) over (partition by domain, lang, source order by
    ('0x' || substr(md5('{SEED}|' || (n_whole + 1) || '|' || coalesce(doc_id::varchar, '')), 1, {KEY_DIGITS}))::bigint) as upto
  from slim join parts using (domain, lang, source) where n_tokens > 0),
times as (select *, n_whole + (upto <= rest)::bigint as times from keyed)
select doc_id, domain, lang, source, n_tokens, unnest(range(1, times + 1)) as epoch from times where times > 0"""
