"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domains, languages and sources in proportion to weights. What a node can't use, because its
leaves have too few tokens even when repeated for the allowed number of epochs, goes to its siblings first; only what a whole
family can't use goes up to the siblings of their parent. Each leaf then takes its documents in an order seeded anew for each
epoch: whole epochs, and of the last one the prefix that the budget covers. Only DataFrame operations are used.

Where a leaf's prefix ends is found digit by digit of the seeded order, so that a leaf with a third of all rows is never sorted in
one task, and only one row for each leaf meets the documents again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._base import Scratch, table


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level; a name without one has `other`. budget is in tokens, or else a share of all tokens."""

    domains: dict[str, float] = field(default_factory=lambda: {"web": 0.4, "books": 0.3, "forum": 0.2, "code": 0.1})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1})
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 0.05
    other_source: float = 1.0
    budget: int | None = None
    share: float = 0.6
    epochs: int = 3
    seed: int = 11
    per_bucket: int = 4096


def tokens(text: Column) -> Column:
    """Tokens are counted as words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """The domain of a source of the synthetic tables: five sources each, by their number."""
    n = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    k = F.when(n != "", n.cast("bigint"))
    return F.when(k < 5, "web").when(k < 10, "books").when(k < 15, "forum").when(k < 20, "code").otherwise("other")


def weight(name: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for k, v in sorted(weights.items()):
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def shares(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes(parent.., child, w, cap, budget of the parent) with `given`: as much of the parent's budget as the weight asks for, no more than
    cap; what some can't take is dealt to the others by weight. The least cap for its weight is full first."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), child)
    used = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    out = nodes.withColumn("_level", (F.col("budget") - used) / rest).withColumn("_full", F.col("cap") <= F.col("_level") * F.col("w"))
    # behind the full ones all others have the level of the first of them
    level = F.min(F.when(~F.col("_full"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col(child).alias("c"), F.col("_level").alias("v")))).over(by)
    return out.withColumn("given", F.when(F.col("_full"), F.col("cap")).otherwise(level["v"] * F.col("w"))).drop("_level", "_full")


def budgets(leaves: DataFrame, m: Mix) -> DataFrame:
    """leaves(domain, lang, source, have) with epochs (whole ones) and rest (tokens of the last, partial one).

    There is a row for each leaf, so what a window holds is the children of one node, and of the domains all.
    """
    tree = leaves.withColumn("cap", F.col("have").cast("double") * m.epochs)
    total = F.lit(float(m.budget)) if m.budget is not None else F.sum("have").over(W.partitionBy(F.lit(0))) * m.share
    up = tree.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("have").alias("have")).withColumn("budget", total.cast("double")).withColumn("w", weight(F.col("domain"), m.domains, m.other))
    up = shares(up, [], "domain").select("domain", F.col("given").alias("budget"))
    mid = tree.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(up, "domain").withColumn("w", weight(F.col("lang"), m.languages, m.other))
    mid = shares(mid, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    low = tree.join(mid, ["domain", "lang"]).withColumn("w", weight(F.col("source"), m.sources, m.other_source))
    low = shares(low, ["domain", "lang"], "source").withColumn("given", F.floor(F.col("given") + 1e-6).cast("bigint"))
    whole = F.when(F.col("have") > 0, F.expr("given DIV have")).otherwise(0)
    return low.select("domain", "lang", "source", "have", "given", whole.cast("bigint").alias("epochs")).withColumn("rest", F.col("given") - F.col("epochs") * F.col("have"))


#: Hexadecimal digits of the seeded order that a round of `stops` looks at.
DIGITS = 3


def stops(held: DataFrame, plan: DataFrame, scratch: Scratch, m: Mix) -> DataFrame:
    """plan(domain, lang, source, epochs, rest) with stop_key and stop_n: where, in the leaf's seeded order, the prefix ends that `rest` covers; null
    where all of the leaf fits.

    The place is found digit by digit: a round adds up tokens by the next DIGITS of the keys and goes on in the one group in which the budget
    ends, so a window never holds more than 16**DIGITS rows of a leaf. The last of them has about `per_bucket` rows.
    """
    leaf = ["domain", "lang", "source"]
    rounds = max(0, math.ceil(math.log(max(held.count(), 1) / m.per_bucket, 16**DIGITS)))
    at = plan.select(*leaf, "epochs", "rest", F.lit("").alias("_prefix"), F.lit(0).cast("bigint").alias("_before"))
    order = W.partitionBy(*leaf)
    for k in range(rounds + 1):
        inside = held.join(at, leaf).withColumn("_key", order_key(m)).where(F.substring("_key", 1, DIGITS * k) == F.col("_prefix"))
        last = k == rounds
        part = F.struct(F.col("_key").alias("k"), F.col("n_tokens").alias("n")) if last else F.struct(F.substring("_key", 1, DIGITS * (k + 1)).alias("k"), F.lit(0).cast("bigint").alias("n"))
        sums = inside.groupBy(*leaf, "rest", "_before", part.alias("_part")).agg(F.sum("n_tokens").alias("_n"))
        sums = sums.withColumn("_end", F.col("_before") + F.sum("_n").over(order.orderBy("_part"))).where("_end > rest")
        first = sums.groupBy(*leaf).agg(F.min(F.struct("_part", (F.col("_end") - F.col("_n")).alias("_b"))).alias("_f"))
        if last:
            found = first.select(*leaf, F.col("_f._part.k").alias("stop_key"), F.col("_f._part.n").alias("stop_n"))
        else:
            found = first.select(*leaf, F.col("_f._part.k").alias("_prefix"), F.col("_f._b").alias("_before"))
            at = scratch.write(plan.select(*leaf, "epochs", "rest").join(found, leaf), f"stops-{k}")
    return plan.select(*leaf, "epochs").join(found, leaf, "left")


def order_key(m: Mix) -> Column:
    """The place of a document in the order of its leaf's last epoch."""
    return F.md5(F.concat_ws(":", F.lit(m.seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def mix_sources(df: DataFrame, scratch: Scratch, m: Mix = Mix(), keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, domain, lang, source, epoch, n_tokens of every chosen copy of a row of df(doc_id, text, lang, source, ..), and the columns of
    df named in keep as a struct `row`.

    A null lang or source is the name `unknown`. A document without a word has no tokens; it is chosen with those before it in
    the order. A leaf's prefix ends before the first document that doesn't fit. Rows of a leaf that share doc_id and number of tokens, repeated
    ones and those without doc_id among them, are one document in this: all are chosen, or none.

    Budgets are worked out from keys and counts. df is read a second time for the columns in keep, and its texts are neither written nor
    shuffled where the table of leaves is small enough to be broadcast; that is for the optimizer to check. A very long text is one row.
    """
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    leaf = ["domain", "lang", "source"]
    rows = df.select("doc_id", domain_of(F.col("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), tokens(F.col("text")).alias("n_tokens"), *([F.struct(*(df[c] for c in keep)).alias("row")] if keep else []))
    held = scratch.write(rows.drop("row"), "held")
    plan = scratch.write(budgets(held.groupBy(*leaf).agg(F.sum("n_tokens").alias("have")), m), "plan")
    until = scratch.write(stops(held, plan, scratch, m), "until")
    dealt = (rows if keep else held).join(until, leaf).withColumn("_key", order_key(m))
    covered = F.col("stop_key").isNull() | (F.col("_key") < F.col("stop_key")) | ((F.col("_key") == F.col("stop_key")) & (F.col("n_tokens") < F.col("stop_n")))
    dealt = dealt.withColumn("_times", F.col("epochs") + F.when(covered, 1).otherwise(0)).where("_times > 0")
    dealt = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)))
    return dealt.select("doc_id", *leaf, "epoch", "n_tokens", *(["row"] if keep else []))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


OP5_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         CASE WHEN NOT regexp_matches(coalesce(source, ''), '^src[0-9]{1,9}$') THEN 'other' ELSE CASE CAST(substr(source, 4) AS BIGINT) // 5 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' WHEN 3 THEN 'code' ELSE 'other' END END AS domain
  FROM documents),
l AS (SELECT domain, lang, source, sum(n_tokens) AS have, CAST(sum(n_tokens) AS DOUBLE) * 3 AS cap FROM h GROUP BY ALL),
d0 AS (SELECT domain, sum(cap) AS cap, CAST((SELECT sum(have) FROM l) * 0.6 AS DOUBLE) AS budget, CAST(CASE domain WHEN 'web' THEN 0.4 WHEN 'books' THEN 0.3 WHEN 'forum' THEN 0.2 WHEN 'code' THEN 0.1 ELSE 0.05 END AS DOUBLE) AS w FROM l GROUP BY domain),
d1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM d0),
d AS (SELECT domain, CASE WHEN cap <= lev * w THEN cap ELSE w * arg_min(lev, row(cap / w, domain)) FILTER (NOT cap <= lev * w) OVER () END AS budget FROM d1),
g0 AS (SELECT l.domain, lang, sum(cap) AS cap, any_value(budget) AS budget, CAST(CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 0.05 END AS DOUBLE) AS w FROM l JOIN d USING (domain) GROUP BY l.domain, lang),
g1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM g0),
g AS (SELECT domain, lang, CASE WHEN cap <= lev * w THEN cap ELSE w * arg_min(lev, row(cap / w, lang)) FILTER (NOT cap <= lev * w) OVER (PARTITION BY domain) END AS budget FROM g1),
s0 AS (SELECT l.*, budget, CAST(1 AS DOUBLE) AS w FROM l JOIN g USING (domain, lang)),
s1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s0),
s2 AS (SELECT domain, lang, source, have, CAST(floor(CASE WHEN cap <= lev * w THEN cap ELSE w * arg_min(lev, row(cap / w, source)) FILTER (NOT cap <= lev * w) OVER (PARTITION BY domain, lang) END + 1e-6) AS BIGINT) AS given FROM s1),
s AS (SELECT *, CASE WHEN have > 0 THEN given // have ELSE 0 END AS epochs, given - CASE WHEN have > 0 THEN given // have ELSE 0 END * have AS rest FROM s2),
j AS (SELECT h.*, s.epochs, s.rest, md5('11:' || s.epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM h JOIN s USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM j)
SELECT doc_id, domain, lang, source, CAST(epochs AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens FROM r WHERE upto <= rest
UNION ALL SELECT doc_id, domain, lang, source, CAST(e AS BIGINT), CAST(n_tokens AS BIGINT) FROM (SELECT *, unnest(range(0, CAST(epochs AS BIGINT))) AS e FROM j WHERE epochs > 0)
"""
