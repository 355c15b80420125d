"""URL filters by host-suffix and path-prefix expressions.

Each url is expanded into the expressions `host suffix + path prefix` that a rule could have, these are equi-joined with the
rules on a short prefix of their digests, the full digests confirm a hit, and the longest rule wins. Only DataFrame
operations are used. How many suffixes and which prefix lengths are tried follows from the rules, never from the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Hexadecimal digits of the short prefix: 32 bits.
SHORT = 8
#: Rules of more characters than this in all are joined by shuffle instead of being sent to every executor.
BROADCAST_CHARS = 1 << 20


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Suffixes of the host with so many labels, each with the path's prefixes of so many characters."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")) for n in labels))
    prefixes = F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths))
    known = F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(suffixes, lambda x: x.isNotNull()))
    return F.flatten(F.transform(known, lambda s: F.transform(F.filter(prefixes, lambda x: x.isNotNull()), lambda p: F.concat(s, p))))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each distinct expression; of rules that contradict each other block wins."""
    best: dict[str, Rule] = {}
    for r in rules:
        if r.text not in best or r.verdict == "block":
            best[r.text] = r
    rows = F.array(*(F.struct(F.lit(r.text).alias("_rule"), F.lit(r.verdict).alias("_verdict")) for r in best.values()))
    df = spark.range(1).select(F.inline(rows))
    df = df.select("_rule", "_verdict", F.sha2(F.col("_rule"), 256).alias("_full")).withColumn("_short", F.substring("_full", 1, SHORT))
    return F.broadcast(df) if sum(len(x) for x in best) < BROADCAST_CHARS else df


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages(page_id, url, ..).

    A null url or one without `://` has an empty host and path, fits no rule and gets the default verdict, as every url
    without a fitting rule does. Repeated rows stay repeated; other columns are ignored. Of rules as long as each other (which
    have different hosts) the one with the longer host wins. The rules are broadcast only where their size is under
    BROADCAST_CHARS; a longer list is joined by shuffle, whose skew adaptive execution splits.
    """
    if not rules:
        return pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tried = own.select("page_id", "host", "path", F.explode_outer(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("_e"))
    tried = tried.withColumn("_digest", F.sha2(F.col("_e"), 256)).withColumn("_key", F.substring("_digest", 1, SHORT))
    known = rule_table(pages.sparkSession, rules)
    hits = tried.join(known, (F.col("_key") == F.col("_short")) & (F.col("_digest") == F.col("_full")), "left")
    fit = F.when(F.col("_rule").isNotNull(), F.struct(F.char_length("_rule").alias("n"), F.char_length(F.substring_index("_rule", "/", 1)).alias("h"), F.col("_rule"), F.col("_verdict")))
    # every row made as many expressions as its host and path do, so a group's size tells how often the row is there
    best = hits.groupBy("page_id", "host", "path").agg(F.max(fit).alias("_best"), F.count(F.lit(1)).alias("_n"))
    times = F.expr("CAST(_n DIV _each AS INT)")
    best = best.withColumn("_each", F.greatest(F.size(expressions(F.col("host"), F.col("path"), labels, lengths)), F.lit(1)))
    again = best.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times)))
    return again.select("page_id", "host", "path", F.col("_best._rule").alias("rule"), F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
n AS (SELECT row_number() OVER () AS id, * FROM u),
b AS (
  SELECT id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM n JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY id)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM n LEFT JOIN b USING (id)
"""
