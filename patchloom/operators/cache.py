"""A response cache as a table (key, raw): hits are a join, misses an anti join, and in a merge the new entry of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(*parts: Column) -> Column:
    """SHA-1 of the parts joined by NUL; null counts as empty."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha1(F.concat(texts[0], *(x for t in texts[1:] for x in (nul, t))))


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "key", "left")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti")


def merge(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both; what is empty isn't stored, and of one key the new entry counts."""
    kept = new.where("raw IS NOT NULL AND raw <> ''").groupBy("key").agg(F.max("raw").alias("raw"))
    return cache.join(kept.select("key"), "key", "left_anti").select("key", "raw").unionByName(kept)


def coverage(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """n, n_hits."""
    seen = cache.select("key", F.lit(1).alias("_hit")).dropDuplicates(["key"])
    return requests.join(seen, "key", "left").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("n_hits"))
