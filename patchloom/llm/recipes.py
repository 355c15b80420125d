"""Exact duplicates by content-defined chunk recipes.

A text without white space is cut where a rolling hash of its last 32 bytes says so; its recipe is the ordered list of its
chunks' identifiers. Identifiers are 64-bit fingerprints, verified over the whole corpus against SHA-256 digests: where two
chunks share a fingerprint, both get their digest as identifier. Only recipes, 8 bytes for about 2 KB of text, are then
grouped and joined; texts are read once and never moved.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BYTE, WHITE, Scratch, blocks, table

#: Chunk sizes in bytes: the window lies inside the least one, so a cut depends on the own text only.
LEAST, BITS, MOST = 512, 11, 16384
GEAR = (BYTE >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends that the content proposes: where the top BITS of the gear hash of the last 32 bytes are zero."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k].copy() << np.uint32(k)
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunks(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """For each row the positions in data where its chunks begin and end."""
    ends, out = cuts(data).tolist(), []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own = [a]
        while b - own[-1] > LEAST:
            i = bisect_left(ends, own[-1] + LEAST)
            end = min(ends[i] if i < len(ends) else b, own[-1] + MOST, b)
            own.append(end)
        if own[-1] < b:
            own.append(b)
        out.append(own)
    return out


def recipes(df: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_points (code points of the text), text_sha256, ids, digests of each row; null is the empty text."""
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in blocks(batches, "text"):
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offs]
            solid = ~WHITE[data]
            offs = np.append(0, np.cumsum(solid))[offs]
            data = data[solid]
            raw = memoryview(data.tobytes())
            whole, ids, digests = [], [], []
            for own in chunks(data, offs):
                parts = [raw[a:b] for a, b in zip(own, own[1:], strict=False)]
                whole.append(hashlib.sha256(raw[own[0] : own[-1]]).hexdigest())
                ids.append([(xxhash.xxh3_64_intdigest(x) & mask) - (1 << 63) for x in parts])
                digests.append([hashlib.sha256(x).digest() for x in parts])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(points), pa.int64()), pa.array(whole, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))],
                names=["doc_id", "n_points", "text_sha256", "ids", "digests"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_points bigint, text_sha256 string, ids array<bigint>, digests array<binary>")


def verified(held: DataFrame, scratch: Scratch) -> DataFrame:
    """held with the column recipe: the identifiers in order, none of which stands for two different chunks."""
    pairs = held.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select(F.col("c.ids").alias("id"), F.col("c.digests").alias("digest")).distinct()
    shared = scratch.write(pairs.groupBy("id").count().where("count > 1").select("id"), "shared")
    plain = F.transform("ids", lambda x: F.hex(x))
    if shared.isEmpty():
        return held.withColumn("recipe", plain)
    # rows with a shared fingerprint, by text: their lists are built anew from digests
    each = held.select("text_sha256", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "c")).select("text_sha256", "pos", F.col("c.ids").alias("id"), F.hex("c.digests").alias("digest"))
    hit = each.join(shared.withColumn("_hit", F.lit(True)), "id", "left").distinct()
    lists = hit.groupBy("text_sha256").agg(F.max("_hit").alias("_hit"), F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("_hit"), F.col("digest")).otherwise(F.hex("id")).alias("name")))).alias("l"))
    anew = lists.where("_hit").select("text_sha256", F.col("l.name").alias("_anew"))
    return held.join(anew, "text_sha256", "left").withColumn("recipe", F.coalesce("_anew", plain)).drop("_anew")


def deduplicate(df: DataFrame, scratch: Scratch, bits: int = 64) -> DataFrame:
    """One row for each row of df(doc_id, text, ..): doc_id, keep_id, group_size, kept, text_sha256, n_points (code points of the text).

    Texts are equal when they are identical without white space (space, 09-0D); a null text is the empty one, and all empty texts
    are equal. Of a group the row with the most code points, then the smallest doc_id (null last) stays. Rows that share
    doc_id and text are one document: they share keep_id and kept, and each counts in group_size. Other columns are ignored.
    """
    held = scratch.write(recipes(df, bits), "recipes")
    named = verified(held, scratch).select("doc_id", "n_points", "text_sha256", "recipe").withColumn("_h", F.xxhash64("recipe"))
    named = scratch.write(named, "named")
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("back"), "doc_id"))
    groups = scratch.write(named.groupBy("_h", "recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    groups = groups.select("_h", "recipe", "group_size", F.col("best.doc_id").alias("keep_id"))
    scratch.drop("recipes", "shared")
    # both sides are read from tables, so that adaptive execution can split a group with many rows
    out = named.join(groups, ["_h", "recipe"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_points")


def op2_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), Scratch(spark, "op2")).drop("n_points")


OP2_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
n AS (SELECT r, doc_id, sha256(bare) AS text_sha256, length(text) AS points FROM t),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
