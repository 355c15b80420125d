"""Near duplicates by b-bit MinHash.

Each document gets K minima over its word shingles. Bands of ROWS minima make candidates; of each minimum only B bits are
kept, packed into words, and the share of equal positions, corrected for chance collisions, estimates a candidate's
similarity. What may reach the threshold is confirmed on the full shingle sets. Documents with the same set are one class
from the start; links within what is already connected are never looked at again, so a large group of near copies costs a
star of links and not all its pairs:

1. in every band bucket the classes are compared with the bucket's least class. Pairs that the estimate lets pass form
   clusters; the best such pair of each class is confirmed, and confirmed pairs form components;
2. classes of a bucket that lie in different clusters are compared too, in blocks, so that no pair of a bucket that the
   estimate lets pass leaves its cluster;
3. where a cluster has more than one component, the classes outside its largest one meet all others of the cluster, in
   blocks of texts; a block returns the components that it joins, so what is written grows with the classes, not with
   their pairs.

A pair is missed only when no band holds it: at a similarity of exactly 0.8 with a chance of (1 - 0.8**ROWS)**BANDS, 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BYTE, K1, K2, K3, U64, Scratch, Spans, blocks, flat, mix, table, words
from .components import components


@dataclass(frozen=True)
class Near:
    """Parameters. similarity is in hundredths, so that the test is exact. margin is how far an estimate may lie below it: over
    five standard deviations of the estimate at the threshold."""

    shingle: int = 5
    similarity: int = 80
    rows: int = 6
    bands: int = 40
    bits: int = 2
    margin: float = 0.2

    @property
    def minima(self) -> int:
        return self.rows * self.bands

    @property
    def words(self) -> int:
        """64-bit words of one bit plane."""
        return -(-self.minima // 64)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each row, ascending in the row, and the rows' offsets in them.

    A row with fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    data = LOWER[data]
    starts, ends, row = words(data, offs)
    each = Spans(Spans(BYTE[data])(starts, ends))
    n = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(n) - n
    at = np.arange(len(starts))
    at = at[at + k <= (first + n)[row]] if len(starts) else at
    few = np.flatnonzero((n > 0) & (n < k))
    keys = np.concatenate([each(at, at + k), each(first[few], first[few] + n[few])])
    rows = np.concatenate([row[at], few])
    order = np.argsort(rows, kind="stable")
    keys, rows = keys[order], rows[order]
    edge = np.searchsorted(rows, np.arange(len(offs)))
    own = [np.unique(keys[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    return np.concatenate(own) if own else keys, np.append(0, np.cumsum(sizes))


def sign(keys: np.ndarray, edge: np.ndarray, p: Near) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (rows x bands) and packed bits (rows x bits * words) of non-empty sets."""
    rows = len(edge) - 1
    small = (keys >> U64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * p.minima + 1, dtype=U64) * K1)
    low = np.empty((p.minima, rows), np.uint32)
    for i in range(p.minima):
        a, b = np.uint32(seeds[2 * i] >> U64(32)) | np.uint32(1), np.uint32(seeds[2 * i + 1] >> U64(32))
        low[i] = np.minimum.reduceat(small * a + b, edge[:-1])
    bands = np.empty((rows, p.bands), U64)
    for j in range(p.bands):
        h = np.full(rows, mix(np.array([j + 1], U64) * K2)[0])
        for i in range(j * p.rows, (j + 1) * p.rows):
            h = mix(h ^ (low[i] + K3))
        bands[:, j] = h
    planes = []
    for b in range(p.bits):
        plane = np.zeros((rows, p.words * 64), np.uint8)
        plane[:, : p.minima] = ((low >> np.uint32(b)) & np.uint32(1)).T
        planes.append(np.packbits(plane, axis=1, bitorder="little").view("<u8"))
    return bands, np.concatenate(planes, axis=1)


def lists(values: np.ndarray, per_row: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)).astype(np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))


def signatures(df: DataFrame, p: Near) -> DataFrame:
    """doc_id, n (size of the shingle set), key (128 bits that name the set), bits, bands; empty sets have neither bits nor bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in blocks(batches, "text"):
            keys, edge = shingles(data, offs, p.shingle)
            n = np.diff(edge)
            some = np.flatnonzero(n)
            bands, bits = np.zeros((0, p.bands), U64), np.zeros((0, p.bits * p.words), U64)
            if len(some):
                bands, bits = sign(keys, np.append(edge[:-1][some], len(keys)), p)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n), names(keys, edge), lists(bits, (n > 0) * bits.shape[1]), lists(bands, (n > 0) * bands.shape[1])],
                names=["doc_id", "n", "key", "bits", "bands"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, key binary, bits array<bigint>, bands array<bigint>")


def estimate(x: str, y: str, p: Near) -> Column:
    """Similarity from the counts of equal bits: the share of equal positions less that of chance collisions."""
    differ = []
    for w in range(p.words):
        planes = [F.expr(f"{x}[{b * p.words + w}] ^ {y}[{b * p.words + w}]") for b in range(p.bits)]
        any_bit = planes[0]
        for q in planes[1:]:
            any_bit = any_bit.bitwiseOR(q)
        differ.append(F.bit_count(any_bit))
    total = differ[0]
    for d in differ[1:]:
        total = total + d
    chance = 0.5**p.bits
    return (1 - total / F.lit(float(p.minima)) - chance) / (1 - chance)


def promising(pairs: DataFrame, classes: DataFrame, p: Near) -> DataFrame:
    """a, b, est of the pairs(a, b) that sizes and estimate allow to reach the threshold."""
    own = classes.select("node", "n", "bits")
    out = pairs.join(own.toDF("a", "_na", "_ba"), "a").join(own.toDF("b", "_nb", "_bb"), "b")
    out = out.where(100 * F.least("_na", "_nb") >= p.similarity * F.greatest("_na", "_nb"))
    return out.withColumn("est", estimate("_ba", "_bb", p)).where(F.col("est") >= p.similarity / 100 - p.margin).select("a", "b", "est")


def names(keys: np.ndarray, edge: np.ndarray) -> pa.Array:
    """128 bits for each set, from two sums that don't depend on the order; zero for the empty set."""
    out = np.zeros((len(edge) - 1, 2), U64)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        out[some, 0] = np.add.reduceat(mix(keys ^ K1), edge[:-1][some])
        out[some, 1] = np.add.reduceat(mix(keys ^ K2), edge[:-1][some])
    raw = out.tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def short(key: Column, step: int) -> Column:
    """64 bits of a set's name, others for each step."""
    return F.xxhash64(key, F.lit(step))


def numbered(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """classes(key, ..) with node, and that table's name: 64 bits that no two keys share: of those that do, all but the least key take others, until none do."""
    out, step = classes.withColumn("node", short(F.col("key"), 0)), 0
    while True:
        held = scratch.write(out, f"classes-{step}")
        if step:
            scratch.drop(f"classes-{step - 1}")
        shared = held.groupBy("node").agg(F.min("key").alias("_least"), F.max("key").alias("_last")).where("_least < _last").select("node", "_least")
        if shared.isEmpty():
            return held, f"classes-{step}"
        step += 1
        # a left join keeps every class; only the few that share a node are in the other table
        out = held.join(shared, "node", "left").withColumn("node", F.when(F.col("key") > F.col("_least"), short(F.col("key"), step)).otherwise(F.col("node"))).drop("_least")


def with_node(df: DataFrame, p: Near) -> DataFrame:
    """node, text: one of the rows of df(text, key, node) for each node, whose text has the set that key names, as rows of one doc_id may have other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in blocks(batches, "text"):
            own = pc.equal(names(*shingles(data, offs, p.shingle)), rows.column("key"))
            yield rows.select(["node", "text"]).filter(own)

    return df.select("text", "key", "node").mapInArrow(run, "node bigint, text string").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, texts: DataFrame, p: Near) -> DataFrame:
    """a, b of the pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in blocks(iter([batch]), "ta"):
                left, le = shingles(data, offs, p.shingle)
                right, re = shingles(*flat(rows.column("tb")), p.shingle)
                keep = np.zeros(rows.num_rows, bool)
                for i in range(rows.num_rows):
                    x, y = left[le[i] : le[i + 1]], right[re[i] : re[i + 1]]
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    keep[i] = both > 0 and 100 * both >= p.similarity * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


#: Classes of a block in which all are compared with all.
BLOCK = 512


def spanning(pairs: Iterator[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Of the pairs those that join what the ones before them leave apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y] if y in root else y
            x = root[x]
        return x

    a, b = [], []
    for x, y in pairs:
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            a.append(x)
            b.append(y)
    return a, b


def dealt(df: DataFrame, key: str, count: str) -> DataFrame:
    """df once for each pair of blocks of its key that it belongs to: columns i <= j, and own, the block it is in. Blocks have about BLOCK rows."""
    out = df.withColumn("_k", F.ceil(F.col(count) / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_k")))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
    return out.withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o")).drop("_k", "_o")


def bridges(members: DataFrame, clusters: DataFrame, classes: DataFrame, p: Near) -> DataFrame:
    """a, b: clusters with a pair that shares a bucket, isn't its bucket's least class, and that the estimate lets pass."""
    own = members.where("size > 2 AND node <> lead").join(clusters.toDF("node", "_c"), "node", "left").withColumn("cluster", F.coalesce("_c", "node"))
    open_ = own.groupBy("bucket").agg(F.min("cluster").alias("_lo"), F.max("cluster").alias("_hi")).where("_lo < _hi").select("bucket")
    rows = dealt(own.select("bucket", "node", "cluster", "size").join(open_, "bucket"), "bucket", "size").join(classes.select("node", "n", "bits"), "node")

    def run(t: pa.Table) -> pa.Table:
        n, cluster = t.column("n").to_numpy(), t.column("cluster").to_numpy()
        bits = np.array(t.column("bits").to_pylist(), np.int64).view(np.uint64).reshape(len(n), p.bits, p.words)

        def found() -> Iterator[tuple[int, int]]:
            for x in range(len(n)):
                other = np.bitwise_or.reduce(bits[x + 1 :] ^ bits[x], axis=1)
                share = 1 - np.bitwise_count(other).sum(axis=1) / p.minima
                est = (share - 0.5**p.bits) / (1 - 0.5**p.bits)
                near = (est >= p.similarity / 100 - p.margin) & (100 * np.minimum(n[x + 1 :], n[x]) >= p.similarity * np.maximum(n[x + 1 :], n[x])) & (cluster[x + 1 :] != cluster[x])
                for y in np.unique(cluster[x + 1 :][near]).tolist():
                    yield int(cluster[x]), y

        a, b = spanning(found())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("bucket", "i", "j", "n", "cluster", "bits").groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint")


def joins(clusters: DataFrame, labels: DataFrame, texts: DataFrame, p: Near) -> DataFrame:
    """a, b: components with a link between them, of all pairs within a cluster."""
    own = clusters.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = own.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("all")).where("all > m.k").selectExpr("cluster", "m.label AS main", "`all` - m.k AS n_out", "m.k AS n_in")
    own = own.join(main, "cluster").withColumn("out", F.col("label") != F.col("main"))
    # the others among themselves, and each block of them with each block of the largest component
    outer = dealt(own.where("out").select("cluster", "node", "label", "n_out"), "cluster", "n_out").select("cluster", "node", "label", F.lit(True).alias("out"), "i", "j", F.lit(0).alias("kind"))
    blocks_in, blocks_out = F.ceil(F.col("n_in") / BLOCK), F.ceil(F.col("n_out") / BLOCK)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    a = own.where("out").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), blocks_out)).withColumn("j", upto(blocks_in))
    b = own.where("NOT out").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), blocks_in)).withColumn("i", upto(blocks_out))
    mixed = a.unionByName(b).select("cluster", "node", "label", "out", "i", "j", F.lit(1).alias("kind"))

    def run(t: pa.Table) -> pa.Table:
        keys, edge = shingles(*flat(t.column("text")), p.shingle)
        label, out, n = t.column("label").to_numpy(), t.column("out").to_numpy(), np.diff(edge)
        _, of = np.unique(keys, return_inverse=True)
        mark = np.zeros(int(of.max()) + 1 if len(of) else 0, np.int64)

        def found() -> Iterator[tuple[int, int]]:
            for x in np.flatnonzero(out).tolist():
                mine = of[edge[x] : edge[x + 1]]
                mark[mine] = 1
                both = np.add.reduceat(mark[of], edge[:-1])
                mark[mine] = 0
                near = (100 * both >= p.similarity * (n + n[x] - both)) & (label != label[x])
                for y in np.unique(label[near]).tolist():
                    yield int(label[x]), y

        a, b = spanning(found())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = outer.unionByName(mixed).join(texts, "node")
    return rows.groupBy("cluster", "kind", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, scratch: Scratch, p: Near = Near()) -> DataFrame:
    """One row for each row of df(doc_id, text, ..): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links can reach, kept whether it is the row's own. A text that is null or has no word
    has an empty set, links with nothing and is kept. Rows that share a doc_id are judged each by its own text; the same text
    twice under one doc_id gives the same row twice. A row without doc_id links nothing: its component_id is the one of the
    other rows with its set, null if there are none, and it is never kept. Other columns are ignored.
    """
    held = scratch.write(signatures(df, p), "signatures")
    # one class for each distinct set; its bits and bands are those of any of its rows
    every = held.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"), *(F.first(x).alias(x) for x in ("n", "bits", "bands")))
    classes, classes_name = numbered(every, scratch)
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    leads = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("lead < last")
    leads = scratch.write(leads.select("bucket", "lead", "size"), "leads")
    members = scratch.write(buckets.join(leads, "bucket"), "members")
    star = scratch.write(promising(members.where("node <> lead").selectExpr("lead AS a", "node AS b").distinct(), classes, p), "star")
    best = scratch.write(star.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).selectExpr("m.a AS a", "b"), "best")

    # texts of all classes that some estimate lets pass
    clusters = components(star.select("a", "b"), scratch, "clusters")
    wider = components(bridges(members, clusters, classes, p), scratch, "wider")
    clusters = clusters.join(wider.toDF("label", "_w"), "label", "left").selectExpr("node", "coalesce(_w, label) AS cluster")
    lone = members.select("node").distinct().join(clusters, "node", "left_anti").join(wider.toDF("node", "cluster"), "node")
    clusters = scratch.write(clusters.unionByName(lone), "all-clusters")
    asked = clusters.select("node").join(classes.select("node", "key", F.col("doc").alias("_doc")), "node")
    texts = scratch.write(with_node(df.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("_doc")), p), "texts")
    links = scratch.write(confirmed(best, texts, p), "links")
    labels = components(links, scratch, "first")
    over = components(joins(clusters, labels, texts, p), scratch, "second")

    tops = classes.select("key", "doc", "node").join(labels, "node", "left").withColumn("_l", F.coalesce("label", "node")).join(over.toDF("_l", "_top"), "_l", "left")
    tops = scratch.write(tops.select("key", "doc", F.coalesce("_top", "_l").alias("top")), "tops")
    least = scratch.write(tops.groupBy("top").agg(F.min("doc").alias("component_id")), "least")
    final = scratch.write(tops.join(least, "top").select(F.col("key").alias("_key"), "component_id"), "final")
    scratch.drop("members", "star", "best", "all-clusters", "texts", "links", "leads", classes_name, "tops", "least", "clusters-labels", "wider-labels", "first-labels", "second-labels")
    out = held.where("n > 0").join(final, F.col("key") == F.col("_key"), "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = held.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), Near(shingle=2))


OP3_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r) JOIN n na ON na.r = a JOIN n nb ON nb.r = b
  WHERE 100 * k >= 80 * (na.n + nb.n - k)),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
