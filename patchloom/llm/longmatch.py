"""Long repeated passages by a run-length index.

Every byte that lies in a string of LENGTH bytes which also starts in a document with a smaller doc_id is removed.

1. Windows of LENGTH bytes are named by the least hash of the grams inside; neighbouring windows of one name make a segment.
   Equal windows have equal names, wherever they are, so a window can only repeat where its segment's name does.
2. Names meet in hash partitions, packed and without the repeats inside a block of text. There each segment learns whether
   its name occurs in two documents, and whether the same segment occurs in a document with a smaller doc_id.
3. The first occurrences of the segments whose name repeats form, partition by partition, a run-length index; those whose name
   a smaller document has are streamed against it, and the matching statistics tell for each of their windows the least document that has it. Segments
   equal to an earlier one need no stream of their own: all their windows are in the earlier document.
4. Each block marks its windows and cuts.

Texts are written once as blocks, bucketed by block, and every later step joins packed per-block results to them without
moving them again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BYTE, K1, K2, K3, U64, Scratch, Spans, blocks, mix, release, table
from ._units import gather
from .runindex import RunIndex

#: A row without doc_id comes after all others.
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Match:
    """length: bytes of a match. gram: bytes whose hashes name a window. piece: most windows of a segment. block: bytes of text in
    a row of the block table. part: bytes of text for each hash partition, so that their number follows the data."""

    length: int = 50
    gram: int = 24
    piece: int = 64
    block: int = 2 << 20
    part: int = 4 << 20


def slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of that width."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def windows(offs: np.ndarray, p: Match) -> np.ndarray:
    """Starts of all windows that lie in one row."""
    n = np.maximum(np.diff(offs) - p.length + 1, 0)
    return np.repeat(offs[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


#: A second random value for each byte, for a second hash of a segment.
OTHER = mix(np.arange(257, 513, dtype=U64) * K2)


def segments(data: np.ndarray, offs: np.ndarray, p: Match) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment the first window, the number of windows, the name, and two hashes of its whole text."""
    at = windows(offs, p)
    if not len(at):
        return at, at, np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64)
    spans = Spans(BYTE[data])
    grams = (spans.sums[p.gram :] - spans.sums[: -p.gram]) * spans.back[: len(data) - p.gram + 1]
    least = slide(grams, p.length - p.gram + 1)[at]
    begin = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)))
    size = np.diff(np.append(begin, len(at)))
    parts = -(-size // p.piece)
    order = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(begin, parts) + order * p.piece
    count = np.minimum(np.repeat(size, parts) - order * p.piece, p.piece)
    start = at[begin]
    end = start + count + p.length - 1
    name, whole = mix(least[begin] + K3), spans(start, end)
    del spans, grams, least, at
    return start, count, name, whole, Spans(OTHER[data])(start, end)


def low(values: np.ndarray, n: int) -> bytes:
    """The n low bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def high(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").reshape(-1)


def pair(name: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return mix(name * K1 ^ mix(whole + K2))


def least_in_group(key: np.ndarray, value: np.ndarray, exact: tuple[np.ndarray, ...] = (), most: bool = False) -> tuple[np.ndarray, ...]:
    """For each element the least value (and the largest, if asked for) among those with its key, and with its values in `exact`."""
    order = np.argsort(key)
    lead = np.append(True, key[order[1:]] != key[order[:-1]])
    differ = np.zeros(max(len(key) - 1, 0), bool)
    for x in exact:
        differ |= x[order[1:]] != x[order[:-1]]
    if (differ & ~lead[1:]).any():  # two groups share a key: they are told apart by all that is known of them
        order = np.lexsort((*exact, key))
        lead = np.append(True, np.any([x[order[1:]] != x[order[:-1]] for x in (key, *exact)], axis=0))
    first, of = np.flatnonzero(lead), np.empty(len(key), np.int64)
    of[order] = np.cumsum(lead) - 1
    out = (np.minimum.reduceat(value[order], first)[of],)
    return (*out, np.maximum.reduceat(value[order], first)[of]) if most else out


def ids_of(docs: list[int | None]) -> np.ndarray:
    return np.array([LAST if x is None else x for x in docs], np.int64)


BLOCKS = "block bigint, docs array<bigint>, sizes array<bigint>, data binary, counts binary, again binary, parts binary"


def write_blocks(df: DataFrame, p: Match, n_parts: int, buckets: int, scratch: Scratch) -> DataFrame:
    """The block table: texts, and of each segment its windows, whether the block has it in a smaller document, and, if not, its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        for rows, data, offs in blocks(batches, "text", p.block):
            docs = rows.column("doc_id").to_pylist()
            start, count, name, whole, other = segments(data, offs, p)
            again, part = np.zeros(len(start), bool), np.zeros(len(start), np.uint32)
            if len(start):
                doc = ids_of(docs)[np.searchsorted(offs, start, side="right") - 1]
                again = least_in_group(pair(name, whole), doc, (name, whole, other))[0] < doc
                part = part_of(name, n_parts)[~again]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((base + seq, pa.int64()), (docs, pa.list_(pa.int64())), (np.diff(offs).tolist(), pa.list_(pa.int64())), (data.tobytes(), pa.binary()), (count.astype(np.uint8).tobytes(), pa.binary()), (np.packbits(again).tobytes(), pa.binary()), (part.astype("<u4").tobytes(), pa.binary()))],
                names=["block", "docs", "sizes", "data", "counts", "again", "parts"],
            )
            seq += 1

    name = f"patchloom_blocks_{uuid.uuid4().hex}"
    made = df.select("doc_id", "text").mapInArrow(run, BLOCKS)
    made.write.bucketBy(buckets, "block").option("path", scratch.path("blocks")).option("compression", "zstd").saveAsTable(name)
    out = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay, and the plan knows their buckets
    return out


def part_of(name: np.ndarray, n: int) -> np.ndarray:
    return ((mix(name) >> U64(32)) * U64(n) >> U64(32)).astype(np.uint32)


class Block:
    """A row of the block table."""

    def __init__(self, row: dict, p: Match):
        self.id, self.docs = row["block"], row["docs"]
        self.data = np.frombuffer(row["data"], np.uint8)
        self.offs = np.append(0, np.cumsum(np.array(row["sizes"], np.int64)))
        self.count = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
        self.start = windows(self.offs, p)[np.cumsum(self.count) - self.count] if len(self.count) else np.zeros(0, np.int64)
        self.again = np.unpackbits(np.frombuffer(row["again"], np.uint8), count=len(self.count)).astype(bool)
        self.part = np.frombuffer(row["parts"], "<u4")
        self.own = np.flatnonzero(~self.again)
        self.by_part = np.argsort(self.part, kind="stable")

    def codes(self, each: list[dict]) -> np.ndarray:
        """What the partitions decided about the segments in `own`."""
        out = np.zeros(len(self.own), np.uint8)
        if each:
            out[self.by_part] = np.frombuffer(b"".join(x["codes"] for x in sorted(each, key=lambda x: x["part"])), np.uint8)
        return out

    def doc(self, at: np.ndarray) -> np.ndarray:
        return ids_of(self.docs)[np.searchsorted(self.offs, self.start[at], side="right") - 1]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    try:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]
    finally:
        release()


def announce(blocks_: DataFrame, p: Match) -> DataFrame:
    """part, block, docs, names, wholes, others: of a block's segments the doc_ids, 40 bits of the names, and 64 and 24 bits of two hashes of their
    texts, packed for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row, p)
            if not len(b.own):
                continue
            _, _, name, whole, other = segments(b.data, b.offs, p)
            at = b.own[b.by_part]
            doc = b.doc(at)
            part = b.part[b.by_part]
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            out = []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own = at[i:j]
                docs = zlib.compress(np.diff(doc[i:j], prepend=0).tobytes(), 1)
                out.append({"part": int(part[i]), "block": b.id, "docs": docs, "names": low(name[own], 5), "wholes": low(whole[own], 8), "others": low(other[own], 3)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("docs", "names", "wholes", "others"))]))

    return blocks_.mapInArrow(run, "part bigint, block bigint, docs binary, names binary, wholes binary, others binary")


def decide(t: pa.Table) -> pa.Table:
    """codes of the segments of one partition: 1 if the same segment is in a smaller document; else 2 if its name is in a smaller one, 3 if it is
    in larger ones only, 0 if it is in no other. A name is known by 5 bytes here, beside the partition: one more that seems to repeat is only looked at.
    Segments are the same if all 128 bits that came are equal."""
    names, wholes, others, docs = [], [], [], []
    for d, n, w, o in zip(*(t.column(x).to_pylist() for x in ("docs", "names", "wholes", "others")), strict=True):
        names.append(high(n, 5))
        wholes.append(high(w, 8))
        others.append(high(o, 3))
        docs.append(np.cumsum(np.frombuffer(zlib.decompress(d), np.int64)))
    edge = np.append(0, np.cumsum([len(x) for x in docs])).tolist()
    name, whole, other, doc = (np.concatenate(x) for x in (names, wholes, others, docs))
    del names, wholes, others, docs
    first, last = least_in_group(name, doc, most=True)
    same = least_in_group(pair(name, whole), doc, (name, whole, other))[0]
    code = np.where(same < doc, 1, np.where(first < last, np.where(first < doc, 2, 3), 0)).astype(np.uint8)
    out = pa.table({"part": t.column("part"), "block": t.column("block"), "codes": pa.array([code[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary())})
    release()
    return out


def send(blocks_: DataFrame, p: Match) -> DataFrame:
    """part, block, at, docs, sizes, asks, data: the first occurrences of segments whose name repeats, packed for each partition; asks tells
    those that have something to look for, as a smaller document has their name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row, p)
            code = b.codes(row["decided"])
            order = b.by_part[code[b.by_part] >= 2]
            if not len(order):
                continue
            at, part, asks = b.own[order], b.part[order], code[order] == 2
            size = b.count[at] + p.length - 1
            doc = b.doc(at)
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            out = []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                out.append({"part": int(part[i]), "block": b.id, "at": at[i:j].astype("<u4").tobytes(), "docs": doc[i:j].tobytes(), "sizes": size[i:j].astype("<u2").tobytes(), "asks": asks[i:j].tobytes(), "data": gather(b.data, b.start[at[i:j]], size[i:j]).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("at", "docs", "sizes", "asks", "data"))]))

    return blocks_.mapInArrow(run, "part bigint, block bigint, at binary, docs binary, sizes binary, asks binary, data binary")


def match(p: Match):
    """For the segments of one partition, by block: which windows are in a smaller document (segment, first window, number)."""

    def run(t: pa.Table) -> pa.Table:
        col = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
        at, docs, sizes, data = col("at", "<u4"), col("docs", np.int64), col("sizes", "<u2"), col("data", np.uint8)
        of = np.repeat(np.arange(len(at)), [len(x) for x in at])
        at, doc, size, data = np.concatenate(at), np.concatenate(docs), np.concatenate(sizes).astype(np.int64), np.concatenate(data)
        edge = np.append(0, np.cumsum(size))
        ask = np.flatnonzero(np.concatenate(col("asks", bool)))
        if not len(ask):
            return pa.table({"block": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
        index = RunIndex(data, edge, doc, p.length)
        inner = np.append(0, np.cumsum(size[ask]))
        length, row = index.stream(gather(data, edge[ask], size[ask]), inner)
        owner = np.repeat(ask, size[ask])
        hit = np.flatnonzero(length >= p.length)
        hit = hit[index.least_owner(row[hit]) < doc[owner[hit]]]
        lead = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))) if len(hit) else np.zeros(0, np.int64)
        many = np.diff(np.append(lead, len(hit)))
        seg = owner[hit[lead]]
        first = hit[lead] - inner[np.searchsorted(ask, seg)]
        out_block, found = [], []
        for k, name in enumerate(t.column("block").to_pylist()):
            own = of[seg] == k
            if own.any():
                out_block.append(name)
                found.append(np.stack([at[seg[own]], first[own], many[own]], 1).astype("<u4").tobytes())
        release()
        return pa.table({"block": pa.array(out_block, pa.int64()), "found": pa.array(found, pa.binary())})

    return run


def cut(blocks_: DataFrame, p: Match) -> DataFrame:
    """doc_id, n_bytes, starts, ends (removed runs), kept (what remains) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row, p)
            whole = b.again.copy()
            whole[b.own[b.codes(row["decided"] or []) == 1]] = True
            found = [np.frombuffer(x, "<u4").reshape(-1, 3).astype(np.int64) for x in row["found"] or []]
            part = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            start = np.concatenate([b.start[whole], b.start[part[:, 0]] + part[:, 1]])
            end = start + np.concatenate([b.count[whole], part[:, 2]]) + p.length - 1
            step = np.zeros(len(b.data) + 1, np.int32)
            np.add.at(step, start, 1)
            np.add.at(step, end, -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.zeros(len(b.data) + 1, bool)
            edge[b.offs] = True
            shut = np.append(gone[:-1] & ~gone[1:], True) if len(gone) else gone
            first = np.flatnonzero(gone & (np.append(True, ~gone[:-1]) if len(gone) else gone) | gone & edge[:-1])
            last = np.flatnonzero(gone & shut | gone & edge[1:]) + 1
            doc = np.searchsorted(b.offs, first, side="right") - 1
            spans = np.append(0, np.cumsum(np.bincount(doc, minlength=len(b.docs)))).astype(np.int32)
            kept = np.append(0, np.cumsum(~gone))[b.offs]
            left = pa.Array.from_buffers(pa.large_binary(), len(b.docs), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(b.data[~gone].tobytes())]).cast(pa.binary())
            runs = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x - b.offs[doc], pa.int64())) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(b.docs, pa.int64()), pa.array(np.diff(b.offs)), *runs, left], names=["doc_id", "n_bytes", "starts", "ends", "kept"])

    return blocks_.mapInArrow(run, "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def remove_repeats(df: DataFrame, scratch: Scratch, p: Match = Match()) -> DataFrame:
    """One row for each row of df(doc_id, text, ..): doc_id, n_bytes, starts and ends of the removed runs, kept (the bytes that remain).

    A null text is the empty one. Rows that share a doc_id remove nothing from each other. A row without doc_id comes after all
    others, and such rows remove nothing from each other. Other columns are ignored. A very long text is a block of its own, in one worker.
    The number of hash partitions follows the bytes of all texts.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = write_blocks(df, p, max(buckets, -(-total // p.part)), buckets, scratch)
    decided = announce(texts, p).groupBy("part").applyInArrow(decide, "part bigint, block bigint, codes binary")
    decided = scratch.write(decided.groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias("decided")), "decided")
    sent = send(texts.join(decided.hint("shuffle_hash"), "block"), p)
    found = sent.groupBy("part").applyInArrow(match(p), "block bigint, found binary")
    found = scratch.write(found.groupBy("block").agg(F.collect_list("found").alias("found")), "found")
    return cut(texts.join(decided.hint("shuffle_hash"), "block", "left").join(found.hint("shuffle_hash"), "block", "left"), p)


def op10_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes are pairs of hexadecimal digits; texts are cut into overlapping parts first, as a part of a string is found by counting from its start.
OP10_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 698) AS part FROM (SELECT r, doc_id, h, unnest(range(0, greatest(CAST(length(h) // 2 AS BIGINT) - 49, 0), 300)) AS p FROM d)),
w AS MATERIALIZED (SELECT r, doc_id, p + i AS p, hash(substr(part, 2 * i + 1, 100)) AS x, md5_number(substr(part, 2 * i + 1, 100)) AS y FROM (SELECT r, doc_id, p, part, unnest(range(0, least(300, CAST(length(part) // 2 AS BIGINT) - 49))) AS i FROM k)),
f AS (SELECT x, y, min(doc_id) AS first, max(doc_id) AS last FROM w GROUP BY x, y HAVING min(doc_id) < max(doc_id)),
t AS (SELECT r, p FROM w JOIN f USING (x, y) WHERE first < doc_id),
u AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM t),
g AS MATERIALIZED (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM u) GROUP BY r, run),
e AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM g UNION ALL SELECT g.r, max(g.b), any_value(length(h) // 2) FROM g JOIN d USING (r) GROUP BY g.r),
q AS (SELECT r, string_agg(substr(h, 2 * CAST(a AS BIGINT) + 1, 2 * CAST(b - a AS BIGINT)), '' ORDER BY a) AS left_ FROM e JOIN d USING (r) GROUP BY r),
n AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM g GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256
FROM d LEFT JOIN q USING (r) LEFT JOIN n USING (r)
"""
