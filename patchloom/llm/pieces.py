"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into units that no piece can cross. The symbols of all distinct units of a block lie in one flat array; each
round finds the best pair of every unit (segmented minimum of the pair ranks), merges its occurrences from the left all at
once, and compacts the array, until no unit has a pair left. The ids equal those of the sentencepiece library, which is only
used to read the model file. Where a merged piece could be part of a better pair, or several pieces share a score, a round
merges only the leftmost occurrence, as the one-at-a-time algorithm would.

A round passes over all that is left of a unit, so a unit without a space of thousands of characters would cost their square. Units of more
than LONG characters are merged one pair at a time from a heap instead, in the same order.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import blocks, table
from ._units import UnitEncoder, gather

SPACE = "▁"
NONE = np.iinfo(np.int32).max
CODES = 0x110000
LONG = 2048


class Model:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = proto.ModelProto.FromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        kinds = Counter(p.type for p in spec.pieces)
        piece = proto.ModelProto.SentencePiece
        if norm.precompiled_charsmap or not norm.escape_whitespaces or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only models that keep characters and white space as they are can be encoded")
        if train.model_type != proto.TrainerSpec.BPE or not train.byte_fallback or kinds[piece.USER_DEFINED] or kinds[piece.UNUSED]:
            raise ValueError("only BPE models with byte fallback and without user-defined pieces can be encoded")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.size = n = len(spec.pieces)
        own = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == piece.NORMAL}
        score = {x: spec.pieces[i].score for x, i in own.items()}
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {x: levels[s] for x, s in score.items()}
        shared = Counter(rank.values())
        serial = np.zeros(len(levels) + 1, bool)
        serial[[r for r, k in shared.items() if k > 1]] = True
        code = lambda x: own.get(x, n + ord(x) if len(x) == 1 else None)
        keys, ranks, into = [], [], []
        for x, i in own.items():
            for k in range(1, len(x)):
                left, right = code(x[:k]), code(x[k:])
                if left is not None and right is not None:
                    keys.append(left * (n + CODES) + right)
                    ranks.append(rank[x])
                    into.append(i)
                    for part in (x[:k], x[k:]):
                        if len(part) > 1 and rank[x] <= rank[part]:
                            serial[rank[part]] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks, self.into = np.array(ranks, np.int32)[order], np.array(into, np.int32)[order]
        self.serial = serial
        self.symbol = np.arange(n, n + CODES, dtype=np.int32)
        for x, i in own.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        self.byte = np.zeros(256, np.int32)
        tables = []
        for i, p in enumerate(spec.pieces):
            if p.type == piece.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                tables.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                tables.append(p.piece.replace(SPACE, " ").encode() if p.type == piece.NORMAL else b"" if p.type == piece.CONTROL else train.unk_surface.encode())
        self.table = np.frombuffer(b"".join(tables), np.uint8)
        self.table_len = np.array([len(x) for x in tables], np.int64)
        self.table_at = np.cumsum(self.table_len) - self.table_len
        self.spaced = np.array([p.type == piece.NORMAL and p.piece.startswith(SPACE) for p in spec.pieces])
        self.silent = np.array([p.type == piece.CONTROL for p in spec.pieces])
        used = {c for x in own for c in x}
        out = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in used)
        inner = any(SPACE in x.lstrip(SPACE) for x in own)
        self.cut = None if inner else re.compile(f"[{out}]|{SPACE}+[^{SPACE}{out}]*|[^{SPACE}{out}]+" if out else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.merges: dict[int, tuple[int, int]] = {}
        self.units = UnitEncoder(self.split, self.encode_units)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        return self.cut.findall(text) if self.cut else [text]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * (self.size + CODES) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.into[at]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, flat, and the number of each unit."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        unit, symbol = np.repeat(np.arange(len(units), dtype=np.int32), lengths), self.symbol[codes]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if len(long := np.flatnonzero(lengths > LONG)):
            edge = np.append(0, np.cumsum(lengths))
            for i in long.tolist():
                own = self.merge_long(symbol[edge[i] : edge[i + 1]])
                done.append((np.full(len(own), i, np.int32), own))
            short = np.repeat(lengths <= LONG, lengths)
            unit, symbol = unit[short], symbol[short]
        rank, into = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)
        if len(symbol):
            rank[:-1], into[:-1] = self.pairs(symbol[:-1], symbol[1:])
            rank[:-1][unit[:-1] != unit[1:]] = NONE
        while len(symbol):
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            sizes = np.diff(np.append(starts, len(symbol)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best != NONE, sizes)
            if not live.all():
                done.append((unit[~live], symbol[~live]))
                unit, symbol, rank, into = unit[live], symbol[live], rank[live], into[live]
                sizes, best = sizes[best != NONE], best[best != NONE]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            first = np.append(True, unit[at[1:]] != unit[at[:-1]])
            fresh = np.flatnonzero(first | np.append(True, at[1:] != at[:-1] + 1))
            place = np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))
            at = at[np.where(self.serial[rank[at]], first, place % 2 == 0)]
            symbol[at] = into[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            new = at - np.arange(len(at))  # where the merged symbols are after compaction
            unit, symbol, rank, into = unit[stay], symbol[stay], rank[stay], into[stay]
            near = np.concatenate([new, new[new > 0] - 1])
            near = near[near + 1 < len(symbol)]
            rank[new] = NONE
            rank[near], into[near] = self.pairs(symbol[near], symbol[near + 1])
            rank[near[unit[near] != unit[near + 1]]] = NONE
        unit, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (unit, symbol)
        order = np.argsort(unit, kind="stable")
        unit, symbol = unit[order], symbol[order]
        if len(odd := np.flatnonzero(symbol >= self.size)):  # characters that aren't pieces: their bytes
            raw = [chr(c - self.size).encode() for c in symbol[odd].tolist()]
            times = np.ones(len(symbol), np.int64)
            times[odd] = [len(x) for x in raw]
            to = np.cumsum(times) - times
            symbol, unit = np.repeat(symbol, times), np.repeat(unit, times)
            symbol[gather(np.arange(len(symbol)), to[odd], times[odd])] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol, np.bincount(unit, minlength=len(units)).astype(np.int64)

    def merge_long(self, symbol: np.ndarray) -> np.ndarray:
        """The symbols that are left of one long unit: pairs wait in a heap by rank, then place; a pair that is no longer there is passed over."""
        if not self.merges:
            self.merges = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.into.tolist(), strict=True), strict=True))
        merges, wide, n = self.merges, self.size + CODES, len(symbol)
        rank, into = self.pairs(symbol[:-1], symbol[1:])
        now, symbols = [*rank.tolist(), NONE], symbol.tolist()  # the rank of the pair that begins at each place
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, r in enumerate(now) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if now[i] != r:
                continue
            j = after[i]
            symbols[i] = merges[symbols[i] * wide + symbols[j]][1]
            now[j], symbols[j] = NONE, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0:
                    found = merges.get(symbols[x] * wide + symbols[y]) if y < n else None
                    now[x] = found[0] if found else NONE
                    if found:
                        heapq.heappush(heap, found[0] * n + x)
        return np.array([x for x in symbols if x >= 0], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end, flat, and the offsets of the texts."""
        ids, sizes = self.units.block(texts)
        offs = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 2, out=offs[1:])
        out = np.empty(offs[-1], np.int32)
        inner = np.ones(len(out), bool)
        inner[offs[:-1]] = inner[offs[1:] - 1] = False
        out[inner] = ids
        out[offs[:-1]], out[offs[1:] - 1] = self.begin, self.end
        return out, offs

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """The texts of ids[offs[i]:offs[i + 1]]."""
        lengths = self.table_len[ids]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=edge[1:])
        data = gather(self.table, self.table_at[ids], lengths).tobytes()
        loud = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        first = np.minimum(loud[np.searchsorted(loud, offs[:-1])], offs[1:])
        skip = np.zeros(len(offs) - 1, bool)
        some = first < offs[1:]
        skip[some] = self.spaced[ids[first[some]]] & bool(self.prefix)
        out = []
        for i, (a, b) in enumerate(zip((edge[offs[:-1]] + skip).tolist(), edge[offs[1:]].tolist(), strict=True)):
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:  # bytes that no text gives; how they are replaced is up to the library
                out.append(self.library.decode(ids[offs[i] : offs[i + 1]].tolist()))
        return out


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode_decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded of each row of df(doc_id, text, ..).

    A null text is the empty one, whose ids are begin and end. Repeated rows stay repeated, a null doc_id stays null, other
    columns are ignored. A very long text is one block, whose memory follows its length; its time does too, with or without spaces. `path` is a model file at the same place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rows, _, _ in blocks(batches, "text"):
            ids, offs = m.encode([x or "" for x in rows.column("text").to_pylist()])
            raw = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), raw, pa.array(m.decode(ids, offs), pa.string())], names=["doc_id", "ids", "decoded"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
