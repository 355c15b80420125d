"""Token ids in files compressed by a grammar.

Texts are encoded by the tokenizers library, each distinct part of a word once for a block. The ids of a shard, in ascending doc_id
order, are compressed by Re-Pair: frequent pairs of ids are replaced by nonterminals, again and again. A file holds the
rules, their expansion lengths, the remaining sequence with a running length at every STEP-th symbol, and the table of
documents, so that any span of ids can be decoded without the rest. Files are rows of a Parquet table (shard key and
payload), so that Spark's committer writes them and they survive a lost executor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BYTE, K2, WHITE, Scratch, Spans, blocks, mix, table
from ._units import gather

MAGIC = b"RPG2"
STEP = 1024
#: Ids of a shard at which it is closed, after the block of whole documents that reaches them.
SHARD_IDS = 1 << 20
#: Occurrences from which a rule pays for itself: it takes two symbols and a length, and makes all symbols a little wider; each occurrence saves one.
LEAST = 4


# ---- the grammar


def cells(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """The spans of data that begin and end at these bytes, as one column."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])


def joined(flat: np.ndarray, offs: np.ndarray, own: pa.Array) -> np.ndarray:
    """The spans `own` of those between the offsets of flat, whose values are of 32 bits, one after the other."""
    _, to, out = cells(flat, offs * 4).take(own).buffers()
    return np.frombuffer(out, flat.dtype)[: np.frombuffer(to, np.int64)[len(own)] // 4]


def length_of(symbols: np.ndarray, long: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    return np.append(long, 1)[np.where(symbols >= vocabulary, symbols - vocabulary, len(long))]


def ordered(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Pairs of symbols below `symbols` in ascending order, as numbers whose low bits are where each was; where each distinct pair begins, and a mask of the low bits."""
    width, low = max(1, symbols - 1).bit_length(), max(1, len(left) - 1).bit_length()
    keys = left.astype(np.uint64) << np.uint64(width) | right.astype(np.uint64)
    if 2 * width + low > 64:
        keys = np.unique(keys, return_inverse=True)[1].astype(np.uint64)
    # sorting the pairs with their places takes a third of the time of finding an order
    keys <<= np.uint64(low)
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    new = np.ones(len(keys), bool)
    np.greater_equal(keys[1:] ^ keys[:-1], np.uint64(1 << low), out=new[1:])
    return keys, np.flatnonzero(new), np.uint64((1 << low) - 1)


def without(x: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """x without the places `gone`, which ascend."""
    if len(gone) < len(x) >> 10:
        return np.concatenate([x[a:b] for a, b in zip([0, *(gone + 1).tolist()], [*gone.tolist(), len(x)], strict=True)])
    stay = np.ones(len(x), bool)
    stay[gone] = False
    return x[stay]


#: The bit of a place that needn't be looked at again; it makes the symbol negative.
DONE = np.int32(-1 << 31)
SYMBOL = ~DONE


def compress(ids: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The remaining sequence, the rules (pairs; rule i is the symbol vocabulary + i) and their expansion lengths.

    A round replaces all pairs found at least as often as a sixteenth of the most frequent one, the more frequent first where they overlap, and
    repeats of one symbol from the left. The rounds after it look only at pairs with a symbol of the round before, as no others can have
    become frequent; where none of these reaches the bound, all pairs are counted anew. This ends when no pair occurs `least` times.
    """
    seq, rules, long = ids.astype(np.int32), np.zeros((0, 2), np.int64), np.ones(0, np.int64)
    # after the round that first counts a pair it only becomes rarer, so places of pairs found less than `least` times are done until a merge beside them
    at, bound = None, least
    while len(seq) > 1:
        whole = at is None
        if whole:
            at = np.flatnonzero(seq[:-1] >= 0)
            if not len(at):
                break
        keys, starts, low = ordered(seq[at], seq[at + 1] & SYMBOL, vocabulary + len(rules))
        counts = np.diff(starts, append=len(keys))
        if whole:
            bound = max(least, counts.max() // 16)
        seq[at[(keys[np.repeat(counts < least, counts)] & low).view(np.int64)]] |= DONE
        often = np.flatnonzero(counts >= bound)
        sizes = counts[often]
        chosen = np.lexsort((starts[often], -sizes))
        ranked = np.empty(len(often), np.int32)
        ranked[chosen] = np.arange(len(often), dtype=np.int32)
        lead = at[(keys[starts[often][chosen]] & low).view(np.int64)]
        level = np.full(len(at), -1, np.int32)
        level[(gather(keys, starts[often], sizes) & low).view(np.int64)] = np.repeat(ranked, sizes)
        some = np.flatnonzero(level >= 0)
        places, level = at[some], level[some]
        beside = places[1:] == places[:-1] + 1
        level *= 2
        again = np.flatnonzero(beside & (level[1:] == level[:-1])) + 1  # a repeat's second place and those after it: every other one comes later
        run = np.flatnonzero(np.append(True, again[1:] != again[:-1] + 1)[: len(again)])
        level[again] += 1 - (np.arange(len(again)) - np.repeat(run, np.diff(np.append(run, len(again))))).astype(np.int32) % 2
        less = level[1:] < level[:-1]
        wins = np.ones(len(places), bool)
        wins[1:] &= ~beside | less
        wins[:-1] &= ~(beside & less)
        places, level = places[wins], level[wins] // 2
        pays = np.bincount(level, minlength=len(often)) >= least  # where others took its places, a pair may have too few left
        if not pays.any():
            if whole:
                break
            at = None
            continue
        paid = pays[level]
        places, level = places[paid], level[paid]
        pairs = np.stack([seq[lead[pays]], seq[lead[pays] + 1] & SYMBOL], 1).astype(np.int64)
        seq[places] = vocabulary + len(rules) + (np.cumsum(pays) - 1)[level]
        rules, long = np.concatenate([rules, pairs]), np.concatenate([long, length_of(pairs, long, vocabulary).sum(axis=1)])
        seq = without(seq, places + 1)
        new = places - np.arange(len(places))
        at = np.stack([new - 1, new], 1).reshape(-1)  # ascending, as no two merges overlap
        at = at[np.append(True, at[1:] != at[:-1])]
        at = at[(at >= 0) & (at < len(seq) - 1)]
        seq[at] &= SYMBOL
        if not len(at):
            at = None
    return seq & SYMBOL, rules, long


def expand(seq: np.ndarray, rules: np.ndarray, long: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids that a sequence stands for. Only the rules that it needs are opened, each once, a level of all of them at a time."""
    used = np.zeros(vocabulary + len(rules), bool)
    used[seq] = True
    symbols = np.flatnonzero(used)
    place = np.cumsum(used) - 1
    sizes = length_of(symbols, long, vocabulary)
    starts = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), np.uint32)
    todo, at = symbols, starts
    while len(todo):
        leaf = todo < vocabulary
        flat[at[leaf]] = todo[leaf]
        left, right = rules[todo[~leaf] - vocabulary].T
        at = at[~leaf]
        todo, at = np.concatenate([left, right]), np.concatenate([at, at + length_of(left, long, vocabulary)])
    return joined(flat, np.append(starts, len(flat)), pa.array(place[seq]))


# ---- the file


def squeeze(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, without gaps. Eight values fill `width` bytes."""
    eight = np.zeros((-(-len(values) // 8), 8), np.uint64)
    eight.reshape(-1)[: len(values)] = values
    eight = np.ascontiguousarray(eight.T & np.uint64((1 << width) - 1))
    out = np.zeros((width, eight.shape[1]), np.uint8)
    for k in range(width):
        for i in range(8 * k // width, (8 * k + 7) // width + 1):
            right = (i + 1) * width - 8 * (k + 1)
            out[k] |= (eight[i] >> np.uint64(right) if right >= 0 else eight[i] << np.uint64(-right)).astype(np.uint8)
    return np.ascontiguousarray(out.T).reshape(-1)[: -(-len(values) * width // 8)].tobytes()


def unsqueeze(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    eight = np.zeros((-(-n // 8), width), np.uint8)
    eight.reshape(-1)[: -(-n * width // 8)] = raw[: -(-n * width // 8)]
    eight = np.ascontiguousarray(eight.T)
    out = np.empty((eight.shape[1], 8), np.int64)
    for i in range(8):
        to = -(-(i + 1) * width // 8)
        bits = np.zeros(eight.shape[1], np.uint64)
        for k in range(i * width // 8, to):
            bits = bits << np.uint64(8) | eight[k]
        out[:, i] = bits >> np.uint64(8 * to - (i + 1) * width) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n]


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Values in the least of 1, 2, 4 or 8 bytes each that all fit in."""
    most = int(values.max()) if len(values) else 0
    size = next(k for k in (1, 2, 4, 8) if most < 1 << 8 * k)
    return size, values.astype(f"<u{size}").tobytes()


HEAD = "<4s4B6Q"


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, vocabulary: int, least: int = LEAST) -> bytes:
    """A shard's file. Symbols take as many bits as the largest needs."""
    seq, rules, long = compress(ids, vocabulary, least)
    each = length_of(seq, long, vocabulary)
    before = (np.cumsum(each) - each)[::STEP]
    width = max(1, int(vocabulary + len(rules)).bit_length())
    (size_size, sizes_), (long_size, long_), (before_size, before_) = narrow(sizes), narrow(long), narrow(before)
    head = struct.pack(HEAD, MAGIC, width, size_size, long_size, before_size, vocabulary, len(doc_ids), len(ids), len(rules), len(before), len(seq))
    null = np.packbits(np.array([x is None for x in doc_ids], bool)).tobytes()
    return b"".join([head, null, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), sizes_, squeeze(rules.reshape(-1), width), long_, before_, squeeze(seq, width)])


class File:
    """A shard's file, read from its bytes. Symbols are only unpacked, and rules only opened, as far as they are asked for."""

    def __init__(self, raw: bytes):
        magic, self.width, size_size, long_size, before_size, self.vocabulary, docs, self.n_ids, rules, steps, self.symbols = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        null, ids = np.unpackbits(take("u1", -(-docs // 8)), count=docs), take("<i8", docs)
        self.doc_ids = [None if x else i for x, i in zip(null.tolist(), ids.tolist(), strict=True)]
        self.sizes = take(f"<u{size_size}", docs).astype(np.int64)
        self.rules = unsqueeze(take("u1", -(-2 * rules * self.width // 8)), 2 * rules, self.width).reshape(-1, 2)
        self.long = take(f"<u{long_size}", rules).astype(np.int64)
        self.before = take(f"<u{before_size}", steps).astype(np.int64)
        self.seq = take("u1", -(-self.symbols * self.width // 8))
        if at != len(raw):
            raise ValueError("the file's length doesn't fit its head")

    def part(self, a: int, b: int) -> np.ndarray:
        """Symbols a * STEP to b * STEP; STEP symbols are whole bytes."""
        n = min(b * STEP, self.symbols) - a * STEP
        return unsqueeze(self.seq[a * STEP * self.width // 8 :], n, self.width)

    def all(self) -> np.ndarray:
        return expand(self.part(0, len(self.before)), self.rules, self.long, self.vocabulary) if self.symbols else np.zeros(0, np.uint32)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, decoding only the blocks of STEP symbols that hold them."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError("span outside the shard")
        if start == stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.before, start, "right")) - 1
        b = int(np.searchsorted(self.before, stop, "left"))
        out = expand(self.part(a, b), self.rules, self.long, self.vocabulary)
        return out[start - self.before[a] : stop - self.before[a]]


# ---- the tokenizer

#: Kinds of bytes: white space, letters, digits, marks, and what may belong to its neighbours, as apostrophes of "'s" and characters that combine.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[WHITE] = SPACE
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[x for x in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if x != 39]] = SIGN
#: The same where only white space ends a unit.
BLANKS = np.where(WHITE, SPACE, LETTER).astype(np.uint8)
#: Whether a unit ends between two kinds, at 8 * the first + the second: at white space, and where both kinds are known.
ENDS = bytes(a != b and (SPACE in (a, b) or OTHER not in (a, b)) for a in range(8) for b in range(8)).ljust(256)


def through(table: bytes, data: np.ndarray) -> np.ndarray:
    """table[data] of bytes; a string's own way takes a fraction of the time."""
    return np.frombuffer(bytearray(data.tobytes().translate(table)), np.uint8)


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; the letters from À to ÿ, without × and ÷, are two bytes that begin with C3."""
    out = through(KINDS.tobytes(), data)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = LETTER
    return out


def units(data: np.ndarray, offs: np.ndarray, parts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that aren't white space, the offsets in them of words, or of the `parts` of words that no token crosses, and how many of these come before each text and in all."""
    kind = kinds(data) if parts else through(BLANKS.tobytes(), data)
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = through(ENDS, kind[:-1] << 3 | kind[1:])
    edge[offs] = True
    starts, solid = np.flatnonzero(edge), kind != SPACE
    full = solid[starts[:-1]]
    return data[solid], np.append(0, np.cumsum(np.diff(starts)[full])), np.searchsorted(starts[:-1][full], offs)


#: A second random value for each byte, for a second hash of a unit.
SECOND = mix(np.arange(257, 513, dtype=np.uint64) * K2)


class Words:
    """Ids of units of texts from the tokenizers library: words between white space, and parts of them that no token crosses. Ids of units seen before come
    from a bounded store.

    Within a block units are told apart by their bytes, and those of the store by two 64-bit hashes. Where two units share the first one, which
    `bits` shortens in tests, the block's units are encoded by themselves.
    """

    def __init__(self, path: str, most: int = 4_000_000, bits: int = 64):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most, self.bits = Tokenizer.from_file(path), most, bits
        self.size = max(self.library.get_vocab().values()) + 1
        bar = self.library.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else -1
        self.clear()

    def clear(self) -> None:
        self.keys, self.others = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat: np.ndarray = np.zeros(1 << 20, np.int32)
        self.used = 0

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, flat, and how many each has. Those of letters are joined by bars, whose ids tell them apart."""
        starts, sizes = offs[:-1], np.diff(offs)
        odd = np.append(0, np.cumsum(kinds(data) != LETTER))
        plain = odd[offs[1:]] == odd[starts]
        own, rest = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        pieces, owners, counts = [], [], []
        for k in range(0, len(own), 1000):
            some = own[k : k + 1000]
            text = gather(np.append(data, np.uint8(124)), starts[some], sizes[some] + 1)
            text[np.cumsum(sizes[some] + 1) - 1] = 124
            (got,) = self.library.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)
            ids = np.array(got.ids, np.int32)
            bars = np.flatnonzero(ids == self.bar)
            if len(bars) != len(some):
                rest.append(some)
                continue
            pieces.append(np.delete(ids, bars))
            owners.append(some)
            counts.append(np.diff(bars, prepend=-1) - 1)
        other = np.concatenate(rest)
        if len(other):
            raw = data.tobytes()
            got = [e.ids for e in self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[other].tolist(), offs[other + 1].tolist(), strict=True)], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            pieces.append(np.fromiter(chain.from_iterable(got), np.int32, int(counts[-1].sum())))
            owners.append(other)
        if not owners:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, n, to = np.concatenate(pieces), np.concatenate(counts), np.empty(len(starts), np.int64)
        to[np.concatenate(owners)] = np.arange(len(starts))
        return gather(flat, (np.cumsum(n) - n)[to], n[to]), n[to]

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, flat, and how many each text has."""
        if len(self.keys) > self.most:
            self.clear()
        raw = data.tobytes()
        parts = b"<|" not in raw  # no special token, whose case and place would matter
        # the tokenizer makes A-Z small in any case; done first, there are fewer distinct units
        own, begin, count = units(np.frombuffer(raw.lower(), np.uint8) if parts else data, offs, parts)
        if not len(own):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        found = cells(own, begin).dictionary_encode()
        _, edge, raw = found.dictionary.buffers()
        edge = np.frombuffer(edge, np.int64)[: len(found.dictionary) + 1]
        ids, n = self.distinct(np.frombuffer(raw, np.uint8)[: edge[-1]], edge)
        out = cells(ids, np.append(0, np.cumsum(n) * 4)).take(found.indices)
        _, to, flat = out.buffers()
        to = np.frombuffer(to, np.int64)[: len(out) + 1] // 4
        return np.frombuffer(flat, np.int32)[: to[-1]], np.diff(to[count])

    def distinct(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, flat, and how many each has: from the store, or else encoded and kept there."""
        first, second = (Spans(x[data])(offs[:-1], offs[1:]) for x in (BYTE, SECOND))
        first >>= np.uint64(64 - self.bits)
        order = np.argsort(first)
        keys, others = first[order], second[order]
        at = np.searchsorted(self.keys, keys)
        have = at < len(self.keys)
        have[have] = self.keys[at[have]] == keys[have]
        if (keys[1:] == keys[:-1]).any() or (self.others[at[have]] != others[have]).any():
            return self.encode(data, offs)
        new = np.flatnonzero(~have)
        if len(new):
            own = order[new]
            sizes = offs[own + 1] - offs[own]
            ids, n = self.encode(gather(data, offs[own], sizes), np.append(0, np.cumsum(sizes)))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            to = at[new]
            self.starts = np.insert(self.starts, to, self.used + np.cumsum(n) - n)
            self.lengths = np.insert(self.lengths, to, n)
            self.keys, self.others = np.insert(self.keys, to, keys[new]), np.insert(self.others, to, others[new])
            self.used += len(ids)
            at += np.cumsum(~have) - ~have
        back = np.empty(len(order), np.int64)
        back[order] = at
        n = self.lengths[back]
        return gather(self.flat, self.starts[back], n), n


@lru_cache(2)
def tokenizer(path: str) -> Words:
    return Words(path)


# ---- the operator

PREFIX = 64
FILES = "part bigint, shard bigint, base bigint, n_ids bigint, payload binary"


def write_files(df: DataFrame, path: str, end_id: int, scratch: Scratch, name: str = "files", shard_ids: int = SHARD_IDS, block: int = 2 << 20) -> DataFrame:
    """Encodes df(doc_id, text, ..) in ascending doc_id order (null first, ties by text) and writes the shards' files.

    Each document gets end_id behind its ids; a null text is the empty one. Returns the files as a table: part and shard give
    their order, base the ids before the shard within its part. Documents are dealt out by ranges of doc_id and of the first PREFIX characters
    of the text, so that rows without doc_id, or with one doc_id, don't meet in one task unless their texts begin alike. A very long text is a
    block, and a shard, of its own. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tokenizer(path), TaskContext.get().partitionId()
        docs, sizes, ids, held, shard, base = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            raw = pack(docs, np.concatenate(sizes), np.concatenate(ids), max(t.size, end_id + 1))
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "base": base, "n_ids": held, "payload": raw}], schema=schema)

        schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("base", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for rows, data, offs in blocks(batches, "text", block):
            own, n = t.block(data, offs)
            to = np.cumsum(n + 1)
            out = np.full(int(to[-1]), end_id, np.int32)
            inner = np.ones(len(out), bool)
            inner[to - 1] = False
            out[inner] = own
            docs += rows.column("doc_id").to_pylist()
            sizes.append(n + 1)
            ids.append(out)
            held += len(out)
            if held >= shard_ids:
                yield close()
                docs, sizes, ids, shard, base, held = [], [], [], shard + 1, base + held, 0
        if docs:
            yield close()

    ranged = df.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    return scratch.write(ranged.mapInArrow(run, FILES), name)


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, raw in zip(*(batch.column(x).to_pylist() for x in ("part", "base", "payload")), strict=True):
                f = File(raw)
                ends = np.cumsum(f.sizes)
                ids = f.all().astype("<u4")
                offs = np.append(0, ends)
                cells = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer((offs * 4).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(np.full(len(ends), part)), pa.array(base + ends - f.sizes), pa.array(f.sizes), cells], names=["doc_id", "part", "start", "n_tokens", "ids"])

    # one row for each part, as many as shuffle partitions whatever the input, so their running sum fits one task and every executor
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.selectExpr("part AS _part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    docs = files.select("part", "base", "payload").mapInArrow(run, "doc_id bigint, part bigint, start bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(before), F.col("part") == F.col("_part")).select("doc_id", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids")


def read_some(files: DataFrame, ids: list[int]) -> DataFrame:
    """doc_id, n_tokens, ids of the documents with these doc_ids only: each file is opened at their spans, the rest isn't decoded."""
    asked = np.array(sorted(set(ids)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                f = File(raw)
                ends = np.cumsum(f.sizes)
                own = [i for i, x in enumerate(f.doc_ids) if x is not None and len(asked) and asked[min(np.searchsorted(asked, x), len(asked) - 1)] == x]
                cells = [f.span(int(ends[i] - f.sizes[i]), int(ends[i])).astype("<u4").tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([pa.array([f.doc_ids[i] for i in own], pa.int64()), pa.array(f.sizes[own]), pa.array(cells, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return files.select("payload").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def op9_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, Scratch(spark, "op9"))
    return read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
