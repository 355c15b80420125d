"""Language identification by a linear-chain conditional random field.

Each word of a text gets a label. A word's score for a label is the sum of weights of its character n-grams (with marks at
both ends, so that they include prefixes and suffixes) and of its entry in a lexicon; learned transition weights tie
neighbouring words. The model is trained on sequences that switch between labelled texts, by the exact gradient from
forward-backward; a text's language is the label with the largest mean of its words' posterior probabilities, which comes
from forward-backward over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import K1, K2, U64, Spans, blocks, mix, release, table
from ._units import gather


@dataclass(frozen=True)
class Training:
    """The model is fitted on a bounded sample of `documents` labelled texts: the first of each language, then the second of each, and so on,
    each language's in the order of a hash of their doc_id. Texts of more than `characters` characters come after the language's
    others, cut to so many. The bound keeps the driver's work the same whatever the input."""

    documents: int = 1500
    characters: int = 8000
    bits: int = 17
    grams: tuple[int, ...] = (1, 2, 3, 4)
    sequence: int = 64
    run: int = 16
    rounds: int = 30
    rate: float = 0.15
    decay: float = 1e-4
    seed: int = 7


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its lower case as a 64-bit random value."""
    def small(c: str) -> int:
        x = c.lower()
        return ord(x if len(x) == 1 else c)

    every = range(0x110000)
    return np.fromiter((chr(i).isalpha() for i in every), bool, len(every)), np.fromiter((small(chr(i)) for i in every), np.uint32, len(every))



def value(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) * K1 + K2)


@dataclass
class Split:
    """The words of a block: for each word its distinct word, and the distinct words' characters."""

    of: np.ndarray
    row: np.ndarray
    keys: np.ndarray
    flat: np.ndarray
    edge: np.ndarray


def split(data: np.ndarray, offs: np.ndarray) -> Split:
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    offs = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offs]
    is_letter, low = letters()
    solid = is_letter[codes]
    cut = np.zeros(len(codes) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(solid & (np.append(True, ~solid[:-1]) if len(codes) else solid | cut[:-1]) | solid & cut[:-1])
    ends = np.flatnonzero(solid & (np.append(~solid[1:], True) if len(codes) else solid) | solid & cut[1:]) + 1
    codes = low[codes]
    keys = Spans(value(codes))(starts, ends)
    distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
    sizes = (ends - starts)[first] + 2
    edge = np.append(0, np.cumsum(sizes))
    flat = np.ones(edge[-1], np.uint32)  # marks stay where no letter comes
    inner = np.ones(len(flat), bool)
    inner[edge[:-1]] = inner[edge[1:] - 1] = False
    flat[inner] = gather(codes, starts[first], sizes - 2)
    return Split(of, np.searchsorted(offs, starts, side="right") - 1, distinct, flat, edge)


def joined(parts: list[Split], rows: list[int]) -> Split:
    """What split() gives for blocks one after the other, of which each has so many rows, from their own splits."""
    n, chars = [np.append(0, np.cumsum([len(x) for x in each])) for each in ([p.keys for p in parts], [p.flat for p in parts])]
    keys, first, back = np.unique(np.concatenate([p.keys for p in parts]), return_index=True, return_inverse=True)
    starts = np.concatenate([p.edge[:-1] + c for p, c in zip(parts, chars[:-1], strict=True)])[first]
    sizes = np.concatenate([np.diff(p.edge) for p in parts])[first]
    of = np.concatenate([back[p.of + i] for p, i in zip(parts, n[:-1], strict=True)])
    row = np.concatenate([p.row + r for p, r in zip(parts, np.append(0, np.cumsum(rows))[:-1], strict=True)])
    return Split(of, row, keys, gather(np.concatenate([p.flat for p in parts]), starts, sizes), np.append(0, np.cumsum(sizes)))


def features(s: Split, t: Training) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length the buckets of all n-grams of the distinct words and where the words' n-grams begin; every word has some."""
    spans = Spans(value(s.flat))
    word = np.repeat(np.arange(len(s.edge) - 1), np.diff(s.edge))
    for n in t.grams:
        at = np.arange(max(len(s.flat) - n + 1, 0))
        at = at[word[at] == word[at + n - 1]]
        yield (mix(spans(at, at + n) + U64(n * int(K2) & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - t.bits)).astype(np.int64), word[at]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    moves: np.ndarray
    training: Training

    def emissions(self, s: Split) -> np.ndarray:
        out = np.zeros((len(s.keys), len(self.labels)), np.float32)
        for bucket, word in features(s, self.training):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
            if len(starts):
                out[word[starts]] += np.add.reduceat(self.weights[bucket], starts, axis=0)
        at = np.minimum(np.searchsorted(self.lexicon, s.keys), max(len(self.lexicon) - 1, 0))
        if len(self.lexicon):
            out += np.where((self.lexicon[at] == s.keys)[:, None], self.lexicon_weights[at], 0)
        return out


def posteriors(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posterior label probabilities of all positions of sequences that lie one after the other, and, if asked for, the expected
    number of each pair of neighbouring labels. Sequences step together, long ones first."""
    order = np.argsort(-sizes, kind="stable")
    starts, long = (np.cumsum(sizes) - sizes)[order], sizes[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    alpha = np.empty_like(e)
    active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")  # sequences with more than t positions
    a = np.zeros((0, e.shape[1]), e.dtype)
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        a = e[at] if t == 0 else (a[:n] @ step) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.ones((len(long), e.shape[1]), e.dtype)
    expected = np.zeros_like(step)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        if t + 1 < len(active) and (m := active[t + 1]):
            ahead = b[:m] * e[at[:m] + 1]
            now = ahead @ step.T
            if pairs:
                whole = (alpha[at[:m]] * now).sum(axis=1, keepdims=True)
                expected += (alpha[at[:m]] / whole).T @ ahead * step
            b[:m] = now / now.sum(axis=1, keepdims=True)
        p = alpha[at] * b[:n]
        alpha[at] = p / p.sum(axis=1, keepdims=True)
    return alpha, expected


#: Texts that are split at once, and sequences that go forward and backward at once, when a model is fitted on the driver.
FIT_TEXTS, FIT_SEQUENCES = 50, 2048


def fit(texts: list[str], langs: list[str], t: Training = Training()) -> Model:
    """Adam on the whole sample: log likelihood of labels in sequences that switch between texts."""
    from ._base import flat as flatten

    labels = sorted(set(langs))
    k = len(labels)
    # by blocks, as a split takes some fifty bytes for each character while it works
    parts = [texts[at : at + FIT_TEXTS] for at in range(0, len(texts), FIT_TEXTS)]
    s = joined([split(*flatten(pa.array(x, pa.string()))) for x in parts], [len(x) for x in parts])
    release()
    gold_of_row = np.array([labels.index(x) for x in langs])
    # runs of words, each from one text, in random order one after the other and cut into sequences
    rng = np.random.default_rng(t.seed)
    change = np.flatnonzero((rng.random(len(s.of)) < 1 / t.run) | np.append(True, s.row[1:] != s.row[:-1])) if len(s.of) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(change, len(s.of)))
    mixed = rng.permutation(len(change))
    at = gather(np.arange(len(s.of)), change[mixed], sizes[mixed])
    of, gold = s.of[at], gold_of_row[s.row[at]]
    full = len(of) // t.sequence
    seq = np.append(np.full(full, t.sequence), len(of) - full * t.sequence)
    seq = seq[seq > 0]
    grams = [(bucket.astype(np.int32), word.astype(np.int32)) for bucket, word in features(s, t)]
    seen = np.bincount(of, minlength=len(s.keys))
    lexicon = np.flatnonzero(seen > 1)
    place = np.full(len(s.keys), -1)
    place[lexicon] = np.arange(len(lexicon))
    params = [np.zeros((1 << t.bits, k), np.float32), np.zeros((len(lexicon), k), np.float32), np.zeros((k, k), np.float32)]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    begins = np.cumsum(seq) - seq
    inside = np.ones(len(of), bool)
    inside[begins] = False
    follow = np.flatnonzero(inside)  # positions with one before them in their sequence
    spread = lambda index, rows, size, at=slice(None): np.stack([np.bincount(index, rows[:, j][at], size) for j in range(k)], 1)
    true = np.bincount(gold[follow - 1] * k + gold[follow], minlength=k * k).reshape(k, k)
    model = Model(labels, params[0], s.keys[lexicon], params[1], params[2], t)
    for i in range(1, t.rounds + 1):
        scores, by_word, pair = model.emissions(s), np.zeros((len(s.keys), k)), np.zeros((k, k))
        for at in range(0, len(seq), FIT_SEQUENCES):
            here = slice(begins[at], begins[at] + seq[at : at + FIT_SEQUENCES].sum())
            error, some = posteriors(scores[of[here]].astype(np.float64), seq[at : at + FIT_SEQUENCES], params[2].astype(np.float64), pairs=True)
            error[np.arange(len(error)), gold[here]] -= 1
            by_word += spread(of[here], error, len(s.keys))
            pair += some
        grads = [sum(spread(bucket, by_word, 1 << t.bits, word) for bucket, word in grams), by_word[lexicon], pair - true]  # a length at a time
        for x, (m, v), g in zip(params, state, grads, strict=True):
            g = (g / max(len(of), 1) * 100 + t.decay * x).astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= t.rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample(df: DataFrame, t: Training) -> tuple[list[str], list[str]]:
    """The training texts and their labels. Counts by language tell how many rows of each are needed; a hash threshold made from them leaves
    about twice as many, so that neither texts nor keys of the others are shuffled."""
    rows = df.where("text IS NOT NULL AND lang IS NOT NULL").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    rows = rows.select("lang", (F.char_length("text") > t.characters).alias("_long"), F.xxhash64("doc_id").alias("_o"), "text")
    counts = rows.groupBy("lang").agg(F.count_if(~F.col("_long")).alias("short"), F.count_if("_long").alias("long"), F.min(F.struct("_long", "_o", "text")).getField("_o").alias("_o"))
    # no language beyond these can have its first row in the sample, so this table has a bound
    held = counts.orderBy("_o", "lang").limit(t.documents).select("lang", "short", "long").collect()
    need = next((r for r in range(1, t.documents + 1) if sum(min(x.short + x.long, r) for x in held) >= t.documents), t.documents)
    # so many are expected that fewer than needed have a chance below e**-60
    share = lambda n, count: min(1.0, (2.0 * n + 60) / count) if n > 0 and count else 0.0
    limits = [(x.lang, share(need, x.short), share(need - x.short, x.long)) for x in held]
    limits = F.broadcast(df.sparkSession.createDataFrame(limits, "lang string, _short_share double, _long_share double"))
    rows = rows.join(limits, "lang").where(F.col("_o") / F.lit(2.0**64) + 0.5 <= F.when(F.col("_long"), F.col("_long_share")).otherwise(F.col("_short_share")))
    rows = rows.select("lang", "_long", "_o", F.substring("text", 1, t.characters).alias("text"))
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy("_long", "_o", "text"))).where(F.col("_r") <= t.documents)
    got = rows.orderBy("_r", "_o", "text", "lang").limit(t.documents).select("text", "lang").collect()
    return [r.text for r in got], [r.lang for r in got]


def judged(m: Model, s: Split, words: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of the words of a block; `some` are the rows that have words, and `words` the numbers of all rows."""
    return posteriors(m.emissions(s)[s.of], words[some], m.moves)[0]


def label_words(df: DataFrame, t: Training = Training(), model: Model | None = None) -> DataFrame:
    """doc_id, words: for each row of df(doc_id, text, ..) an array of (word, label, posterior) in the text's order, for text that switches
    between languages. A word is a run of letters, in lower case; its label is the one with the largest posterior probability from
    forward-backward over the whole text, the first of equal ones.

    A null text, or one without a letter, has no words. A very long text is one block, in memory that follows its length. Without any
    labelled row no word has a label: arrays are empty.
    """
    model = model or trained(df, t)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, offs in blocks(batches, "text"):
            n = len(offs) - 1
            if not m.labels:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([[]] * n, kind)], names=["doc_id", "words"])
                continue
            s = split(data, offs)
            words = np.bincount(s.row, minlength=n)
            some = np.flatnonzero(words)
            p = judged(m, s, words, some) if len(some) else np.zeros((0, len(m.labels)))
            inner = np.ones(len(s.flat), bool)
            inner[s.edge[:-1]] = inner[s.edge[1:] - 1] = False
            text, edge = s.flat[inner].astype("<u4").tobytes().decode("utf-32-le"), (s.edge - 2 * np.arange(len(s.edge))).tolist()
            distinct = [text[a:b] for a, b in zip(edge, edge[1:], strict=False)]
            cells = pa.StructArray.from_arrays([pa.array([distinct[i] for i in s.of.tolist()], pa.string()), pa.array([m.labels[i] for i in p.argmax(axis=1).tolist()], pa.string()), pa.array(p.max(axis=1).astype(np.float64) if len(p) else [], pa.float64())], names=["word", "label", "posterior"])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words)).astype(np.int32)), cells)], names=["doc_id", "words"])

    kind = pa.list_(pa.struct([("word", pa.string()), ("label", pa.string()), ("posterior", pa.float64())]))
    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, words array<struct<word:string,label:string,posterior:double>>")


def trained(df: DataFrame, t: Training) -> Model:
    texts, langs = sample(df, t)
    try:
        return fit(texts, langs, t) if langs else Model([], np.zeros((0, 0)), np.zeros(0, U64), np.zeros((0, 0)), np.zeros((0, 0)), t)
    finally:
        release()  # the driver keeps on working, and needn't hold what the fit took


def identify(df: DataFrame, t: Training = Training(), model: Model | None = None, passed: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words of each row of df(doc_id, text, lang, ..); if passed, all columns of df with
    __patchloom_lang and __patchloom_score instead.

    Only texts and labels of rows that aren't held out train the model. A text that is null or has no letter is `und` with score
    0, as every text is where no labelled row exists. Held-out is false for a null doc_id, which trains nothing. Ties go to the
    label that sorts first. Repeated rows stay repeated, other columns are ignored. A very long text is one block, labelled whole.
    """
    model = model or trained(df, t)
    # 2**bits weights for each label and a lexicon of the bounded sample: a few MB whatever the input
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, offs in blocks(batches, "text"):
            n, k = len(offs) - 1, len(m.labels)
            best, score, words = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
            if k:
                s = split(data, offs)
                words = np.bincount(s.row, minlength=n)
                some = np.flatnonzero(words)
                if len(some):
                    p = judged(m, s, words, some)
                    starts = np.cumsum(words[some]) - words[some]
                    mean = np.add.reduceat(p.astype(np.float64), starts, axis=0) / words[some][:, None]
                    best[some] = mean.argmax(axis=1)
                    score[some] = np.clip(mean.max(axis=1), 0, 1)
            pred = [m.labels[i] if i >= 0 else "und" for i in best.tolist()]
            if passed:
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*rows.schema.names, "__patchloom_lang", "__patchloom_score"])
                continue
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(words)], names=["doc_id", "held_out", "lang_pred", "score", "n_words"])

    if passed:
        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__patchloom_lang", T.StringType()), T.StructField("__patchloom_score", T.DoubleType())]))
    own = df.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return own.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, n_words bigint")


def accepted(df: DataFrame, least: float = 0.5, t: Training = Training()) -> DataFrame:
    """The rows of df, with all their columns, whose text has a language with a score of at least `least`."""
    judged = identify(df, t, passed=True)
    return judged.where((F.col("__patchloom_lang") != "und") & (F.col("__patchloom_score") >= least)).select(*df.columns)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
