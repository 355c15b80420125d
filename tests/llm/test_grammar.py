"""Parts of words that are encoded once, and rounds of Re-Pair against a plain version of them."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from patchloom.llm import grammar
from patchloom.llm._base import flat

PATH = P.path("word_bpe_49k.json")


def plain_rounds(ids, vocabulary, least):
    """The rounds that `compress` describes, each counting all pairs that it may take."""
    seq, rules, new, bound = list(ids), [], None, least
    while len(seq) > 1:
        whole = new is None
        at = [i for i in range(len(seq) - 1) if whole or seq[i] in new or seq[i + 1] in new]
        if not at:
            new = None
            continue
        pair = {i: (seq[i], seq[i + 1]) for i in at}
        counts = Counter(pair.values())
        if whole:
            bound = max(least, max(counts.values()) // 16)
        rank = {p: k for k, p in enumerate(sorted((p for p, n in counts.items() if n >= bound), key=lambda p: (-counts[p], p)))}
        level, odd = {}, 0
        for i in at:
            if pair[i] in rank:
                odd = 1 - odd if pair.get(i - 1) == pair[i] else 0
                level[i] = 2 * rank[pair[i]] + odd
        wins = [i for i, x in level.items() if x < min(level.get(i - 1, x + 1), level.get(i + 1, x + 1))]
        taken = Counter(pair[i] for i in wins)
        name = {p: vocabulary + len(rules) + k for k, p in enumerate(p for p in rank if taken[p] >= least)}
        if not name:
            if whole:
                break
            new = None
            continue
        merged = {i: name[pair[i]] for i in wins if pair[i] in name}
        rules += list(name)
        seq = [merged.get(i, x) for i, x in enumerate(seq) if i - 1 not in merged]
        new = set(name.values())
    return seq, rules


@pytest.mark.parametrize("vocabulary", [30, 70_001])
def test_rounds_equal_plain_ones_and_look_at_fewer_places(monkeypatch, vocabulary):
    looked, real = [], grammar.ordered
    monkeypatch.setattr(grammar, "ordered", lambda left, right, symbols: looked.append(len(left)) or real(left, right, symbols))
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 30, rng.integers(2, 9)) for _ in range(200)]
    for ids in (
        np.concatenate([phrases[k] for k in np.minimum(rng.zipf(1.3, 3000), 200) - 1]),
        rng.integers(0, 30, 4000),
        np.repeat(rng.integers(0, 5, 400), rng.integers(1, 9, 400)),
        np.full(777, 7),
        np.array([3, 3]),
    ):
        for least in (2, 4):
            seq, rules, _ = grammar.compress(ids, vocabulary, least)
            want, pairs = plain_rounds(ids.tolist(), vocabulary, least)
            assert seq.tolist() == want and [tuple(x) for x in rules.tolist()] == pairs
    looked.clear()
    rare = np.append(np.tile([1, 2, 3], 2000), np.random.default_rng(4).integers(100, 60_000, 60_000))
    grammar.compress(rare, 60_000)
    assert sum(looked) < 1.5 * len(rare)  # pairs too rare for a rule are counted once and not in each round over all


def test_many_wide_symbols():
    """More bits than a pair and its place have in one number."""
    left, right = np.array([5, 1, 5, 1 << 30, 1]), np.array([7, 2, 7, 9, 3])
    for symbols in (1 << 31, (1 << 30) + 1, 1 << 20):
        keys, starts, low = grammar.ordered(left % symbols, right, symbols)
        at = (keys & low).tolist()
        assert sorted(at) == [0, 1, 2, 3, 4] and len(starts) == 4
        assert [(left[i] % symbols, right[i]) for i in at] == sorted(zip((left % symbols).tolist(), right.tolist(), strict=True))


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_without_gaps(width):
    for n in (0, 1, 7, 8, 9, 1000):
        values = np.random.default_rng(n).integers(0, 1 << width, n)
        raw = grammar.squeeze(values, width)
        assert len(raw) == -(-n * width // 8)
        assert "".join(f"{x:08b}" for x in raw)[: n * width] == "".join(f"{x:0{width}b}" for x in values.tolist())
        assert (grammar.unsqueeze(np.frombuffer(raw, np.uint8), n, width) == values).all()


def test_a_word_is_encoded_once_whatever_marks_it_has():
    t = grammar.Words(PATH)
    ids, n = t.block(*flat(pa.array(["alpha!! Alpha$$$ alpha, beta!! beta$$$", "Beta, gamma!! gamma$$$ (gamma)", None])))
    assert len(t.keys) == 3 + 5  # the words, and !! $$$ , ( )
    assert n.sum() == len(ids)


@pytest.mark.parametrize("letters", [
    "abt'S sv rel,.$_=~!̸́éÀß×÷ 9²½Kİ\xa0\x85 \x1c|&\n", "a's d't re ll ve m'", "aé́=≠,'1 ̸", "ab|, ", "A<|a|> endoftx", "".join(map(chr, range(256))).replace("<", ""),
])
def test_parts_of_words_equal_whole_texts(letters):
    t, rng = grammar.Words(PATH), random.Random(7)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, ""]
    for part in (texts[:1500], texts[1000:]):  # the second has units of the store, too
        ids, n = t.block(*flat(pa.array(part)))
        edge = np.append(0, np.cumsum(n))
        want = [e.ids for e in t.library.encode_batch([x or "" for x in part], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == want
