"""Weighted word edit distance: an Arrow function, and the same as a plain expression to check it."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.text import norm_key, token_weight, tokenize

_CRITICAL, _FUNCTION, _DIGIT = frozenset(L.CRITICAL_WORDS), frozenset(L.FUNCTION_WORDS), re.compile(r"\d")


@lru_cache(100_000)
def _weight(t: str) -> float:
    return L.W_CRITICAL if t in _CRITICAL else L.W_FUNCTION if t in _FUNCTION else L.W_CRITICAL if _DIGIT.search(t) else L.W_CONTENT


#: Cells of the tables that are worked on at once.
CELLS = 1 << 21


def edits(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The distance of each pair of token strings. Equal pairs are worked out once; pairs of like size together, a row of all their tables at a
    time, in which insertions are a running minimum."""
    place: dict[tuple[str, str], int] = {}
    of = np.array([place.setdefault(p, len(place)) for p in pairs], np.int64)
    split = [(a.split(), b.split()) for a, b in place]
    out, open_ = np.zeros(len(split)), []
    ids: dict[str, int] = {}
    for i, (a, b) in enumerate(split):
        if a != b:
            out[i] = 1.0
            if a and b:
                open_.append(i)
    for side in split:
        for t in (*side[0], *side[1]):
            ids.setdefault(t, len(ids))
    heavy = np.array([_weight(t) for t in ids] + [0.0])
    open_.sort(key=lambda i: (len(split[i][1]), len(split[i][0])))
    at = 0
    while at < len(open_):
        to, widest = at, 0
        while to < len(open_) and (to == at or (to - at + 1) * max(widest, *map(len, split[open_[to]])) <= CELLS):
            widest = max(widest, *map(len, split[open_[to]]))
            to += 1
        own, at = open_[at:to], to
        nx, ny = (np.array([len(split[i][k]) for i in own]) for k in (0, 1))
        x, y = np.full((len(own), nx.max()), len(ids)), np.full((len(own), ny.max()), len(ids))
        for r, i in enumerate(own):
            x[r, : nx[r]], y[r, : ny[r]] = ([ids[t] for t in side] for side in split[i])
        wx, wy = heavy[x], heavy[y]
        along = np.concatenate([np.zeros((len(own), 1)), np.cumsum(wy, axis=1)], axis=1)
        row = along
        for j in range(x.shape[1]):
            w = wx[:, j : j + 1]
            down = row + w
            np.minimum(down[:, 1:], row[:, :-1] + np.where(y == x[:, j : j + 1], 0.0, np.maximum(wy, w)), out=down[:, 1:])
            row = np.where((j < nx)[:, None], np.minimum.accumulate(down - along, axis=1) + along, row)
        top = np.maximum(wx.sum(axis=1), wy.sum(axis=1))
        out[own] = np.minimum(1.0, row[np.arange(len(own)), ny] / top)
    return out[of]


def edit(a: list[str], b: list[str]) -> float:
    return float(edits([(" ".join(a), " ".join(b))])[0])


@F.pandas_udf(T.DoubleType())
def _edit(ref: pd.Series, sub: pd.Series) -> pd.Series:
    return pd.Series(edits(list(zip(ref, sub, strict=True))), dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _edit_lists(ref: pd.Series, sub: pd.Series) -> pd.Series:
    ends = np.cumsum([len(x) for x in ref])
    flat = edits([p for x, y in zip(ref, sub, strict=True) for p in zip(x, y, strict=True)])
    return pd.Series([flat[to - len(x) : to] for x, to in zip(ref, ends, strict=True)], dtype=object)


def weighted_edits(pairs: Column) -> Column:
    """weighted_edit of each struct(ref, sub) of an array, as an array. Equal texts aren't taken apart."""
    side = lambda name: F.transform(pairs, lambda p: F.when(p["ref"] == p["sub"], "").otherwise(norm_key(p[name])))
    return _edit_lists(side("ref"), side("sub"))


def weighted_edit(ref: Column, sub: Column) -> Column:
    """0 for equal tokens, 1 at most; weights of deleted, inserted and the heavier of substituted tokens over the heavier side's."""
    return _edit(norm_key(ref), norm_key(sub))


def weighted_edit_expr(ref: Column, sub: Column) -> Column:
    """The same from higher-order functions only; slower, for cross-checks."""
    a, b = tokenize(ref), tokenize(sub)
    first = F.aggregate(b, F.array(F.lit(0.0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + token_weight(t))))

    def line(row: Column, t: Column) -> Column:
        w = token_weight(t)
        start = F.array(F.element_at(row, 1) + w)
        best = lambda s, i, u: F.least(F.element_at(row, i + 2) + w, F.element_at(s, -1) + token_weight(u), F.element_at(row, i + 1) + F.when(t == u, 0.0).otherwise(F.greatest(w, token_weight(u))))
        places = F.transform(b, lambda u, i: F.struct(i.alias("i"), u.alias("u")))
        return F.aggregate(places, start, lambda s, p: F.concat(s, F.array(best(s, p["i"], p["u"]))))

    total = lambda s: F.aggregate(s, F.lit(0.0), lambda x, t: x + token_weight(t))
    top = F.greatest(total(a), total(b))
    return F.when(top == 0, 0.0).otherwise(F.least(F.lit(1.0), F.element_at(F.aggregate(a, first, line), -1) / top))
