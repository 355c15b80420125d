"""Text functions on columns. All are built-in expressions; NFKC, which Spark lacks, is applied once at ingest (`nfkc`).

Character classes are spelt out where Java and the published rules, which are Unicode-aware, differ: \\w, \\s and \\d.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as L

#: White space without the line feed, white space, word characters, digits.
BLANK = r"\t\x0B\f\r \x1C-\x1F\x85\xA0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2000))) + "-" + chr(0x200A)
SPACE = r"\n" + BLANK
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
MARKER = rf"[{BLANK}]*(?:{DIGIT}+[{BLANK}]*[.)]|[-*+•‣▪])[{BLANK}]+"
#: Stand for the sign of a protected number; private use, so no text step touches them.
PLUS, MINUS = chr(0xE000), chr(0xE001)


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfkc(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns in Unicode normal form KC; null becomes the empty text. Texts of ASCII only aren't sent to Python."""

    def one(x: Column) -> Column:
        odd = x.rlike(r"[^\x00-\x7F]")
        return F.when(odd, _nfkc(F.when(odd, x))).otherwise(F.coalesce(x, F.lit("")))

    return df.withColumns({c: one(F.col(c)) for c in names})


def record(**parts: Column) -> Column:
    """A struct with these names, which hold inside of generators too, where aliases of parts are lost."""
    return F.named_struct(*(x for k, v in parts.items() for x in (F.lit(k), v)))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize(x: Column) -> Column:
    """Lower case, short units, no list markers at line starts."""
    x = F.lower(F.coalesce(x, F.lit("")))
    for short, long in L.UNITS.items():
        x = F.regexp_replace(x, rf"(?<![{WORD}])(?:{'|'.join(long)})(?![{WORD}])", short)
    return F.regexp_replace(x, rf"(?<=^|\n)(?:{MARKER})+", "")


def tokenize(x: Column) -> Column:
    """Ordered tokens: signed numbers stay whole, hyphens between letters vanish, letters and digits part."""
    x = normalize(x)
    x = F.regexp_replace(x, rf"[^{WORD}{SPACE}+/\-]|(?<=[{WORD}])/|/(?=[{WORD}])", " ")
    x = F.regexp_replace(x, rf"\+[{SPACE}]*({DIGIT}+)", f" {PLUS}$1 ")
    x = F.regexp_replace(x, rf"-[{SPACE}]*({DIGIT}+)", f" {MINUS}$1 ")
    x = F.regexp_replace(x, r"(?<=[a-z])-(?=[a-z])", "")
    x = F.regexp_replace(x, r"[+\-]", " ")
    x = F.regexp_replace(x, rf"(?<=[a-z])(?={DIGIT})|(?<={DIGIT})(?=[a-z])", " ")
    return F.filter(F.split(F.translate(x, PLUS + MINUS, "+-"), f"[{SPACE}]+"), lambda t: t != "")


def norm_key(x: Column) -> Column:
    return F.array_join(tokenize(x), " ")


def canonical(label: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(label, F.lit(""))), "[^A-Z0-9]+", "")


def token_weight(t: Column) -> Column:
    return F.when(t.isin(L.CRITICAL_WORDS), L.W_CRITICAL).when(t.isin(L.FUNCTION_WORDS), L.W_FUNCTION).when(t.rlike(DIGIT), L.W_CRITICAL).otherwise(L.W_CONTENT)


def weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + token_weight(t))


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def content_tokens(x: Column) -> Column:
    return F.filter(tokenize(x), lambda t: ~t.isin(L.ROUTING_STOP))


def label_keys(label: Column) -> Column:
    """Distinct words of four letters or more that name anatomy."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit("([a-z]{4,})"), F.lit(1))), lambda w: ~w.isin(L.LABEL_STOP))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(a)))


def clip(x: Column, n: int = L.CLIP_TEMPLATE) -> Column:
    x = F.coalesce(x, F.lit(""))
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit(L.TRUNCATED))).otherwise(x)


def _lines(x: Column) -> Column:
    return F.split(F.coalesce(x, F.lit("")), "\n", -1)


def split_sentences(x: Column) -> Column:
    """Sentences line by line; a list marker stays with the first sentence of its line."""

    def of_line(line: Column) -> Column:
        line = strip(F.regexp_replace(line, f"[{SPACE}]+", " "))
        head = F.regexp_extract(line, f"^({MARKER})", 1)
        rest = F.substring(line, F.char_length(head) + 1, F.char_length(line))
        parts = F.filter(F.transform(F.split(rest, rf"(?<=[.;:])[{SPACE}]+(?=[A-Z0-9(\"'])", -1), strip), lambda p: p != "")
        return F.transform(parts, lambda p, i: F.when(i == 0, F.concat(head, p)).otherwise(p))

    return F.flatten(F.transform(_lines(x), of_line))


def dict_sentences(x: Column) -> Column:
    """Dictated sentences: a full stop ends one only before a capital or a digit; markers aren't held."""
    of_line = lambda line: F.filter(F.transform(F.split(strip(line), rf"(?<=[.!?])[{SPACE}]+(?=[\"'(]?[A-Z0-9])", -1), strip), lambda p: p != "")
    return F.flatten(F.transform(_lines(x), of_line))


def last_sentence(x: Column) -> Column:
    parts = split_sentences(x)
    return F.when(F.size(parts) > 0, F.try_element_at(parts, F.lit(-1))).otherwise(strip(F.coalesce(x, F.lit(""))))


HEADER = rf"(?i)^[{SPACE}]*(?:impression|conclusion|summary|assessment|impressions)[{SPACE}]*:?[{SPACE}]*$"


def has_impression_header(x: Column) -> Column:
    return F.exists(_lines(x), lambda line: line.rlike(HEADER))


def is_abnormal(sentence: Column) -> Column:
    """Some word of the abnormal list has no negation among the four tokens before it."""
    t, neg = tokenize(sentence), words(L.NEGATION)
    at = F.transform(t, lambda w, i: w.isin(L.ABNORMAL) & ~F.arrays_overlap(F.slice(t, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4))), neg))
    return F.exists(at, lambda b: b)
