"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words that lie in n-grams found twice or more in their text; the rules
compare the characters of those words, and of lines seen before, with all characters in words. Everything runs on flat
numpy arrays over blocks of whole rows: no Python object is made for a word, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._base import BYTE, U64, K1, K3, Spans, blocks, mix, repeated, table, words

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class Rules:
    """Limits; shares are of the characters in words. The n-gram shares are the published ones for web text."""

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_share: float = 0.20


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words from one of the starts."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    rows = len(offs) - 1
    starts, ends, row = words(data, offs)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    count = lambda at, w=None: np.bincount(at, w, rows).astype(np.int64)
    out = {"n_words": count(row), "word_chars": count(row, chars)}
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=marks[1:])
    out["n_symbols"] = marks[offs[1:]] - marks[offs[:-1]]
    hashed = Spans(BYTE[data])

    first = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
    first = first[first < len(data)]
    last = np.append(first[1:], len(data))
    if len(first):
        last = last - (data[last - 1] == 10)
    inside = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[inside], last[inside]
    line_row = np.searchsorted(offs, first, side="right") - 1
    keys = mix(hashed(first, last) + line_row.astype(U64) * K3)
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order[1:]] == keys[order[:-1]]]
    out["n_dup_lines"] = count(line_row[again])
    out["dup_line_chars"] = count(line_row[again], points[last[again]] - points[first[again]])

    each = Spans(hashed(starts, ends))
    live, total = np.arange(len(starts)), len(starts)
    for n in sorted({rules.window, *rules.ngram_share}):
        live = live[live + n <= total]
        live = live[row[live] == row[live + n - 1]]
        live = live[repeated(mix(each(live, live + n) + row[live].astype(U64) * K1))]
        inside = covered(live, n, total)
        out[f"dup_chars_{n}"] = count(row[inside], chars[inside])
        if n == rules.window:
            out["n_repeat_words"] = count(row[inside])
    return out


def judge(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of df(doc_id, text, ..): the measures and the verdict.

    A null or empty text has no word, so base_failed is true and kept false. Rows that repeat a doc_id are judged each for
    itself; a null doc_id stays null; other columns are ignored, whatever their names.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in sorted(rules.ngram_share))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in blocks(batches, "text"):
            m = measure(data, offs, rules)
            failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
            bad = m["dup_line_chars"] > rules.line_share * m["word_chars"]
            for n, share in rules.ngram_share.items():
                bad |= m[f"dup_chars_{n}"] > share * m["word_chars"]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(m[x]) for x in names), pa.array(failed), pa.array(~failed & ~bad)], names=["doc_id", *names, "base_failed", "kept"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{x} bigint" for x in names) + ", base_failed boolean, kept boolean")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _windows(n: int) -> str:
    """Words inside an n-word window that is found twice or more in its text."""
    words_ = " || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER o" for k in range(1, n)])
    return f"""
g{n} AS (SELECT r, p, {words_} AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
b{n} AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM g{n} WHERE g IS NOT NULL),
i{n} AS (SELECT w.r, w.p, w.w, max(coalesce(twice, false)) OVER (PARTITION BY w.r ORDER BY w.p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM w LEFT JOIN b{n} b ON b.r = w.r AND b.p = w.p),
c{n} AS (SELECT r, count(*) FILTER (inside) AS n_words, coalesce(sum(length(w)) FILTER (inside), 0) AS chars FROM i{n} GROUP BY r)"""


def _sql(rules: Rules) -> str:
    sizes = sorted({rules.window, *rules.ngram_share})
    shares = "".join(f" AND NOT dup_chars_{n} > {share}::DOUBLE * word_chars" for n, share in rules.ngram_share.items())
    columns = "".join(f", CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_chars_{n}" for n in sorted(rules.ngram_share))
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY p) > 1 AS again FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (SELECT r, count(*) FILTER (again) AS n, coalesce(sum(length(line)) FILTER (again), 0) AS chars FROM l GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY r),
{",".join(_windows(n) for n in sizes)},
m AS (
  SELECT doc_id, CAST(coalesce(wc.n, 0) AS BIGINT) AS n_words, CAST(coalesce(wc.chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lc.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c{rules.window}.n_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lc.chars, 0) AS BIGINT) AS dup_line_chars{columns}
  FROM d LEFT JOIN wc USING (r) LEFT JOIN lc USING (r) {" ".join(f"LEFT JOIN c{n} USING (r)" for n in sizes)}),
v AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT dup_line_chars > {rules.line_share}::DOUBLE * word_chars{shares} AS kept FROM v
"""


OP8_SQL = _sql(Rules())
