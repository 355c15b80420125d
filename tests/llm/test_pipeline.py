"""The pipeline's stages on awkward documents, each against a plain version, and the whole run."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C  # noqa: E402
from patchloom.llm._base import Scratch  # noqa: E402
from tests.llm import brute  # noqa: E402


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"] and C.ORACLE_SQL is None
    df = brute.frame(spark)
    scratch, kept = Scratch(spark, "t"), df
    for name, stage in C.STAGES[:-1]:
        before = [tuple(r)[:2] for r in kept.collect()]
        out = scratch.write(stage(spark, kept, "/nowhere"), name)
        assert out.columns == df.columns
        after = [tuple(r)[:2] for r in out.collect()]
        assert set(after) <= set(before)
        if name == "exact_dedup":
            assert sorted(map(repr, after)) == sorted(map(repr, one_each(before, [x[4] for x in brute.exact(before)], lambda r: -len(r[1] or ""))))
        if name == "near_dedup":
            groups = [c for _, _, c, _ in brute.near([(x, r[1]) for x, r in enumerate(before)], 5)]
            assert sorted(map(repr, after)) == sorted(map(repr, one_each(before, groups, lambda r: 0)))
        kept = out
    assert C.STAGES[-1][1](spark, kept, "/nowhere").count() == kept.count()


def one_each(rows, groups, first):
    """Of each group the row that stays: the least by first, then by doc_id."""
    best = {}
    for r, g in zip(rows, groups, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: (first(x), brute.key(x[0])))
    return list(best.values())


def test_rows_that_share_an_id(spark):
    """A null or repeated doc_id: copies go all the same, other texts stay."""
    long = " ".join(f"w{k}" for k in range(60))
    texts = [(None, "a b c d e f"), (None, "a b  c d e f"), (None, "g h i"), (7, "a b c d e f"), (7, "j k l m"), (7, "j k l m"), (8, "j k l m"), (8, None), (8, long), (None, long + " x"), (None, long + " y")]
    docs = brute.frame(spark, [(i, t, "en", "s", 1) for i, t in texts])
    for name in ("_row", "_r", "_best", "_metadata"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    once = Scratch(spark, "t").write(C.exact(spark, docs, "/nowhere"), "exact")
    assert once.columns == docs.columns
    left = [(r.doc_id, r.text) for r in once.collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, [texts[1], texts[2], texts[4], *texts[7:]]))
    twice = [(r.doc_id, r.text) for r in C.near(spark, once, "/nowhere").collect()]
    assert sorted(map(repr, twice)) == sorted(map(repr, [texts[1], texts[2], texts[4], texts[7], texts[8]]))


def test_empty(spark):
    kept = brute.frame(spark, [])
    for name, stage in C.STAGES:
        kept = Scratch(spark, "t").write(stage(spark, kept, "/nowhere"), name)
        assert kept.count() == 0


def test_run(spark, sf):
    out = C.run(spark, sf)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count() * 3
