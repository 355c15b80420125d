"""Every operator against its plain version on awkward documents, on empty tables, and against SQL where there is some."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import crf, grammar, longmatch, mixing, nearby, pieces, quality, queries, recipes, runindex, toolcalls, urls
from patchloom.llm._base import Scratch, flat
from patchloom.llm.components import components
from tests.conftest import rows, sql_rows
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")


def same(df, expected):
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, expected))


@pytest.fixture(scope="module")
def docs():
    return brute.documents()


@pytest.fixture(scope="module")
def df(spark):
    return brute.frame(spark).cache()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, duck, name):
    cols, expected = sql_rows(duck, queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == cols
    assert rows(got) == expected


def test_language(spark, sf, df, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in table.collect()}
    got = crf.op1_language(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and 0 < len(held) < len(got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    out = crf.identify(df).collect()
    assert len(out) == len(docs)
    by_id = {r.doc_id: r for r in out}
    for i, text, *_ in docs:
        if i is not None and not any(c.isalpha() for c in text or ""):
            assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert crf.accepted(df).columns == df.columns


def test_rare_languages_and_those_of_long_texts_train(spark):
    assert (crf.Training().documents, crf.Training().characters) == (1500, 8000)
    t = crf.Training(documents=40, characters=50)
    made = [(i, f"the cat number {i}", "en") for i in range(3000)] + [(i, "der hund", "de") for i in range(3000, 3020)] + [(i, "le chat " * 30, "fr") for i in range(3020, 3050)]
    texts, langs = crf.sample(spark.createDataFrame(made, "doc_id bigint, text string, lang string"), t)
    assert len(texts) == 40 and {langs.count(x) for x in ("en", "de", "fr")} == {13, 14} and max(map(len, texts)) == 50


def test_labels_of_rows_are_no_inputs(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts, langs = crf.sample(table, crf.Training())
    model = crf.fit(texts, langs)
    one = {r.doc_id: (r.lang_pred, r.score) for r in crf.identify(table, model=model).collect()}
    two = {r.doc_id: (r.lang_pred, r.score) for r in crf.identify(table.selectExpr("doc_id", "text", "'zz' AS lang"), model=model).collect()}
    assert one == two


def test_posteriors_are_exact():
    rng = np.random.default_rng(0)
    scores, moves, sizes = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 2])
    got, pairs = crf.posteriors(scores, sizes, moves, pairs=True)
    at, want, expected = 0, np.zeros((7, 3)), np.zeros((3, 3))
    for n in sizes:
        total = 0
        p, e = np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(scores[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for t, y in enumerate(path):
                p[t, y] += w
            for a, b in zip(path, path[1:], strict=False):
                e[a, b] += w
        want[at : at + n], expected, at = p / total, expected + e / total, at + n
    assert np.allclose(got, want) and np.allclose(pairs, expected)


@pytest.mark.parametrize("bits", [64, 5])
def test_exact(spark, df, docs, bits):
    same(recipes.deduplicate(df, Scratch(spark, "t"), bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.exact(docs))


def test_cuts_follow_the_content():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(60_000))
    data = np.frombuffer(b"zzz" * 700 + text, np.uint8)
    chunks = lambda d: {bytes(d[a:b]) for own in recipes.chunks(d, np.array([0, len(d)])) for a, b in zip(own, own[1:], strict=False)}
    a, b = chunks(np.frombuffer(text, np.uint8)), chunks(data)
    assert len(a & b) > 0.8 * len(a)
    assert max(map(len, a)) <= recipes.MOST


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, df, docs, k):
    same(nearby.near_duplicates(df, Scratch(spark, "t"), nearby.Near(shingle=k)).select("doc_id", "n_shingles", "component_id", "kept"), brute.near(docs, k))


def test_near_with_links_that_are_no_stars(spark):
    """Chains whose ends are far apart, and documents just on either side of the threshold."""
    rng = random.Random(9)
    docs, words = [], [f"w{i}" for i in range(3000)]
    for family in range(6):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            for _ in range(rng.randint(1, 9)):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), " ".join(text)))
    for size in (4, 5, 9, 10):
        docs += [(len(docs), " ".join(f"s{size}x{i}" for i in range(size))), (len(docs) + 1, " ".join(f"s{size}x{i}" for i in range(size + 1)))]
    got = nearby.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark, "t"), nearby.Near(shingle=2))
    same(got.select("doc_id", "n_shingles", "component_id", "kept"), brute.near(docs, 2))


def test_near_where_unlike_sets_share_their_64_bits(spark, df, docs, monkeypatch):
    plain = nearby.short
    monkeypatch.setattr(nearby, "short", lambda key, step: F.pmod(plain(key, 0), F.lit(3)) if step == 0 else plain(key, step))
    same(nearby.near_duplicates(df, Scratch(spark, "t"), nearby.Near(shingle=2)).select("doc_id", "n_shingles", "component_id", "kept"), brute.near(docs, 2))


def test_near_of_texts_that_repeat_under_one_id(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(5, " ".join(base))] * 40 + [(5, "quite another text under that id")] * 3 + [(9, " ".join([*base[:-1], "x"]))] * 4
    got = nearby.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), Scratch(spark, "t"), nearby.Near(shingle=2))
    assert {tuple(r) for r in got.select("doc_id", "component_id").collect()} == {(5, 5), (9, 5)} and got.count() == len(docs)


def test_splits_of_blocks_join_to_the_split_of_all():
    texts = ["One two, one", "", "12 !", "zwei TWO drei", "one", "über Über"]
    whole = crf.split(*flat(pa.array(texts)))
    parts = [texts[:2], texts[2:3], texts[3:]]
    got = crf.joined([crf.split(*flat(pa.array(p))) for p in parts], [len(p) for p in parts])
    for name in ("of", "row", "keys", "flat", "edge"):
        assert getattr(got, name).tolist() == getattr(whole, name).tolist()


def test_estimate_is_near_the_similarity():
    p, rng = nearby.Near(rows=8, bands=64), np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8, 0.95):
        common, n = rng.integers(0, 2**63, 4000, np.uint64), 4000
        k = int(2 * n * share / (1 + share))
        a, b = np.sort(common), np.sort(np.append(common[:k], rng.integers(0, 2**63, n - k, np.uint64)))
        _, bits = nearby.sign(np.concatenate([a, b]), np.array([0, n, 2 * n]), p)
        planes = (bits[0] ^ bits[1]).reshape(p.bits, p.words)
        equal = 1 - np.bitwise_count(np.bitwise_or.reduce(planes)).sum() / p.minima
        assert abs((equal - 0.25) / 0.75 - share) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "x").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_urls(spark):
    pages = [(1, "http://A.Example.ORG/es/x"), (1, "http://A.Example.ORG/es/x"), (2, None), (3, "example.org/es/"), (4, "x://example.org/en/12?q#f"), (5, "x://example.org"), (6, "x://notexample.org/es/"), (7, "a://b://com/de/"), (None, "https://de.com/de/"), (8, ""), (9, "x://" + "a." * 500 + "com/fr/" + "p" * 5000)]
    got = urls.judge(spark.createDataFrame(pages, "page_id bigint, url string").selectExpr("*", "'x' AS host", "'y' AS rule"))
    want = [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "example.org", "/en/12", "example.org/en/1", "block"), (5, "example.org", "", None, "allow"), (6, "notexample.org", "/es/", "org/", "allow"), (7, "b:", "//com/de/", None, "allow"),
        (None, "de.com", "/de/", "com/de/", "block"), (8, "", "", None, "allow"), (9, "a." * 500 + "com", "/fr/" + "p" * 5000, "com/fr/", "allow"),
    ]
    same(got, want)


def test_mixing(spark, df, docs):
    m = mixing.Mix(per_bucket=4)
    out = mixing.mix_sources(df, Scratch(spark, "t"), m, ["doc_id", "text", "kept"]).collect()
    count = lambda t: len(brute.WORD.findall(t or ""))
    total, have, taken = sum(count(r[1]) for r in docs), {}, {}
    number = lambda s: int(s[3:]) if s else None
    leaf = lambda lang, source: ("other" if source is None else ["web", "books", "forum", "code"][number(source) // 5], lang or "unknown", source or "unknown")
    for _, text, lang, source, _ in docs:
        have[leaf(lang, source)] = have.get(leaf(lang, source), 0) + count(text)
    for r in out:
        k = (r.domain, r.lang, r.source)
        taken[k] = taken.get(k, 0) + r.n_tokens
        assert r.row.doc_id == r.doc_id and r.row.kept == "x"
    longest = max(count(r[1]) for r in docs)
    assert all(v <= m.epochs * have[k] for k, v in taken.items())
    assert m.share * total - longest * len(have) <= sum(taken.values()) <= m.share * total


def test_budgets_go_to_siblings_first(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "fr", "c", 1000), ("books", "en", "d", 1000)]
    got = {r.source: r.given for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, have bigint"), mixing.Mix(budget=700, epochs=1)).collect()}
    # web gets 400 of 700, its en 400 * 5 / 7; a has only 10 of its half, and b takes the rest before fr or books do
    assert got == {"a": 10, "b": 275, "c": 114, "d": 300}
    short = {r.source: r.given for r in mixing.budgets(spark.createDataFrame(leaves[:1] + leaves[3:], "domain string, lang string, source string, have bigint"), mixing.Mix(budget=700, epochs=1)).collect()}
    assert short == {"a": 10, "d": 690}


def test_tool_calls(spark):
    calls = [(1, 0, "a", None, "reply", '{"turn":1,"text":"x","words":2}'), (1, 1, "b", "a", "reply", '{"text":"","turn":"q"}'), (1, 2, "c", "b", "other", "{}"), (1, 3, "d", "zz", "reply", "[1"), (2, 0, "e", "f", "configure", '{"text":"é\\n"}'), (2, 1, "f", "e", "configure", '{"text":1}'), (2, 2, "g", "f", "configure", '{"text":"ok"}'), (3, 0, None, None, "configure", '{"text":"ok"}'), (1, 0, "a", None, "reply", '{"turn":1,"text":"x","words":2}')]
    results = [(1, 9, "a", "late"), (1, 2, "a", "soon"), (1, 3, "lost", "alone"), (1, 3, None, "nobody")]
    got = toolcalls.link(spark.createDataFrame(calls, "conv_id bigint, turn bigint, call_id string, after string, name string, arguments string"), spark.createDataFrame(results, "conv_id bigint, turn bigint, call_id string, content string"), Scratch(spark, "t"))
    by = {r.call_id: r for r in got.collect()}
    assert got.count() == 10
    assert [by[x].level for x in "abcdefg"] == [0, 1, 2, 0, None, None, None]
    assert (by["a"].valid, by["a"].n_results) == (True, 2)
    assert by["a"].json == '{"arguments":{"text":"x","turn":1,"words":2},"call_id":"a","name":"reply","result":{"content":"soon"}}'
    assert by["b"].errors == "least text,kind of turn"
    assert by["d"].json == '{"arguments":"[1","call_id":"d","name":"reply"}'
    assert [by[x].errors for x in ("c", "d", "f", "lost")] == ["unknown tool", "not an object", "kind of text", "no call"]
    assert by[None].level is None and by[None].valid


def test_long_chains_take_few_rounds(spark):
    calls = spark.range(300).selectExpr("cast(id AS string) AS call_id", "cast(id - 1 AS string) AS after")
    assert {r.call_id: r.level for r in toolcalls.levels(calls, Scratch(spark, "t")).collect()} == {str(i): i for i in range(300)}


def test_calls_after_several(spark):
    """Longest paths in graphs with joints, cycles and calls behind them, against a plain recursion."""
    rng, after = random.Random(4), {}
    for k in range(120):
        after[f"c{k}"] = [f"c{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if k else []
    after |= {"x": ["y", "c3"], "y": ["x"], "z": ["x", "c5"], "w": ["nowhere", "c7"], "v": []}
    from functools import cache

    @cache
    def depth(c, seen=()):
        own = [p for p in after[c] if p in after]
        if c in seen:
            return None
        each = [depth(p, (*seen, c)) for p in own]
        return None if None in each else 1 + max(each, default=-1)

    calls = spark.createDataFrame([(c, a) for c, a in after.items()] + [("c9", after["c9"])], "call_id string, after array<string>")
    got = {r.call_id: r.level for r in toolcalls.levels(calls, Scratch(spark, "t")).collect()}
    assert got == {c: depth(c) for c in after} and got["z"] is None and got["w"] == got["c7"] + 1


def test_arguments(spark):
    tools = {"t": (toolcalls.Param("n", "integer"), toolcalls.Param("unit", "string", False, choices=("m", "km")), toolcalls.Param("where", "object", False, inside=(toolcalls.Param("city", "string"), toolcalls.Param("zip", "integer", False, least=1))))}
    cases = [('{"n":3.0}', ""), ('{"n":3.5}', "kind of n"), ('{"n":1,"n":2}', "repeated key"), ('{"n":1,"unit":"cm"}', "choice of unit"), ('{"n":1,"where":{"zip":0}}', "missing where.city,least where.zip"), ('{"n":1,"where":{"city":"x"},"more":1}', "unknown more"), ("7", "not an object"), (None, "not an object"), ('{"n":1e2}', "")]
    rows = [(1, k, str(k), None, "t", a, "clash") for k, (a, _) in enumerate(cases)]
    calls = spark.createDataFrame(rows, "conv_id bigint, turn bigint, call_id string, after string, name string, arguments string, errors string").selectExpr("*", "'x' AS level", "'y' AS json", "'z' AS _id")
    results = spark.createDataFrame([(1, 0, "2", "é\n\"", 1)], "conv_id bigint, turn bigint, call_id string, content string, name int")
    got = {r.call_id: r for r in toolcalls.link(calls, results, Scratch(spark, "t"), tools, closed=True).collect()}
    assert [got[str(k)].errors for k in range(len(cases))] == [e for _, e in cases]
    assert got["0"].json == '{"arguments":{"n":3},"call_id":"0","name":"t"}'
    assert got["2"].json == '{"arguments":"{\\"n\\":1,\\"n\\":2}","call_id":"2","name":"t","result":{"content":"é\\n\\""}}'


def test_long_contents_are_copied(spark):
    calls = spark.createDataFrame([(1, 0, "a", None, "configure", '{"text":"x"}')], "conv_id bigint, turn bigint, call_id string, after string, name string, arguments string")
    results = spark.range(1).selectExpr("1L AS conv_id", "1L AS turn", "'a' AS call_id", "repeat('0123456789', 4000000) AS content")
    row = toolcalls.link(calls, results, Scratch(spark, "t")).selectExpr("valid", "length(json) AS n").first()
    assert row.valid and row.n > 40_000_000


def test_long_units():
    """Texts of a megabyte without a space, and units on both sides of LONG, equal the library's."""
    m, rng = pieces.Model(P.path("piece_bpe_32k.model")), random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (2040, 2047, 2048, 2049, 5000, 300_000)]
    texts += ["a" * 30_000, "the" * 5000, "ab" * 4000 + " x " + "漢ゼ😀" * 1500, "".join(rng.choice("ab") for _ in range(9000)), "=" * 1_000_000]
    ids, offs = m.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == m.library.encode(texts, add_bos=True, add_eos=True)


def test_pieces(df, docs):
    path = P.path("piece_bpe_32k.model")
    library = pieces.model(path).library
    want = []
    for i, text, *_ in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids)))
    got = [(r.doc_id, bytes(r.ids), r.decoded) for r in pieces.encode_decode(df, path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pieces_on_random_texts():
    m, rng = pieces.Model(P.path("piece_bpe_32k.model")), random.Random(2)
    letters = "abthe ing  \n▁éß漢ゼ😀\x00\t.,<s>0Ａ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [" " * 70, "a" * 300, "the" * 100, "thethe" * 40]
    ids, offs = m.encode(texts)
    want = m.library.encode(texts, add_bos=True, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    assert m.decode(ids, offs) == m.library.decode(want)
    broken = [[1, m.byte[0xFF], m.byte[0xC3], 300, 2]]
    assert m.decode(np.array(broken[0]), np.array([0, 5])) == m.library.decode(broken)


def test_quality(df, docs):
    got = quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same(got, [(i, *brute.quality(text)) for i, text, *_ in docs])


def test_token_files(spark, df, docs):
    path = P.path("word_bpe_49k.json")
    library = grammar.tokenizer(path).library
    files = grammar.write_files(df, path, 2, Scratch(spark, "t"), shard_ids=900, block=2000)
    assert files.count() > 3
    got = [(r.doc_id, r.start, r.n_tokens, __import__("zlib").crc32(bytes(r.ids))) for r in grammar.read_files(files).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.token_files(docs, lambda t: library.encode(t, add_special_tokens=False).ids)))
    asked = [i for i, *_ in docs if i is not None][::3]
    some = [(r.doc_id, bytes(r.ids)) for r in grammar.read_some(files, asked).collect()]
    assert sorted(map(repr, some)) == sorted(repr((r.doc_id, bytes(r.ids))) for r in grammar.read_files(files).collect() if r.doc_id in set(asked))


def test_token_files_of_one_doc_id(spark):
    """Rows without doc_id are dealt out by their texts, in one order."""
    docs = [(None, f"{k % 40:02d} {'x y z ' * (k % 7)}") for k in range(400)] + [(5, None), (5, ""), (5, "b"), (5, "a")]
    path = P.path("word_bpe_49k.json")
    library = grammar.tokenizer(path).library
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = grammar.write_files(spark.createDataFrame(docs, "doc_id bigint, text string"), path, 2, Scratch(spark, "t"), shard_ids=90, block=200)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("part").distinct().count() > 3
    got = [(r.doc_id, r.start, r.n_tokens, __import__("zlib").crc32(bytes(r.ids))) for r in grammar.read_files(files).collect()]
    want, at = [], 0
    for i, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), __import__("zlib").crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_words_that_share_a_hash():
    t, plain = grammar.Words(P.path("word_bpe_49k.json"), bits=5), grammar.Words(P.path("word_bpe_49k.json"))
    for texts in (["one two"], ["three"], ["four five one", None, "é x"], ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3]):
        for a, b in zip(t.block(*flat(pa.array(texts))), plain.block(*flat(pa.array(texts))), strict=True):
            assert (a == b).all()


def test_files_are_smaller_than_their_ids(spark, sf):
    """Re-Pair goes on to pairs found four times; the files, with their tables, are well below 16 bits an id, and below what fewer rules give."""
    t = grammar.Words(P.path("word_bpe_49k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    ids, n = t.block(*flat(pa.array(texts)))
    size = lambda least: len(grammar.pack(list(range(len(n))), n, ids, t.size, least)) / (2 * len(ids))
    assert size(grammar.LEAST) < 0.75 and size(grammar.LEAST) < 0.9 * size(256)
    assert len(grammar.pack([1], np.array([1000]), np.full(1000, 7), 10)) < 200


@pytest.mark.parametrize("letters", ["abtheX ing  \n'sÉé́ß漢ゼ😀\x00\t.,<>0Ａİ\xa0\x1c×÷½", "abtheX ing  <|>"])
def test_words_equal_whole_texts(letters):
    t, rng = grammar.Words(P.path("word_bpe_49k.json")), random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["don't we'll. It's", "Word. word, a.b Ü. é. ×. ÷, É! x²; ß?", None, ""]
    ids, n = t.block(*flat(pa.array(texts)))
    edge = np.append(0, np.cumsum(n))
    want = [e.ids for e in t.library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == want


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 9, 5000), np.full(1001, 7), np.tile([1, 2, 3], 700), np.zeros(0, int), np.array([5]), rng.integers(0, 70_000, 3000)):
        f = grammar.File(grammar.pack([1, None], np.array([len(ids), 0]), ids, 70_001 if len(ids) == 3000 else 10, least=2))
        assert (f.all() == ids).all() and f.doc_ids == [1, None]
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (f.span(a, b) == ids[a:b]).all()
    seq, rules, long = grammar.compress(np.tile([1, 2], 500), 10, 2)
    assert len(seq) < 100 and len(rules) == len(long)


def test_long_matches(spark, df, docs):
    for p in (longmatch.Match(), longmatch.Match(block=2000, piece=8)):
        out = longmatch.remove_repeats(df, Scratch(spark, "t"), p).collect()
        got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in out]
        assert sorted(map(repr, got)) == sorted(map(repr, brute.long_matches(docs)))
        assert all(sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_bytes - len(r.kept) for r in out)


def test_matching_statistics():
    rng = random.Random(1)
    for turn in range(60):
        letters, length = (b"ab", b"abc\x00\xff")[turn % 2], (7, 9, 14, 20)[turn % 4]
        text = lambda n, letters=letters: bytes(rng.choice(letters) for _ in range(rng.randint(1, n)))
        held = [text(30) for _ in range(rng.randint(1, 8))]
        asked = [text(25) + rng.choice([b"", b"z"]) + text(9) for _ in range(5)] + held[:2]
        owner = np.array([rng.randint(0, 9) for _ in held])
        index = runindex.RunIndex(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), owner, length)
        edge = np.cumsum([0, *map(len, asked)])
        got, row = index.stream(np.frombuffer(b"".join(asked), np.uint8), edge)
        least = index.least_owner(row)
        for k, x in enumerate(asked):
            for i in range(len(x)):
                n = max(n for n in range(len(x) - i + 1) if n == 0 or any(x[i : i + n] in s for s in held))
                assert got[edge[k] + i] == n
                if n >= length:
                    assert least[edge[k] + i] == min(o for s, o in zip(held, owner, strict=True) if x[i : i + length] in s)


def test_empty_tables(spark):
    none = brute.frame(spark, [])
    assert crf.identify(none).count() == 0
    assert recipes.deduplicate(none, Scratch(spark, "t")).count() == 0
    assert nearby.near_duplicates(none, Scratch(spark, "t")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert mixing.mix_sources(none, Scratch(spark, "t")).count() == 0
    calls, results = toolcalls.of_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert toolcalls.link(calls, results, Scratch(spark, "t")).count() == 0
    assert pieces.encode_decode(none, P.path("piece_bpe_32k.model")).count() == 0
    assert quality.judge(none).count() == 0
    assert grammar.read_files(grammar.write_files(none, P.path("word_bpe_49k.json"), 2, Scratch(spark, "t"))).count() == 0
    assert longmatch.remove_repeats(none, Scratch(spark, "t")).count() == 0


def test_words_of_switching_texts(spark, sf):
    """The label changes where the language does, and words of a text without a switch keep the text's label."""
    table = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    model = crf.trained(table, crf.Training())
    # held-out texts of two languages, one behind the other
    held = table.where(crf.held_out(table["doc_id"])).where("length(text) > 300").orderBy("doc_id").collect()
    one, two = (next(r for r in held if r.lang == x) for x in ("en", "fr"))
    a, b = (" ".join(r.text.split()[:40]) for r in (one, two))
    df = spark.createDataFrame([(1, f"{a} {b}"), (2, None), (3, "12 + 3"), (4, a)], "doc_id bigint, text string")
    got = {r.doc_id: r.words for r in crf.label_words(df, model=model).collect()}
    assert got[2] == got[3] == []
    first, labels = len(got[4]), [w.label for w in got[1]]
    assert [w.word for w in got[1]][:first] == [w.word for w in got[4]] and all(0 < w.posterior <= 1 for w in got[1])
    assert labels[:first].count("en") >= 0.9 * first and labels[first:].count("fr") >= 0.9 * (len(labels) - first)
