"""Golden vectors of the text, structure and distance functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchloom.functions import structure as S
from patchloom.functions import text as X
from patchloom.operators import distance as D

TOKENS = {
    "Mild Right Effusion.": "mild right effusion", "air-space": "airspace", "L5-S1": "l 5 s 1", "l5s1": "l 5 s 1", "8 millimeters": "8 mm", "2) No effusion.": "no effusion",
    "+3 mm": "+3 mm", "-2mm": "-2 mm", "c5-6": "c 5 -6", "c5-C6": "c 5 c 6", "range 3-4": "range 3 -4", "3 - 4 mm": "3 -4 mm", "1.5 cm": "1 5 cm", "8millimeters": "8 millimeters",
    "mm²": "mm 2", "and/or": "and or", "w / o": "w / o", "T9 7th rib": "t 9 7 th rib", "a-b-c": "abc", "1. - Mild spondylosis.": "mild spondylosis", "ﬁbrosis": "fibrosis", "réaux éé1": "réaux éé1", "": "", None: "",
}
EDITS = [
    ("small right effusion", "small right effusion", 0), ("a b c", "", 1), ("", "a b c", 1), ("", "", 0), ("right kidney", "left kidney", 2 / 3), ("right kidney", "right elbow", 1 / 3),
    ("no focal opacity", "focal opacity", 0.4), ("the focal opacity", "focal opacity", 0.04), ("small right effusion", "small left effusion", 0.4), ("small right effusion", "large left effusion", 0.8),
]


def one(spark, *columns, **texts):
    df = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
    return df.select(*columns).first()


def test_tokens(spark):
    df = X.nfkc(spark.createDataFrame(list(TOKENS.items()), "x string, y string"), "x")
    assert [(r.y, r.z) for r in df.select("y", X.norm_key(F.col("x")).alias("z")).collect() if r.y != r.z] == []


def test_normalising_twice_changes_nothing(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS], "x string").select(X.normalize(F.col("x")).alias("x"))
    assert all(r.x == r.y for r in df.select("x", X.normalize(F.col("x")).alias("y")).collect())


def test_weights(spark):
    words = {"no": 4.0, "right": 4.0, "mild": 4.0, "mm": 4.0, "12": 4.0, "opacity": 2.0, "the": 0.25}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.token_weight(F.col("w")).alias("v"), X.weight(F.array("w")).alias("s")).collect()
    assert {r.w: r.v for r in got} == words and all(r.v == r.s for r in got)


def test_edit(spark):
    df = spark.createDataFrame([(a, b, float(c)) for a, b, c in EDITS], "a string, b string, c double")
    for r in df.select("*", D.weighted_edit(F.col("a"), F.col("b")).alias("d"), D.weighted_edit_expr(F.col("a"), F.col("b")).alias("e")).collect():
        assert r.d == pytest.approx(r.c) and r.d == r.e


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("no the a right kidney 12 left mass".split()), max_size=9), st.lists(st.sampled_from("no the a right kidney 12 left mass".split()), max_size=9))
def test_edit_is_the_cheapest_script(a, b):
    w = D._weight
    cost = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [cost[i - 1, j] + w(a[i - 1])] if i else []
            ways += [cost[i, j - 1] + w(b[j - 1])] if j else []
            if i and j:
                ways.append(cost[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else max(w(a[i - 1]), w(b[j - 1]))))
            cost[i, j] = min(ways, default=0.0)
    top = max(sum(map(w, a)), sum(map(w, b)))
    assert D.edit(a, b) == pytest.approx(min(1.0, cost[len(a), len(b)] / top) if top else 0.0)
    assert D.edit(a, b) == pytest.approx(D.edit(b, a))


def test_sentences(spark):
    x = F.col("x")
    got = lambda text: one(spark, X.split_sentences(x).alias("a"), X.dict_sentences(x).alias("b"), X.last_sentence(x).alias("c"), x=text)
    assert got("1. Mild spondylosis.\n2. No fracture.").a == ["1. Mild spondylosis.", "2. No fracture."]
    assert got("no effusion.\n\nmild spondylosis. Osteophytes noted.").b == ["no effusion.", "mild spondylosis.", "Osteophytes noted."]
    assert got("mild. osteophytes stay").b == ["mild. osteophytes stay"]
    assert got("One: Two; three. (Four").a == ["One:", "Two; three.", "(Four"]
    assert got("  \n ").a == [] and got("  \n ").c == ""
    assert got("A.\n2. B.").c == "2. B."


def test_abnormal_and_header(spark):
    x = F.col("x")
    texts = {"There is a moderate pleural effusion.": (True, False), "No pleural effusion or pneumothorax.": (False, False), "impression:": (False, True), "assessment of venous compressibility": (False, False), "no a b c d fracture": (True, False), "x\n CONCLUSION \ny": (False, True)}
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.is_abnormal(x).alias("a"), X.has_impression_header(x).alias("h"))
    assert {r.x: (r.a, r.h) for r in df.collect()} == texts


def test_labels_and_clip(spark):
    x = F.col("x")
    r = one(spark, X.canonical(x).alias("c"), X.label_keys(x).alias("k"), X.clip(x, 5).alias("s"), x="Lungs/Airways and bones")
    assert (r.c, r.k, r.s) == ("LUNGSAIRWAYSANDBONES", ["lungs", "airways", "bones"], "Lungs\n...[truncated]")
    r = one(spark, X.overlap(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"))).alias("o"), x="")
    assert r.o == 0.5


def test_sections(spark):
    s = S.split_sections(F.col("x"))
    assert tuple(one(spark, s.alias("s"), x="head\n FINDINGS : a\nIMPRESSION: b\nIMPRESSION: c").s) == (" a\n", " b\nIMPRESSION: c")
    assert tuple(one(spark, s.alias("s"), x="findings: a\nIMPRESSION: b").s) == ("", "findings: a\nIMPRESSION: b")
    assert tuple(one(spark, s.alias("s"), x="FINDINGS: a").s) == (" a", "")
    assert tuple(one(spark, s.alias("s"), x=None).s) == ("", "")


def test_fields(spark):
    f = lambda text: one(spark, S.parse_fields(F.col("x")).alias("f"), x=text).f
    assert [tuple(x) for x in f("BONES: mild cortical\nirregularity").fields] == [("BONES", "BONES", "mild cortical irregularity")]
    r = f("free\nBones: a\nLUNGS:\n  clear  \nBONES: b\nmore\nFINDINGS: kept in bones")
    assert [tuple(x) for x in r.fields] == [("BONES", "Bones", "b more FINDINGS: kept in bones"), ("LUNGS", "LUNGS", "clear")] and r.unlabelled == "free"
    assert f("").fields == []
