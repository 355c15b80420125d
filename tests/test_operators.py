"""Scoring, patches, retrieval, router, reports, cache, sources, the batch run and streaming."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from patchloom.functions import text as X
from patchloom.operators import cache as C
from patchloom.operators import patch as P
from patchloom.operators import report as R
from patchloom.operators import retrieve as Q
from patchloom.operators import router as N
from patchloom.operators import score as D
from patchloom.plans import run as B
from patchloom.plans.cases import cases
from patchloom.plans.queries import few_shot_prompt
from patchloom.sources import tables as T
from tests.conftest import rows

REF = "FINDINGS:\nLUNGS: Mild right basilar airspace opacity. No pulmonary edema.\nPLEURA: Small right pleural effusion. No pneumothorax.\nOSSEOUS STRUCTURES: No acute osseous abnormality identified on these views.\n\nIMPRESSION:\nMild right basilar airspace opacity and small right pleural effusion."
TPL = "FINDINGS:\nLUNGS: No focal airspace opacity or pulmonary edema.\nPLEURA: No pleural effusion or pneumothorax.\nOSSEOUS STRUCTURES: No acute osseous abnormality identified on these views.\n\nIMPRESSION:\nNo acute cardiopulmonary abnormality."
CASE = "FINDINGS:\nLUNGS: Clear lungs.\nPleura: No effusion.\nOTHER FINDINGS:\n\nIMPRESSION:\n1. Fracture.\n2. No acute abnormality."
ENTRY = "array<struct<label:string,content:string>>"


@pytest.fixture(scope="module")
def made(spark, sf):
    return cases(spark, sf).cache()


def scored(spark, sub, ref=REF, tpl=TPL, **more):
    return D.score_cases(spark.createDataFrame([("a", ref, sub, tpl)], "case_id string, reference string, submission string, template string"), **more).first()


def test_worked_case(spark):
    r = scored(spark, TPL)
    assert (round(r.f, 6), r.i, round(r.res, 6)) == (0.558442, 1.0, 0.712987)
    assert scored(spark, REF).res == 0
    details = {x.label: x for x in D.field_details(spark.createDataFrame([("a", REF, TPL, TPL)], "case_id string, reference string, submission string, template string")).collect()}
    assert [(details[k].w, round(details[k].edit, 6)) for k in ("LUNGS", "PLEURA", "OSSEOUSSTRUCTURES")] == [(3, 0.636364), (3, 0.666667), (1, 0)]


def test_missing_unexpected_and_unlabelled_fields(spark):
    ref, tpl = "FINDINGS:\nA: \nIMPRESSION: x", "FINDINGS:\nA: \nIMPRESSION: x"
    assert scored(spark, "FINDINGS:\nIMPRESSION: x", ref.replace("A:", "AB:"), tpl.replace("A:", "AB:")).f == 1.0
    assert scored(spark, "FINDINGS:\nIMPRESSION: x", ref.replace("A:", "AB:"), tpl.replace("A:", "AB:"), strict_spec=True).f == 0.0
    assert scored(spark, "FINDINGS:\nAB: one\nNEW: two\nIMPRESSION:", "FINDINGS:\nAB: one\nIMPRESSION:", "FINDINGS:\nAB: one\nIMPRESSION:").f == 0.5
    assert scored(spark, "FINDINGS:\nfree text\nAB: one\nIMPRESSION:", "FINDINGS:\nAB: one\nIMPRESSION:", "FINDINGS:\nAB: one\nIMPRESSION:").f == 0.0
    assert scored(spark, "FINDINGS:\nfree text\nAB: one\nIMPRESSION:", "FINDINGS:\nAB: one\nIMPRESSION:", "FINDINGS:\nAB: one\nIMPRESSION:", strict_spec=True).f == 0.5
    assert scored(spark, None, "x", "y").f == 0.0


def test_baselines_and_ceiling(made):
    res = {r.name: r.res for r in D.baselines(made).collect()}
    assert res["oracle"] == 0 < res["dictation"] < res["template"]
    ceiling = {r.level: r.res for r in R.gold_ceiling(made).collect()}
    assert ceiling["off"] == 0 <= ceiling["numbers"] <= ceiling["strict"]


def test_scores_of_null_and_repeated_ids_and_of_repeated_texts(spark):
    df = spark.createDataFrame([(i, REF, s, TPL) for i, s in ((None, TPL), ("a", TPL), ("a", REF))], "case_id string, reference string, submission string, template string")
    assert sorted((r.case_id or "", round(r.f, 6), r.i) for r in D.score_cases(df).collect()) == [("", 0.558442, 1.0), ("a", 0.0, 0.0), ("a", 0.558442, 1.0)]
    many = spark.createDataFrame([("x", REF, TPL, TPL, 3), ("x", REF, REF, TPL, 1), ("x", REF, TPL, TPL, 2), ("y", None, None, None, 1)], "name string, reference string, submission string, template string, n int")
    assert sorted((r.name, round(r.f, 6), round(r.i, 6), r.n) for r in D.score_means(many, "name").collect()) == [("x", 0.465368, 0.833333, 6), ("y", 0.0, 0.0, 1)]


def test_ceiling_of_cases_without_ids(made):
    """A case counts by its texts, whatever its id."""
    some = made.where("k < 40")
    assert rows(R.gold_ceiling(some.withColumn("case_id", F.lit(None).cast("string")))) == rows(R.gold_ceiling(some))


def test_json(spark):
    texts = {
        '```json\n{"fields":{"LUNGS":"A {b}","B":"c"},"impression":"x"}\n```': ([("LUNGS", "A {b}"), ("B", "c")], "x"),
        '{"fields":{}},"impression":"No acute abnormality."}': ([], "No acute abnormality."), "nothing": None,
        'first {"a":1} then {"fields":{"P":"q"}}': ([("P", "q")], ""), '{"fields":{"LUNGS":"say \\"hi\\"", "PLE': ([("LUNGS", 'say "hi"')], ""), '{"fields":{}}': ([], ""), None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", P.parse_json(F.col("x")).alias("p"))
    assert {r.x: r.p and ([tuple(f) for f in r.p.fields], r.p.impression) for r in df.collect()} == texts
    assert P.balanced('x {"a": "}"} {"b": {"c": 1}} {') == '{"b": {"c": 1}}'


def guarded(spark, fields, impression, dictation, level="numbers", template=CASE):
    df = spark.createDataFrame([(template, dictation, fields, impression)], f"t string, d string, f {ENTRY}, i string")
    df = df.select(P.parsed(F.col("t"), F.col("d")).alias("c"), F.struct(F.col("f").alias("fields"), F.col("i").alias("impression")).alias("p"))
    df = df.withColumn("g", P.guard(F.col("p"), F.col("c"), level))
    return df.select("g.*", P.render(F.col("c"), F.col("g")).alias("report"), P.aggressiveness(F.col("g")).alias("score")).first()


def test_guard(spark):
    said = "8 mm nodule."
    r = guarded(spark, [("lungs", "Nodule of 8 mm. Lesion of 7 mm."), ("pleur", "Mild effusion."), ("SPLEEN", "x")], "8 mm nodule.", said)
    assert [tuple(f) for f in r.fields] == [("LUNGS", "Nodule of 8 mm."), ("PLEURA", "Mild effusion.")]
    assert r.drops == ["unsupported:Lesion of 7 mm.", "label:SPLEEN"] and r.score == 2
    assert [tuple(f) for f in guarded(spark, [("LUNGS", "Lesion of 7 mm.")], "", said, "off").fields] == [("LUNGS", "Lesion of 7 mm.")]
    assert guarded(spark, [("Pleura", "Mild effusion.")], "", said, "strict").fields == []
    assert guarded(spark, [("Pleura", "No effusion.")], "", "", "strict").fields[0].content == "No effusion."
    assert guarded(spark, [("LUNGS", "One."), ("lungs", "Two.")], "", "").fields[0].content == "Two."
    assert guarded(spark, [], "Nodule of 9 mm.", said).drops == ["impression_fully_unsupported"]
    with pytest.raises(ValueError):
        P.unsupported(F.lit(""), F.array(), "loose")


def test_render(spark):
    r = guarded(spark, [("LUNGS", "New.")], "Two nodules.", "")
    assert r.report == "FINDINGS:\nLUNGS: New.\nPleura: No effusion.\nOTHER FINDINGS:\n\nIMPRESSION:\nTwo nodules. 2. No acute abnormality."
    assert guarded(spark, [], "", "").report.endswith("IMPRESSION:\n1. Fracture.\n2. No acute abnormality.")
    once = P.append_closer(F.lit("Two nodules."), F.lit("Fine. Nothing ACUTE."))
    r = spark.range(1).select(once.alias("a"), P.append_closer(once, F.lit("nothing acute.")).alias("b"), P.append_closer(F.lit(" "), F.lit("x")).alias("c")).first()
    assert tuple(r) == ("Two nodules. Nothing ACUTE.", "Two nodules. Nothing ACUTE.", "")


def test_heuristic_impression(spark):
    tpl = "FINDINGS:\nA: b\nIMPRESSION:\nAll normal. Nothing acute."
    said = {
        "": "All normal. Nothing acute.", "Small nodule": "Small nodule Nothing acute.", "Fracture here. No effusion.": "Fracture here. Nothing acute.", "No fracture. No effusion.": "All normal. Nothing acute.",
        "a\nImpression:\nfirst\n\nsecond": "first second", "a\nSummary": "Summary", " ".join(f"S{i}." for i in range(9)): "S5. S6. S7. S8.", " ".join(f"S{i}." for i in range(16)): "S10. S11. S12. S13. S14. S15.",
    }
    df = spark.createDataFrame([(k, v) for k, v in said.items()], "d string, w string").select("d", "w", P.heuristic_impression(F.lit(tpl), F.col("d")).alias("g"))
    assert [(r.d, r.w, r.g) for r in df.collect() if r.w != r.g] == []


def test_selection(spark):
    made = lambda n, imp: ([(f"L{i}", "x") for i in range(n)], imp, [])
    kind = f"array<struct<fields:{ENTRY},impression:string,drops:array<string>>>"
    lists = [[made(1, ""), made(3, "")], [made(1, "a"), made(1, "b")], [made(0, "a"), made(1, "")], []]
    got = [r.s for r in spark.createDataFrame([(x,) for x in lists], f"a {kind}").select(P.select_patch(F.col("a")).alias("s")).collect()]
    assert [(len(s.fields), s.impression) for s in got] == [(3, ""), (1, "a"), (0, "a"), (0, "")]


def test_patches_without_a_model(spark):
    t, d = F.lit(CASE), F.lit("Lungs show a nodule. Pleura is thick. Ok.")
    m, f = spark.range(1).select(P.mock_patch(t, d), P.fallback_patch(t, d)).first()
    assert [tuple(x) for x in m.fields] == [("LUNGS", "Lungs show a nodule."), ("Pleura", "Pleura is thick.")] and m.impression == "Lungs show a nodule.\nPleura is thick.\nOk."
    assert [tuple(x) for x in f.fields] == [("LUNGS", "Lungs show a nodule. Clear lungs."), ("PLEURA", "Pleura is thick. No effusion.")] and f.impression == "Lungs show a nodule.\nPleura is thick."


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue fox"), (3, "green tree"), (4, "tall"), (5, "red fox runs")], "id bigint, text string")
    asked = spark.createDataFrame([(10, "fox red"), (11, "zzz"), (12, "tree")], "id bigint, text string")
    got = {(r.qid, r["rank"]): r.id for r in Q.query(Q.index(docs), asked, 3).collect()}
    assert got == {(10, 1): 1, (10, 2): 5, (10, 3): 2, (11, 1): 1, (11, 2): 2, (11, 3): 3, (12, 1): 3, (12, 2): 1, (12, 3): 2}
    without = spark.createDataFrame([(10, 1), (12, 1), (12, 3)], "qid bigint, id bigint")
    got = {(r.qid, r["rank"]): r.id for r in Q.query(Q.index(docs), asked, 2, without).collect()}
    assert got == {(10, 1): 5, (10, 2): 2, (11, 1): 1, (11, 2): 2, (12, 1): 2, (12, 2): 4}


def test_prompt(spark, made):
    pool, own = made.where("k >= 20"), made.where("k < 3")
    asked = own.join(Q.shots(own, pool, 2), "case_id").select("case_id", Q.user_prompt(F.col("shots")).alias("p")).collect()
    assert len(asked) == 3
    for r in asked:
        assert r.p.count("<solved>") == r.p.count("<answer>") == 2 and r.p.count("<case>") == r.p.count("<allowed_labels>") == 1 and r.p.endswith("</case>")
    assert Q.shots(own, pool, 0).first().shots == []


def test_every_case_has_its_nearest_examples(spark, sf, made, monkeypatch):
    """Against brute force over all cases; blocks are so small that bags meet in many."""
    monkeypatch.setattr(Q, "BLOCK", 64)
    tokens = {r.case_id: Counter(r.t) for r in made.select("case_id", X.tokenize(Q.retrieval_text()).alias("t")).collect()}
    df = Counter(t for c in tokens.values() for t in c)
    raw = {i: {t: (1 + math.log(n)) * (math.log(len(tokens) / (1 + df[t])) + 1) for t, n in c.items()} for i, c in tokens.items()}
    unit = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in raw.items()}
    posted = defaultdict(list)
    for i, v in unit.items():
        for t, w in v.items():
            posted[t].append((i, w))
    expected = {}
    for i, v in unit.items():
        score = dict.fromkeys(unit, 0.0)
        for t, w in v.items():
            for j, x in posted[t]:
                score[j] += w * x
        expected[i] = sorted((j for j in score if j != i), key=lambda j: (-round(score[j], 9), j))[:3]
    case = {r.case_id: r for r in made.collect()}
    got = {r.case_id: r.shots for r in Q.shots(made, made, 3, same=True).collect()}
    assert got.keys() == case.keys()
    for i, s in got.items():
        assert [(x["rank"], x.template_content, x.dictation) for x in s] == [(n, case[j].template_content, case[j].dictation) for n, j in enumerate(expected[i], 1)]
    assert {r.case_id for r in few_shot_prompt(spark, sf).select("case_id").collect()} == case.keys()
    of, near = Q.nearest(made.select(F.col("case_id").alias("id"), Q.retrieval_text().alias("text")), made.select(F.col("case_id").alias("id"), Q.retrieval_text().alias("text")), 4)
    by_id = defaultdict(list)
    for r in of.join(near.withColumnRenamed("id", "other"), "bag").orderBy("rank").collect():
        by_id[r.id].append(r.other)
    assert {i: [j for j in x if j != i][:3] for i, x in by_id.items()} == expected


def test_equal_cases_share_a_list(made):
    some = made.where("k < 6")
    twice = some.unionByName(some.withColumn("case_id", F.concat("case_id", F.lit("b"))))
    of, lists = Q.shot_lists(twice, twice, 2)
    assert of.count() == 12 and lists.count() <= 6


def test_nearest_fills_up_as_query_does(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue fox"), (3, "green tree"), (4, ""), (5, "red fox runs")], "id bigint, text string")
    asked = spark.createDataFrame([(10, "fox red"), (11, "zzz"), (12, "tree"), (13, "")], "id bigint, text string")
    of, near = Q.nearest(docs, asked, 3)
    got = {(r.qid, r["rank"]): (r.id, round(r.score, 6)) for r in of.withColumnRenamed("id", "qid").join(near, "bag").collect()}
    assert got == {(r.qid, r["rank"]): (r.id, round(r.score, 6)) for r in Q.query(Q.index(docs), asked, 3).collect()}


TOY = [("disc bulge at l4", "DISCSDEGENERATIVECHANGES"), ("disc height loss", "DISCSDEGENERATIVECHANGES"), ("marrow signal normal", "VERTEBRAE"), ("vertebral height kept", "VERTEBRAE"), ("technique axial images", "__DROP__"), ("comparison none", "__DROP__")]


@pytest.fixture(scope="module")
def model(spark):
    return N.fit(spark.createDataFrame([(a, b, "Spine") for a, b in TOY], "sentence string, label string, body_part string"))


def routed(spark, model, sentence, fields, body_part="Spine"):
    row = [("a", 0, sentence, body_part, [(k, k, v) for k, v in fields.items()])]
    df = spark.createDataFrame(row, "case_id string, pos int, sentence string, body_part string, fields array<struct<label:string,display:string,content:string>>")
    return N.route(df, model).first()


def test_router_rules(spark, model):
    both = {"VERTEBRAE": "Heights kept.", "DISCSDEGENERATIVECHANGES": "No facet arthropathy of note here.", "OTHERFINDINGS": ""}
    r = routed(spark, model, "severe facet arthropathy", both)
    assert (r.label, r.source, r.margin) == ("DISCSDEGENERATIVECHANGES", "facet", float("inf"))
    assert routed(spark, model, "facet changes", {"VERTEBRAE": "x", "OTHERFINDINGS": ""}).label == "VERTEBRAE"
    r = routed(spark, model, "alpha beta gamma delta", {"VERTEBRAE": "alpha beta gamma delta epsilon", "X": "alpha"})
    assert (r.label, r.source) == ("VERTEBRAE", "subset")
    r = routed(spark, model, "disc bulge", both)
    assert (r.label, r.source) == ("DISCSDEGENERATIVECHANGES", "other-excluded") and r.alternatives[0] == r.label and "OTHERFINDINGS" not in r.alternatives
    assert routed(spark, model, "technique axial", both).label == "__DROP__"
    assert routed(spark, model, "disc bulge", {}).label == "__DROP__"
    r = routed(spark, model, "disc bulge", {"UNSEEN": "x"})
    assert r.label == "__DROP__" and r.margin == float("inf")


def test_router_training(spark, made):
    labels = N.training_set(made)
    assert {r.label for r in labels.select("label").distinct().collect()} == {"PLEURA", "DISCSDEGENERATIVECHANGES", "JOINTS", "__DROP__"}
    out = N.route(N.sentences(made), N.train(made))
    docs = N.route_documents(out)
    assert docs.where("label = 'OTHERFINDINGS' OR label = '__DROP__'").count() == 0
    assert N.route_documents(out, float("inf")).count() <= docs.count()
    assert N.copy_patches(made, out).count() == made.count()
    with pytest.raises(ValueError):
        N.fit(spark.createDataFrame([], "sentence string, label string, body_part string"))


def test_equal_cases_are_routed_once(made):
    some = made.where("k < 12")
    twice = some.unionByName(some.withColumn("case_id", F.concat("case_id", F.lit("b"))))
    m = N.train(twice)
    assert rows(m.weights) == rows(N.fit(N.training_set(twice)).weights)
    assert rows(N.route_cases(twice, m)) == rows(N.route(N.sentences(twice), m))
    one = some.withColumn("case_id", F.lit("x"))
    assert rows(N.route_cases(one, m), ["pos", "sentence", "label", "score"]) == rows(N.route_cases(some, m), ["pos", "sentence", "label", "score"])


def test_split(made):
    out = R.dev_split(made, 40)
    assert out.where("dev").count() == 40 and out.count() == made.count()
    assert R.dev_split(made, 0).where("dev").count() == 0 and R.dev_split(made, 10_000).where("NOT dev").count() == 0


def test_validation(spark, made):
    few = made.where("k < 3")
    assert R.validate_submission(few.select("case_id", "report"), few).count() == 0
    bad = spark.createDataFrame([("P1", "x"), ("P1", ""), ("zz", "IMPRESSION: a\nFINDINGS:\nq\nSPLEEN: x"), ("P2", "FINDINGS:\nSPLEEN: x\nIMPRESSION: y")], "case_id string, report string")
    got = {(r.case_id, r.problem) for r in R.validate_submission(bad, few).collect()}
    assert got == {("P1", "duplicate id"), ("P0", "missing id"), ("zz", "unknown id"), (None, "rows 4 expected 3"), ("P1", "empty report"), ("P1", "no FINDINGS"), ("P1", "no IMPRESSION"), ("zz", "section order"), ("zz", "unlabelled text"), ("P2", "invented label SPLEEN")}
    assert R.validate_submission(bad.drop("report"), few).first().problem == "no column report"


def test_strategies(spark):
    """Closers by length, header and what is missing: a candidate equal to the reference costs 0."""
    long = "A b c d e f g h i j k l m n o p q r s t."  # 20 words
    tpl = "FINDINGS:\nLungs: Clear.\n\nIMPRESSION:\nNormal study. Follow up."
    case = lambda i, said, own, ref: (i, "Chest", said, tpl, "FINDINGS:\nLungs: Clear.\n\nIMPRESSION:\n" + ref, own)
    df = spark.createDataFrame([case("long", "x", long, long), case("closed", "x", long, long + " Follow up."), case("header", "Impression\nEffusion.", "Effusion.", "Effusion. Follow up."), case("none", "", None, "Normal study. Follow up.")],
                               "case_id string, body_part string, dictation string, template_content string, report string, own string")
    free = {}
    for r in R.strategies(df, F.col("own")).collect():
        free.setdefault(r.case_id, set()).update([r.strategy] if r.i == 0 else [])
    below = [f"answer, closer below {k} words" for k in (15, 25, 40)]
    assert free["long"] == {"answer", "answer, else heuristic", below[0]}
    assert free["closed"] == {"answer, closer", "header: answer and last sentence, else answer, closer", *below[1:]}
    assert {"answer, closer", "header: answer and last sentence, else answer, closer"} <= free["header"] and "header: heuristic, else heuristic, closer" not in free["header"]
    assert {"template", "heuristic", "answer, else heuristic", "header: heuristic, else heuristic, closer"} <= free["none"] and "answer" not in free["none"]
    twice = df.unionByName(df.where("case_id <> 'long'"))
    assert rows(R.bake_off(R.strategy_counts(twice, F.col("own")))) == rows(R.bake_off(R.strategies(twice, F.col("own"))))


def test_small_reports(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 8), ("b", 5.0, 16), ("b", 5.0, 0)], "g string, v double, n int")
    assert {r.g: (r.n, r["mean"], r["share"]) for r in R.bucket_share(df, "g", "v").collect()} == {"a": (2, 2.0, 4 / 14), "b": (2, 5.0, 10 / 14)}
    assert [r.b for r in df.select(R.length_bucket(F.col("n")).alias("b")).collect()] == ["(1, 3]", "(7, 15]", "(15, 999]", None]
    assert R.order_statistics(df, "v").first() == (5.0, 5.0)
    assert R.switched(df.withColumns({"low": F.lit(1.0), "high": F.lit(3.0)}), "n", 2, "low", "high").first()["mean"] == 2.0
    assert R.gap_closed(0.6, 0.3, 0.0) == pytest.approx(50)
    tried = spark.createDataFrame([("x", "b", 0.5), ("x", "a", 0.5), ("y", "a", 0.2)], "case_id string, strategy string, i double")
    assert {(r.case_id, r.strategy) for r in R.best_strategy(tried).collect()} == {("x", "a"), ("y", "a")}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert T.read_cache(spark, path).count() == 0
    new = spark.createDataFrame([("a", "1"), ("b", ""), ("c", None)], "key string, raw string")
    T.write_cache(C.merge(T.read_cache(spark, path), new), path)
    again = C.merge(T.read_cache(spark, path), spark.createDataFrame([("a", "2"), ("d", "4")], "key string, raw string"))
    T.write_cache(spark.createDataFrame(again.collect(), again.schema), path)
    assert {tuple(r) for r in T.read_cache(spark, path).collect()} == {("a", "2"), ("d", "4")}
    asked = spark.createDataFrame([("a",), ("x",)], "key string")
    assert C.coverage(asked, T.read_cache(spark, path)).first() == (2, 1)
    import hashlib

    assert spark.range(1).select(C.key(F.lit("a"), F.lit(None), F.lit("b"))).first()[0] == hashlib.sha1(b"a\0\0b").hexdigest()


def test_csv(spark, tmp_path):
    texts = [("1", 'says "x", y\n\nnext'), ("2", "plain"), ("3", "a,b\\")]
    T.write_csv(spark.createDataFrame(texts, T.SUBMISSION), str(tmp_path / "out"))
    assert sorted((r.case_id, r.report) for r in T.read_csv(spark, str(tmp_path / "out"), T.SUBMISSION).collect()) == texts
    assert next((tmp_path / "out").glob("*.csv")).read_text().startswith('"case_id","report"')


def test_run(spark, made, tmp_path):
    split = R.dev_split(made, 20)
    own, pool = split.where("dev").drop("dev").cache(), split.where("NOT dev").drop("dev")
    s = T.Settings(n_samples=2, n_shots=1)
    out = B.run_dataset(own, pool, s)
    assert out.count() == 20 and R.validate_submission(out, own).count() == 0
    dead = B.remote(lambda prompt, system, temperature: 1 / 0, s, attempts=1, wait=0.0)
    assert {r.report.split("IMPRESSION")[0] for r in B.run_dataset(own, pool, s, dead).collect()} == {r.t for r in own.select(F.regexp_extract("template_content", "(?s)^(.*)IMPRESSION", 1).alias("t")).collect()}
    asked = B.requests(own, pool, s).cache()
    answered = B.mock(asked)
    assert B.cached(dead, answered)(asked).count() == answered.count()
    scores = B.sweep(own, pool, T.Settings(), n_shots=(0, 1000), levels=("off", "numbers"))
    assert [r.n_shots for r in scores.collect()] == [0, 0]
    T.write_result(T.summary(scores, s), str(tmp_path / "result"))
    assert len(spark.read.json(str(tmp_path / "result")).first().variants) == 2
    assert s.temperature(0) == 0.0 and s.temperature(4) == 0.7


def test_equal_cases_are_asked_once(made):
    own, asked = made.where("k < 5"), []
    twice = own.unionByName(own.withColumn("case_id", F.concat("case_id", F.lit("b"))))
    out = B.run_dataset(twice, twice, T.Settings(), lambda r: asked.append(r.count()) or B.fallback(r)).collect()
    got = {r.case_id: r.report for r in out}
    assert asked == [5] and len(out) == len(got) == 10 and all(got[i] == got[i + "b"] for i in got if not i.endswith("b"))


def test_streaming(spark, tmp_path):
    from patchloom.streaming.reports import rendered

    answers = spark.createDataFrame([("a", CASE, "8 mm nodule.", '{"fields":{"LUNGS":"Nodule of 8 mm."},"impression":""}'), ("b", CASE, "", "no")], "case_id string, template_content string, dictation string, raw string")
    answers.write.parquet(str(tmp_path / "in"))
    stream = rendered(spark.readStream.schema(answers.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("reports").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.case_id: r.report for r in spark.table("reports").collect()}
    assert "LUNGS: Nodule of 8 mm." in got["a"] and "LUNGS: Clear lungs." in got["b"]
