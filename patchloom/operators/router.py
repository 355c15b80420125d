"""Routing of dictated sentences to template fields: weak labels, a naive Bayes model kept as rows, and rules that come first."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.structure import changed, content_of, fields_of
from ..functions.text import content_tokens, record, split_sentences, strip, tokenize, weight
from .once import digest, distinct, held
from .patch import entry

INFINITE = float("inf")


@dataclass(frozen=True)
class Router:
    alpha: float = 0.2
    idf_power: float = 1.0
    min_token_count: int = 1
    bigrams: bool = True
    use_body_part: bool = True
    subset_rule: bool = True
    subset_min_tokens: int = 4
    facet_rule: bool = True
    facet_prefers: tuple[str, ...] = (L.DISCS, L.VERTEBRAE)
    allow_other_findings: bool = False
    drop_threshold: float = 0.0


def sentences(cases: DataFrame) -> DataFrame:
    """case_id, pos, sentence, body_part, fields (of the template) of cases."""
    own = held(cases.select("case_id", "body_part", "template_content", "dictation"), fields=fields_of(F.col("template_content")), _s=split_sentences(F.col("dictation")))
    return own.select("case_id", "body_part", "fields", F.posexplode("_s").alias("pos", "sentence")).select("case_id", "pos", "sentence", "body_part", "fields")


def training_set(cases: DataFrame, min_overlap: float = 0.6, min_margin: float = 0.4, id_: str = "case_id") -> DataFrame:
    """case_id (or the column id_), pos, sentence, body_part, label: the changed reference field that holds most of a sentence's weight, or DROP where that is less
    than min_overlap or leads by less than min_margin. Ties go to the label that sorts last."""
    own = held(cases.select(id_, "body_part", "template_content", "report", "dictation"), t=fields_of(F.col("template_content")), r=fields_of(F.col("report")), _s=split_sentences(F.col("dictation")))
    moved = F.filter("r", lambda f: changed(f["content"], content_of(F.col("t"), f["label"])) & (f["label"] != L.OTHER_FINDINGS))
    own = held(own, moved=F.filter(F.transform(moved, lambda f: record(label=f["label"], t=content_tokens(f["content"]))), lambda f: F.size(f["t"]) > 0))
    own = held(own.select(id_, "body_part", "moved", F.posexplode("_s").alias("pos", "sentence")), tokens=content_tokens(F.col("sentence")))
    total = weight(F.col("tokens"))
    own = held(own, scored=F.sort_array(F.transform("moved", lambda f: record(s=(weight(F.array_intersect(F.array_distinct("tokens"), f["t"])) / F.when(total > 0, total).otherwise(1.0)), label=f["label"])), asc=False))
    scored = F.col("scored")
    best, second = F.get(scored, F.lit(0)), F.coalesce(F.get(scored, F.lit(1))["s"], F.lit(0.0))
    sure = (F.size("tokens") > 0) & (best["s"] >= min_overlap) & (best["s"] - second >= min_margin)
    return own.select(id_, "pos", "sentence", "body_part", F.when(sure, best["label"]).otherwise(L.DROP).alias("label"))


def features(tokens: Column, body_part: Column, r: Router) -> Column:
    """Of a column of tokens, which should be one of its own, as each use would work it out again."""
    out = tokens
    if r.bigrams:
        n = F.greatest(F.size(tokens) - 1, F.lit(0))
        out = F.concat(out, F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws("_", a, b)))
    if r.use_body_part:
        bp = F.lower(strip(F.coalesce(body_part, F.lit(""))))
        out = F.concat(out, F.when(F.coalesce(body_part, F.lit("")) != "", F.array(F.concat(F.lit("bp="), bp))).otherwise(F.array().cast("array<string>")))
    return out


@dataclass(frozen=True)
class Model:
    """weights(label, feature, ll) of what occurred, classes(label, default) with the value of a known feature that a class never had, and
    the known features."""

    weights: DataFrame
    classes: DataFrame
    vocabulary: DataFrame
    router: Router


def fit(labelled: DataFrame, r: Router = Router()) -> Model:
    """Of labelled(sentence, label, body_part); with a column n, a row counts that often. Priors are uniform; idf is of sentences over classes with the feature. Raises if nothing is
    left to learn from."""
    # both are as small as the model, and every part of it is made of them: kept, so that training texts are read twice and no more
    many = F.sum("n") if "n" in labelled.columns else F.count(F.lit(1))
    labels = labelled.groupBy("label").agg(many.alias("n")).persist()
    n = labels.agg(F.sum("n")).first()[0] or 0
    own = labelled.select(*(c for c in ("label", "body_part", "n") if c in labelled.columns), tokenize(F.col("sentence")).alias("_t"))
    counts = own.select("label", *(c for c in ("n",) if c in own.columns), F.explode(features(F.col("_t"), F.col("body_part"), r)).alias("feature")).groupBy("label", "feature").agg(many.alias("k")).persist()
    by_feature = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.sum("k").alias("total")).where(F.col("total") >= r.min_token_count)
    known = by_feature.select("feature", F.pow(F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1, F.lit(r.idf_power)).alias("idf"))
    v = known.count()
    if not v:
        raise ValueError("no features survived min_token_count")
    weighted = counts.join(known, "feature").withColumn("wc", F.col("k") * F.col("idf"))
    classes = labels.select("label").join(weighted.groupBy("label").agg(F.sum("wc").alias("sum")), "label", "left")
    base = F.log(F.coalesce("sum", F.lit(0.0)) + r.alpha * v)
    classes = classes.select("label", base.alias("_base"), (math.log(r.alpha) - base).alias("default"))
    weights = weighted.join(classes, "label").select("label", "feature", (F.log(F.col("wc") + r.alpha) - F.col("_base")).alias("ll"))
    return Model(weights, classes.select("label", "default"), known.select("feature"), r)


def train(cases: DataFrame, r: Router = Router(), min_overlap: float = 0.6, min_margin: float = 0.4) -> Model:
    """The model of all cases; equal ones are labelled once and count as often as they occur."""
    own = distinct(cases, "body_part", "template_content", "report", "dictation")
    labelled = training_set(own, min_overlap, min_margin, "n")
    return fit(labelled.groupBy("sentence", "label", "body_part").agg(F.sum("n").alias("n")), r)


def route_cases(cases: DataFrame, m: Model) -> DataFrame:
    """The columns of route() for the sentences of all cases; cases of equal texts are routed once, and each of them gets the rows."""
    content = ("body_part", "template_content", "dictation")
    own = distinct(cases, *content).withColumn("case_id", digest(*content))
    done = route(sentences(own), m).withColumnRenamed("case_id", "_id")
    return cases.select("case_id", digest(*content).alias("_id")).join(done, "_id").drop("_id")


def route(rows: DataFrame, m: Model) -> DataFrame:
    """case_id, pos, sentence, label, score, margin, source, alternatives of rows(case_id, pos, sentence, body_part, fields).

    Rules come first and have an infinite margin: the words lie in one field's text only; a facet sentence goes to its field. Only the
    rest is scored, against the labels of its own template and DROP.
    """
    r = m.router
    toks = F.array_distinct(content_tokens(F.col("sentence")))
    labels = F.transform("fields", lambda f: f["label"])
    own = held(rows, _labels=labels, _toks=toks)
    inside = F.filter("fields", lambda f: F.size(F.array_except(F.col("_toks"), content_tokens(f["content"]))) == 0)
    subset = F.when((F.size("_toks") >= r.subset_min_tokens) & (F.size(inside) == 1), F.get(inside, F.lit(0))["label"]) if r.subset_rule else F.lit(None).cast("string")
    facet = F.lit(None).cast("string")
    if r.facet_rule:
        facet = F.when(F.lower("sentence").rlike(L.FACET), F.coalesce(*(F.when(F.array_contains("_labels", c), F.lit(c)) for c in r.facet_prefers)))
    own = held(own, _subset=subset, _facet=facet)
    ruled = F.coalesce("_subset", "_facet")
    banned = F.lit(not r.allow_other_findings) & F.array_contains("_labels", L.OTHER_FINDINGS) & (F.size("_labels") > 1)
    by_rule = own.where(ruled.isNotNull() | (F.size("_labels") == 0)).select("case_id", "pos", "sentence", F.coalesce(ruled, F.lit(L.DROP)).alias("label"), F.lit(0.0).alias("score"), F.when(ruled.isNotNull(), INFINITE).otherwise(0.0).alias("margin"), F.when(F.col("_subset").isNotNull(), "subset").when(F.col("_facet").isNotNull(), "facet").otherwise("nb").alias("source"), F.col("_labels").alias("alternatives"))
    rest = own.where(ruled.isNull() & (F.size("_labels") > 0)).withColumn("source", F.when(banned, "other-excluded").otherwise("nb"))
    pool = F.concat(F.when(banned, F.array_remove("_labels", L.OTHER_FINDINGS)).otherwise(F.col("_labels")), F.array(F.lit(L.DROP)))
    # a sentence's features meet the weights once, and bring those of all labels; the labels are the classes, so a row's map is small
    cut = rest.select("case_id", "pos", "sentence", "source", "body_part", F.array_distinct(pool).alias("_c"), tokenize(F.col("sentence")).alias("_t"))
    feats = cut.select("case_id", "pos", "sentence", "source", "_c", F.explode_outer(features(F.col("_t"), F.col("body_part"), r)).alias("feature"))
    by_feature = m.weights.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("label", "ll"))).alias("_w"))
    each = feats.join(by_feature, "feature", "left")
    each = each.select("case_id", "pos", "sentence", "source", F.col("_w").isNotNull().alias("_known"), F.explode(F.transform("_c", lambda c: record(label=c, ll=F.col("_w")[c]))).alias("_x"))
    scores = each.groupBy("case_id", "pos", F.col("_x.label").alias("label")).agg(F.first("sentence").alias("sentence"), F.first("source").alias("source"), F.coalesce(F.sum("_x.ll"), F.lit(0.0)).alias("_s"), F.count_if(F.col("_known") & F.col("_x.ll").isNull()).alias("_k"))
    # a label that the model doesn't know has no score
    scores = scores.join(m.classes, "label", "left").withColumn("score", F.col("_s") + F.when(F.col("_k") > 0, F.col("_k") * F.col("default")).otherwise(F.when(F.col("default").isNotNull(), 0.0)))
    order = W.partitionBy("case_id", "pos").orderBy(F.round("score", 9).desc_nulls_last(), F.col("label").desc())
    ranked = scores.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order)).where("_n <= 3")
    lead, known = lambda x: F.max(F.when(F.col("_n") == 1, x)), F.col("score").isNotNull()
    best = ranked.groupBy("case_id", "pos").agg(
        F.first("sentence").alias("sentence"), lead(F.when(known, F.col("label"))).alias("label"), lead(F.col("score")).alias("score"), lead(F.when(known, F.coalesce(F.col("score") - F.col("_next"), F.lit(INFINITE)))).alias("margin"),
        F.first("source").alias("source"), F.transform(F.sort_array(F.collect_list(F.when(known, F.struct("_n", "label")))), lambda x: x["label"]).alias("alternatives"),
    )
    nb = best.select("case_id", "pos", "sentence", F.coalesce("label", F.lit(L.DROP)).alias("label"), F.coalesce("score", F.lit(-1e9)).alias("score"), F.coalesce("margin", F.lit(0.0)).alias("margin"), "source", "alternatives")
    return by_rule.unionByName(nb)


def route_documents(routed: DataFrame, threshold: float = 0.0) -> DataFrame:
    """case_id, label, sentences in order; without what is dropped or decided by less than the threshold."""
    kept = routed.where((F.col("label") != L.DROP) & (F.col("margin") >= threshold))
    return kept.groupBy("case_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("sentences"))


def copy_patches(cases: DataFrame, routed: DataFrame, threshold: float = 0.0) -> DataFrame:
    """case_id, patch: routed sentences before the template's text, the impression the last six sentences."""
    by_field = route_documents(routed, threshold).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.array_join("sentences", " ")))).alias("_said"))
    own = cases.select("case_id", fields_of(F.col("template_content")).alias("f"), split_sentences(F.col("dictation")).alias("s")).join(by_field, "case_id", "left")
    fields = F.filter(F.transform("f", lambda f: entry(f["label"], F.when(F.col("_said")[f["label"]].isNotNull(), strip(F.concat_ws(" ", F.col("_said")[f["label"]], f["content"]))))), lambda e: e["content"].isNotNull())
    last = F.array_join(F.slice("s", F.greatest(F.size("s") - 5, F.lit(1)), F.lit(6)), "\n")
    return own.select("case_id", record(fields=fields, impression=last).alias("patch"))
