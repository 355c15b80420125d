"""Field-aligned scoring of submissions against references.

cases: case_id, reference, submission, template (texts). A case is scored within its row, means over distinct texts; only field_details has one
row for each field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import changed, content_of, fields_of, parse_fields, split_sections
from ..functions.text import record
from .distance import weighted_edit, weighted_edits
from .once import distinct, spread

SHARE_FINDINGS, SHARE_IMPRESSION = 0.65, 0.35


def field_details(cases: DataFrame, strict_spec: bool = False) -> DataFrame:
    """case_id, label, display, w, edit, missing, unexpected, ref, sub for each field of reference or submission.

    A missing field costs 1, or, with strict_spec, what its content costs against nothing. A field that only the submission has
    weighs 1 and costs 1, or 0 if it is blank.
    """
    parsed = cases.select("case_id", *(fields_of(F.col(c)).alias(c[0]) for c in ("reference", "submission", "template")))
    ref = F.transform("r", lambda f: record(label=f["label"], display=f["display"], ref=f["content"], sub=content_of(F.col("s"), f["label"]), tpl=content_of(F.col("t"), f["label"])))
    sub = F.transform(F.filter("s", lambda f: ~F.exists("r", lambda g: g["label"] == f["label"])), lambda f: record(label=f["label"], display=f["display"], ref=F.lit(None).cast("string"), sub=f["content"], tpl=content_of(F.col("t"), f["label"])))
    rows = parsed.select("case_id", F.explode(F.concat(ref, sub)).alias("f")).select("case_id", "f.*")
    missing, unexpected = F.col("sub").isNull(), F.col("ref").isNull()
    cost = weighted_edit(F.coalesce("ref", F.lit("")), F.coalesce("sub", F.lit("")))
    full = F.lit(1.0) if not strict_spec else cost
    return rows.select(
        "case_id", "label", "display", F.when(~unexpected & changed(F.coalesce("ref", F.lit("")), F.col("tpl")), 3.0).otherwise(1.0).alias("w"),
        F.when(missing, full).otherwise(cost).alias("edit"), missing.alias("missing"), unexpected.alias("unexpected"), F.substring("ref", 1, 90).alias("ref"), F.substring("sub", 1, 90).alias("sub"),
    )


def _scored(cases: DataFrame, *keep: str, strict_spec: bool = False) -> DataFrame:
    """The columns `keep`, f, i and unlabelled of each row of cases(reference, submission, template). All fields of a row and its impression are scored
    within the row, so that a text is taken apart once and nothing is shuffled."""
    section = lambda c: split_sections(F.col(c))
    own = cases.select(*keep, fields_of(F.col("reference")).alias("_r"), parse_fields(section("submission")["findings"]).alias("_s"), fields_of(F.col("template")).alias("_t"), record(ref=section("reference")["impression"], sub=section("submission")["impression"]).alias("_i"))
    r, s, t = F.col("_r"), F.col("_s.fields"), F.col("_t")
    both = F.transform(r, lambda f: record(label=f["label"], ref=f["content"], sub=content_of(s, f["label"]), tpl=content_of(t, f["label"])))
    more = F.transform(F.filter(s, lambda f: ~F.exists(r, lambda g: g["label"] == f["label"])), lambda f: record(label=f["label"], ref=F.lit(None).cast("string"), sub=f["content"], tpl=F.lit(None).cast("string")))
    own = own.select(*keep, F.concat(both, more).alias("_f"), "_i", F.col("_s.unlabelled").alias("unlabelled"))
    pairs = F.concat(F.transform("_f", lambda f: record(ref=F.coalesce(f["ref"], F.lit("")), sub=F.coalesce(f["sub"], F.lit("")))), F.array("_i"))
    own = own.withColumn("_p", pairs).withColumn("_e", weighted_edits(F.col("_p")))

    def cost(f: Column, e: Column) -> Column:
        w = F.when(f["ref"].isNotNull() & changed(f["ref"], f["tpl"]), 3.0).otherwise(1.0)
        return record(w=w, e=e if strict_spec else F.when(f["sub"].isNull(), 1.0).otherwise(e))

    costs = F.zip_with("_f", F.slice("_e", F.lit(1), F.size("_f")), cost)
    if strict_spec:
        costs = F.concat(costs, F.when(F.col("unlabelled") != "", F.array(record(w=F.lit(1.0), e=F.lit(1.0)))).otherwise(F.array().cast("array<struct<w:double,e:double>>")))
    total = lambda x: F.aggregate("_c", F.lit(0.0), lambda a, c: a + x(c))
    own = own.select(*keep, costs.alias("_c"), F.element_at("_e", -1).alias("i"), "unlabelled")
    f = F.when(F.size("_c") == 0, 0.0).otherwise(F.least(F.lit(1.0), total(lambda c: c["w"] * c["e"]) / total(lambda c: c["w"])))
    return own.select(*keep, f.alias("f"), "i", "unlabelled")


def score_cases(cases: DataFrame, strict_spec: bool = False) -> DataFrame:
    """case_id, f, i, res, unlabelled. A case without fields has f = 0. With strict_spec, unlabelled text costs as a field of weight 1."""
    own = _scored(cases, "case_id", strict_spec=strict_spec)
    return own.select("case_id", "f", "i", (SHARE_FINDINGS * F.col("f") + SHARE_IMPRESSION * F.col("i")).alias("res"), "unlabelled")


def score_means(rows: DataFrame, by: str) -> DataFrame:
    """by, f, i, n, res, as score_dataset gives them, of rows(by, reference, submission, template, n) that stand for n cases each. Equal rows are scored once."""
    rows = spread(rows.groupBy(by, "reference", "submission", "template").agg(F.sum("n").alias("n")))
    mean = lambda x: (F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x)
    out = _scored(rows, by, "n").groupBy(by).agg(mean("f"), mean("i"), F.sum("n").alias("n"))
    return out.withColumn("res", SHARE_FINDINGS * F.col("f") + SHARE_IMPRESSION * F.col("i"))


def score_dataset(scores: DataFrame, *by: str) -> DataFrame:
    """Mean f and i, and res of the means; of all cases, or for each value of `by`. No cases give nulls."""
    out = scores.groupBy(*by).agg(F.avg("f").alias("f"), F.avg("i").alias("i"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("res", SHARE_FINDINGS * F.col("f") + SHARE_IMPRESSION * F.col("i"))


def score_predictions(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores of predictions(case_id, report) for cases(case_id, report, template_content); a case without one is scored as an empty report."""
    sub = predictions.select("case_id", F.col("report").alias("submission"))
    return score_cases(cases.select("case_id", F.col("report").alias("reference"), F.col("template_content").alias("template")).join(sub, "case_id", "left"))


def baselines(cases: DataFrame) -> DataFrame:
    """name, f, i, n, res of three submissions: the reference, the template, and the template's findings with the raw dictation; best first."""
    findings = split_sections(F.col("template_content"))["findings"]
    third = F.concat(F.lit("FINDINGS:"), findings, F.lit("\nIMPRESSION:\n"), F.coalesce("dictation", F.lit("")))
    subs = F.array(*(record(name=F.lit(n), submission=c) for n, c in (("oracle", F.col("report")), ("template", F.col("template_content")), ("dictation", third))))
    rows = distinct(cases, "report", "template_content", "dictation").select("n", F.col("report").alias("reference"), F.col("template_content").alias("template"), F.explode(subs).alias("s"))
    return score_means(rows.select("s.name", "reference", "template", "s.submission", "n"), "name").orderBy("res", "name")
