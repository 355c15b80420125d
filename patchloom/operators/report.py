"""Splits, validation and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.structure import changed, content_of, fields_of, gold_patch, parse_fields, split_sections
from ..functions.text import SPACE, has_impression_header, last_sentence, normalize, overlap, record, strip, tokenize
from .distance import weighted_edits
from .once import distinct
from .patch import LEVELS, append_closer, guard, heuristic_impression, parsed, render
from .score import score_means


def dev_split(df: DataFrame, n_dev: int = 160, seed: int = 42, id_: str = "case_id") -> DataFrame:
    """df with `dev`: true for n_dev rows by a seeded hash of the id. The n_dev-th hash is found by a top-k, so rows aren't sorted in one task."""
    keyed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string")).cast("binary")))
    first = keyed.select("_h").orderBy("_h").limit(n_dev).agg(F.max("_h")).first()[0] if n_dev > 0 else None
    return keyed.withColumn("dev", F.lit(False) if first is None else F.col("_h") <= first).drop("_h")


def validate_submission(sub: DataFrame, test: DataFrame) -> DataFrame:
    """case_id, problem: everything wrong with sub(case_id, report) for test(case_id, template_content). No rows: valid. Nothing is raised."""
    missing = [c for c in ("case_id", "report") if c not in sub.columns]
    if missing:
        return test.sparkSession.createDataFrame([(None, f"no column {c}") for c in missing], "case_id string, problem string")
    row = lambda df, text: df.select("case_id", F.lit(text).alias("problem"))
    ids = sub.groupBy("case_id").count()
    out = row(ids.where("count > 1"), "duplicate id")
    both = ids.select("case_id", F.lit(True).alias("_s")).join(test.select("case_id", F.lit(True).alias("_t")).distinct(), "case_id", "full")
    out = out.union(row(both.where("_s IS NULL"), "missing id")).union(row(both.where("_t IS NULL"), "unknown id"))
    counts = sub.agg(F.count(F.lit(1)).alias("a")).join(test.agg(F.count(F.lit(1)).alias("b")), how="cross").where("a <> b")
    out = out.union(counts.select(F.lit(None).cast("string").alias("case_id"), F.concat_ws(" ", F.lit("rows"), "a", F.lit("expected"), "b").alias("problem")))
    text = F.coalesce("report", F.lit(""))
    at = lambda name: F.regexp_instr(text, F.lit(rf"(?m)^\s*{name}\s*:"), 0)
    own = sub.join(test.select("case_id", fields_of(F.col("template_content")).alias("_t")), "case_id", "left")
    parsed = parse_fields(split_sections(text)["findings"])
    new = F.filter(parsed["fields"], lambda f: ~F.exists("_t", lambda t: t["label"] == f["label"]))
    found = F.array(
        F.when(strip(text) == "", "empty report"),
        *(F.when((strip(text) != "") & (at(s) == 0), f"no {s}") for s in ("FINDINGS", "IMPRESSION")),
        F.when((at("FINDINGS") > 0) & (at("IMPRESSION") > 0) & (at("IMPRESSION") < at("FINDINGS")), "section order"),
        F.when(parsed["unlabelled"] != "", "unlabelled text"),
    )
    invented = F.when(F.col("_t").isNotNull(), F.transform(new, lambda f: F.concat(F.lit("invented label "), f["display"])))
    each = own.select("case_id", F.explode(F.concat(F.filter(found, lambda x: x.isNotNull()), F.coalesce(invented, F.array().cast("array<string>")))).alias("problem"))
    return out.union(each)


def field_loss(details: DataFrame) -> DataFrame:
    """display, loss, n_missing, n_cases, share of fields whose edit, rounded to three places, is over 0.02; the largest loss first."""
    rows = details.where(F.round("edit", 3) > 0.02)
    out = rows.groupBy("display").agg(F.sum(F.col("w") * F.round("edit", 3)).alias("loss"), F.count_if("missing").alias("n_missing"), F.countDistinct("case_id").alias("n_cases"))
    return out.withColumn("share", F.col("loss") / F.sum("loss").over(W.partitionBy())).orderBy(F.desc("loss"), "display")


def diagnosis(cases: DataFrame) -> DataFrame:
    """case_id, n_fields, n_changed, share_changed, overlap, same_impression of each case."""
    own = cases.select("case_id", "dictation", fields_of(F.col("report")).alias("r"), fields_of(F.col("template_content")).alias("t"), split_sections(F.col("report"))["impression"].alias("ri"), split_sections(F.col("template_content"))["impression"].alias("ti"))
    moved = F.filter("r", lambda f: changed(f["content"], content_of(F.col("t"), f["label"])))
    said = F.flatten(F.transform(moved, lambda f: tokenize(f["content"])))
    return own.select(
        "case_id", F.size("r").alias("n_fields"), F.size(moved).alias("n_changed"), (F.size(moved) / F.greatest(F.lit(1), F.size("r"))).alias("share_changed"),
        overlap(F.array_distinct(said), tokenize(F.col("dictation"))).alias("overlap"), (strip(normalize(F.col("ri"))) == strip(normalize(F.col("ti")))).alias("same_impression"),
    )


def length_bucket(n: Column) -> Column:
    """(0, 1], (1, 3], (3, 7], (7, 15], (15, 999]; null outside."""
    return F.when(n <= 0, None).when(n <= 1, "(0, 1]").when(n <= 3, "(1, 3]").when(n <= 7, "(3, 7]").when(n <= 15, "(7, 15]").when(n <= 999, "(15, 999]")


def bucket_share(rows: DataFrame, bucket: str, value: str) -> DataFrame:
    """n, mean and share of the total of a value by bucket."""
    out = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return out.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy()))


def group_means(rows: DataFrame, by: str, value: str, least: int = 3, most: int = 10) -> DataFrame:
    """Groups of at least so many rows, the largest means first, with their share of the total."""
    out = bucket_share(rows, by, value).where(F.col("n") >= least)
    return out.orderBy(F.desc("mean"), by).limit(most)


def worst(rows: DataFrame, value: str, k: int = 10, id_: str = "case_id") -> DataFrame:
    return rows.orderBy(F.desc(value), id_).limit(k)


def gap_closed(base: float, best: float, oracle: float) -> float:
    return 100 * (base - best) / max(1e-9, base - oracle)


def gold_ceiling(cases: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """level, f, i, n, res of reports rendered from gold patches under each guard level."""
    case = parsed(F.col("template_content"), F.col("dictation"))
    own = distinct(cases, "report", "template_content", "dictation")
    own = own.select("n", "report", "template_content", case.alias("c")).withColumn("p", gold_patch(F.col("report"), F.col("c.fields")))
    own = own.select("n", "report", "template_content", "c", *(guard(F.col("p"), F.col("c"), level).alias(f"g_{level}") for level in levels))
    subs = F.array(*(record(level=F.lit(level), text=render(F.col("c"), F.col(f"g_{level}"), closer=False)) for level in levels))
    rows = own.select("n", F.col("report").alias("reference"), F.col("template_content").alias("template"), F.explode(subs).alias("s"))
    return score_means(rows.select("s.level", "reference", "template", F.col("s.text").alias("submission"), "n"), "level")


def value_counts(a: DataFrame, b: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Counts of a column's values in two tables side by side, absent as 0, the most frequent of the first table."""
    one = lambda df, name: df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias(name))
    both = one(a, "n_a").join(one(b, "n_b"), "value", "full").na.fill(0, ["n_a", "n_b"])
    return both.orderBy(F.desc("n_a"), F.desc("n_b"), "value").limit(most)


def label_inventory(cases: DataFrame, most: int = 25) -> DataFrame:
    shown = cases.select(F.explode(F.transform(fields_of(F.col("template_content")), lambda f: f["display"])).alias("display"))
    return shown.groupBy("display").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "display").limit(most)


def label_sets(cases: DataFrame) -> DataFrame:
    """How many reports have the template's labels, add some, drop some."""
    names = lambda c: F.transform(fields_of(F.col(c)), lambda f: f["label"])
    own = cases.select(F.size(F.array_except(names("report"), names("template_content"))).alias("a"), F.size(F.array_except(names("template_content"), names("report"))).alias("d"))
    return own.agg(F.count_if((F.col("a") == 0) & (F.col("d") == 0)).alias("equal"), F.count_if(F.col("a") > 0).alias("adds"), F.count_if(F.col("d") > 0).alias("drops"))


def quantiles(rows: DataFrame, value: str) -> DataFrame:
    """n, p25 to p95 with linear interpolation, and the values at n / 2 and 0.9 n of the sorted list, which are order statistics."""
    low = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95)))).alias("p")
    stats = rows.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"), low, F.max(value).alias("most"))
    at = [F.get("p", F.lit(i)).alias(x) for i, x in enumerate(("p25", "p50", "p75", "p90", "p95"))]
    return stats.select("n", *at, "most")


def order_statistics(rows: DataFrame, value: str) -> DataFrame:
    """The elements at positions n // 2 and int(0.9 n) of the sorted values, from counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("_to", F.sum("k").over(W.orderBy("v"))).withColumn("_n", F.sum("k").over(W.partitionBy()))
    pick = lambda pos: F.min(F.when(F.col("_to") > pos, F.col("v")))
    return upto.agg(pick(F.floor(F.col("_n") / 2)).alias("middle"), pick(F.floor(F.col("_n") * 0.9)).alias("ninety"))


def strategies(cases: DataFrame, answer: Column) -> DataFrame:
    """case_id, strategy, i: the impression's edit for candidate impressions. answer is a column of cases, the impression of an answer's patch; null is blank."""
    return _tried(cases.withColumn("_answer", answer), "case_id")


def strategy_counts(cases: DataFrame, answer: Column) -> DataFrame:
    """strategy, i, n of strategies(): equal cases are worked out once and count as often as they occur."""
    return _tried(distinct(cases.withColumn("_answer", answer), "report", "template_content", "dictation", "_answer"), "n")


def _tried(cases: DataFrame, *keep: str) -> DataFrame:
    tpl, said, own = F.col("template_content"), F.coalesce("dictation", F.lit("")), strip(F.coalesce("_answer", F.lit("")))
    # what several options share is a column first, so that it is worked out once for a row
    rows = cases.select(
        *keep, said.alias("_said"), own.alias("_own"), split_sections(tpl)["impression"].alias("_closing"), split_sections(F.col("report"))["impression"].alias("_ref"),
        heuristic_impression(tpl, F.col("dictation")).alias("_rule"), has_impression_header(said).alias("_header"),
    )
    rows = rows.withColumns({"_closed": append_closer(F.col("_own"), F.col("_closing")), "_n": F.size(F.filter(F.split("_own", rf"[{SPACE}]+", -1), lambda w: w != ""))})
    said, own, closing, rule, header, closed, n = (F.col(c) for c in ("_said", "_own", "_closing", "_rule", "_header", "_closed", "_n"))
    options = {
        "answer": own, "answer, closer": closed, "answer, else heuristic": F.when(own != "", own).otherwise(rule), "heuristic": rule, "template": closing, "dictation": said, "dictation, closer": append_closer(said, closing), "empty": F.lit(""),
        "header: answer and last sentence, else answer, closer": F.when(header, F.concat_ws(" ", own, last_sentence(closing))).otherwise(closed),
        "header: heuristic, else heuristic, closer": F.when(header, rule).otherwise(append_closer(rule, closing)),
        **{f"answer, closer below {k} words": F.when(n < k, closed).otherwise(own) for k in (15, 25, 40)},
    }
    names = sorted(options)
    rows = rows.select(*keep, F.array(*(record(ref=F.col("_ref"), sub=options[k]) for k in names)).alias("_p"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("strategy"), F.col("_e").alias("i")))
    return rows.select(*keep, weighted_edits(F.col("_p")).alias("_e")).select(*keep, each.alias("s")).select(*keep, "s.strategy", "s.i")


def bake_off(tried: DataFrame) -> DataFrame:
    """strategy, mean, median of tried(strategy, i); with a column n, a row counts that often."""
    n = F.col("n") if "n" in tried.columns else F.lit(1)
    return tried.groupBy("strategy").agg((F.sum(F.col("i") * n) / F.sum(n)).alias("mean"), F.percentile("i", F.lit(0.5), n).alias("median")).orderBy("mean", "strategy")


def best_strategy(tried: DataFrame) -> DataFrame:
    """The cheapest strategy of each case, by name where equal."""
    return tried.groupBy("case_id").agg(F.min(F.struct("i", "strategy")).alias("m")).select("case_id", "m.strategy", "m.i")


def switched(rows: DataFrame, by: str, threshold: float, low: str, high: str) -> DataFrame:
    """Mean of the column `low` where `by` is at most the threshold and of `high` elsewhere."""
    return rows.agg(F.avg(F.when(F.col(by) <= threshold, F.col(low)).otherwise(F.col(high))).alias("mean"))


def vocabulary_source(cases: DataFrame) -> DataFrame:
    """source, n: changed fields whose tokens are nearer to the dictation, the template, or neither."""
    own = cases.select(F.col("dictation"), fields_of(F.col("report")).alias("r"), fields_of(F.col("template_content")).alias("t"))
    rows = own.select("dictation", "t", F.explode(F.filter("r", lambda f: changed(f["content"], content_of(F.col("t"), f["label"])))).alias("f"))
    own_t = tokenize(F.col("f.content"))
    rows = rows.select(overlap(own_t, tokenize(F.col("dictation"))).alias("a"), overlap(own_t, tokenize(F.coalesce(content_of(F.col("t"), F.col("f.label")), F.lit("")))).alias("b"))
    return rows.groupBy(F.when(F.col("a") > F.col("b"), "dictation").when(F.col("a") < F.col("b"), "template").otherwise("tie").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def mean_length(rows: DataFrame, text: str) -> DataFrame:
    return rows.agg(F.avg(F.char_length(text)).alias("mean_chars"))
