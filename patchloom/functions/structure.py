"""Reports as structure: sections, labelled fields in order, and what was changed against a template. All in-row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, canonical, normalize, record, strip

FIELDS = "array<struct<label:string,display:string,content:string>>"
LABEL = rf"^([A-Za-z][A-Za-z0-9 /\-&.,()']{{1,70}}):[{SPACE}]*(.*)$"


def split_sections(x: Column) -> Column:
    """struct(findings, impression): after the first line-start FINDINGS:, and after the first IMPRESSION: behind it. Without FINDINGS all is impression."""
    x = F.coalesce(x, F.lit(""))
    parts = F.split(x, rf"(?md)^[{SPACE}]*FINDINGS[{SPACE}]*:", 2)
    rest = F.split(F.get(parts, F.lit(1)), rf"(?md)^[{SPACE}]*IMPRESSION[{SPACE}]*:", 2)
    none = F.size(parts) < 2
    return record(findings=F.when(none, "").otherwise(F.get(rest, F.lit(0))), impression=F.when(none, x).otherwise(F.coalesce(F.get(rest, F.lit(1)), F.lit(""))))


def parse_fields(block: Column) -> Column:
    """struct(fields, unlabelled): fields in order of first sight; of a repeated label the last content and the first display count."""
    lines = F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "\n", -1), strip), lambda x: x != "")
    # each line is taken apart once, before the fold
    lines = F.transform(lines, lambda x: record(line=x, shown=strip(F.regexp_extract(x, LABEL, 1)), content=F.regexp_extract(x, LABEL, 2)))
    lines = F.transform(lines, lambda x: record(line=x["line"], shown=x["shown"], content=x["content"], label=canonical(x["shown"])))

    def step(s: Column, x: Column) -> Column:
        line, shown, label, content = x["line"], x["shown"], x["label"], x["content"]
        opens = (shown != "") & ~F.upper(shown).isin("FINDINGS", "IMPRESSION")
        known = F.exists(s["fields"], lambda f: f["label"] == label)
        entry = lambda l, d, c: record(label=l, display=d, content=c)
        renewed = F.transform(s["fields"], lambda f: F.when(f["label"] == label, entry(f["label"], f["display"], content)).otherwise(f))
        longer = F.transform(s["fields"], lambda f: F.when(f["label"] == s["open"], entry(f["label"], f["display"], strip(F.concat_ws(" ", f["content"], line)))).otherwise(f))
        fields = F.when(opens & known, renewed).when(opens, F.concat(s["fields"], F.array(entry(label, shown, content)))).when(s["open"].isNotNull(), longer).otherwise(s["fields"])
        free = F.when(~opens & s["open"].isNull(), strip(F.concat_ws(" ", s["unlabelled"], line))).otherwise(s["unlabelled"])
        return record(fields=fields, open=F.when(opens, label).otherwise(s["open"]), unlabelled=free)

    start = record(fields=F.array().cast(FIELDS), open=F.lit(None).cast("string"), unlabelled=F.lit(""))
    return F.aggregate(lines, start, step, lambda s: record(fields=F.transform(s["fields"], lambda f: record(label=f["label"], display=f["display"], content=strip(f["content"]))), unlabelled=s["unlabelled"]))


def fields_of(report: Column) -> Column:
    """The labelled fields of a report's findings."""
    return parse_fields(split_sections(report)["findings"])["fields"]


def content_of(fields: Column, label: Column) -> Column:
    """A field's content, null if there is no such field."""
    return F.get(F.filter(fields, lambda f: f["label"] == label), F.lit(0))["content"]


def changed(content: Column, template: Column) -> Column:
    """Differs from the template's content (null: empty) after normalisation; punctuation counts."""
    return strip(normalize(content)) != strip(normalize(F.coalesce(template, F.lit(""))))


def gold_patch(report: Column, template_fields: Column) -> Column:
    """struct(fields, impression): the fields that the template has too and that were changed, and the report's impression."""
    own = F.filter(fields_of(report), lambda f: F.exists(template_fields, lambda t: t["label"] == f["label"]) & changed(f["content"], content_of(template_fields, f["label"])))
    return record(fields=F.transform(own, lambda f: record(label=f["label"], content=f["content"])), impression=strip(split_sections(report)["impression"]))


def gold_json(patch: Column, most: int = 6) -> Column:
    """The patch as JSON with at most so many fields."""
    return F.to_json(record(fields=F.map_from_entries(F.slice(patch["fields"], 1, most)), impression=patch["impression"]), {"pretty": "true"})
