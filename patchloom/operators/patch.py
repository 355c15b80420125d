"""Patches: reading them from model output, guarding, choosing and rendering them. A patch is struct(fields, impression), fields an
array of struct(label, content) in order. Everything is in the row; only the balanced-brace scan is an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.structure import content_of, fields_of, split_sections
from ..functions.text import HEADER, canonical, dict_sentences, is_abnormal, label_keys, last_sentence, record, split_sentences, strip, tokenize, words

FIELDS = "array<struct<label:string,content:string>>"
LEVELS = ("off", "numbers", "strict")


def entry(label: Column, content: Column) -> Column:
    return record(label=label, content=content)


def patch(fields: Column, impression: Column) -> Column:
    return record(fields=fields.cast(FIELDS), impression=impression)


# ---- reading


def balanced(text: str) -> str | None:
    """The last top-level {..} whose braces match, braces in strings aside."""
    best, depth, begin, quoted, skip = None, 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif quoted:
            pass
        elif c == "{":
            begin = i if depth == 0 else begin
            depth += 1
        elif c == "}":
            depth -= 1
            best = text[begin : i + 1] if depth == 0 else best
    return best


@F.pandas_udf(T.StringType())
def last_object(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else balanced(s))


def parse_json(x: Column) -> Column:
    """The patch in a model's answer, null if there is none: of the repaired text, the span from first to last brace and the last balanced
    object the first with an impression or a field; else what pairs of strings can be found; else the first object."""
    x = strip(F.regexp_replace(F.coalesce(x, F.lit("")), L.FENCE, ""))
    fixed = F.regexp_replace(x, L.BRACES, '},"$1"')
    objects = lambda *each: F.transform(
        F.filter(F.array(*each), lambda c: F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")),
        lambda c: record(v=F.from_json(c, "fields map<string,string>, impression string"), has=F.array_contains(F.json_object_keys(c), "impression")),
    )
    size = lambda m: F.coalesce(F.size(F.map_keys(m)), F.lit(0))
    best = lambda read: F.get(F.filter(read, lambda r: r["has"] | (size(r["v"]["fields"]) > 0)), F.lit(0))["v"]
    near = objects(F.when(fixed != x, fixed), F.regexp_extract(x, L.OBJECT, 1))
    # the scan for a balanced object is only for texts in which the others find none
    last = objects(last_object(F.when(best(near).isNull(), x)))
    good = F.coalesce(best(near), best(last))
    plain = lambda s: F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), s, F.lit('"}')), "v string")["v"], s)
    pairs = F.transform(F.arrays_zip(F.regexp_extract_all(x, F.lit(L.PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(x, F.lit(L.PAIR), F.lit(2)).alias("v")), lambda p: entry(p["k"], plain(p["v"])))
    keyed = F.contains(x, F.lit('"fields"')) | F.contains(x, F.lit('"impression"'))
    found = F.when(keyed, F.filter(pairs, lambda p: p["label"] != "impression"))
    imp = F.when(keyed, F.get(F.filter(pairs, lambda p: p["label"] == "impression"), F.lit(0))["content"])
    entries = lambda m: F.coalesce(F.transform(F.map_entries(m), lambda e: entry(e["key"], F.coalesce(e["value"], F.lit("")))), F.array().cast(FIELDS))
    first = F.get(F.concat(near, last), F.lit(0))["v"]
    salvaged = (F.size(found) > 0) | (F.coalesce(imp, F.lit("")) != "")
    return (
        F.when(good.isNotNull(), patch(entries(good["fields"]), F.coalesce(good["impression"], F.lit(""))))
        .when(salvaged, patch(found, F.coalesce(imp, F.lit(""))))
        .when(first.isNotNull(), patch(entries(first["fields"]), F.coalesce(first["impression"], F.lit(""))))
    )


# ---- patches without a model


def best_sentence(sentences: Column, hits) -> Column:  # noqa: ANN001
    """The first sentence with the most hits, null if none has any."""
    scored = F.transform(sentences, lambda s, i: record(n=hits(s), i=(-i), s=s))
    top = F.array_max(scored)
    return F.when(top["n"] >= 1, top["s"])


def mock_patch(template: Column, dictation: Column) -> Column:
    """For each label the dictated sentence with the most of its words; the impression is the first three sentences."""
    sents = split_sentences(dictation)
    of = lambda f: best_sentence(sents, lambda s: F.size(F.array_intersect(label_keys(f["display"]), F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("([a-z]{4,})"), F.lit(1))))))
    fields = F.filter(F.transform(fields_of(template), lambda f: entry(f["display"], of(f))), lambda e: e["content"].isNotNull())
    return patch(fields, F.array_join(F.slice(sents, 1, 3), "\n"))


def fallback_patch(template: Column, dictation: Column) -> Column:
    """For each field with anatomy words the best dictated sentence, before the template's text; the impression is the sentences of more than
    two tokens, at most 600 characters."""
    vocabulary = F.create_map(*(x for k, v in sorted(L.ANATOMY.items()) for x in (F.lit(k), words(v.split()) if v else F.array().cast("array<string>"))))
    # a field without anatomy words has no hits and no entry
    named = F.transform(fields_of(template), lambda f: record(label=f["label"], content=f["content"], words=vocabulary[f["label"]]))
    named = F.filter(named, lambda f: F.coalesce(F.size(f["words"]), F.lit(0)) > 0)

    def done(r: Column) -> Column:
        """From struct(fields, sents), which a one-element array holds so that sentences are taken apart once and not for each field."""
        best = F.transform(r["fields"], lambda f: record(label=f["label"], content=f["content"], best=best_sentence(r["sents"], lambda s: F.size(F.array_intersect(f["words"], s["t"])))["s"]))
        fields = F.transform(best, lambda f: entry(f["label"], strip(F.concat_ws(" ", f["best"], F.when(f["best"].isNotNull(), f["content"])))))
        said = F.transform(F.filter(r["sents"], lambda s: F.size(s["t"]) > 2), lambda s: s["s"])
        return patch(F.filter(fields, lambda e: e["content"] != ""), F.substring(F.array_join(said, "\n"), 1, 600))

    sents = F.transform(split_sentences(dictation), lambda s: record(s=s, t=tokenize(s)))
    return F.get(F.transform(F.array(record(fields=named, sents=sents)), done), F.lit(0))


# ---- guard


def unsupported(sentence: Column, allowed: Column, level: str = "numbers") -> Column:
    """Tokens of the sentence without support: new numbers, and with `strict` new sides and grades. Negation never counts."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if level == "off":
        return F.array().cast("array<string>")
    claims = lambda t: t.rlike(r"\p{Nd}") | t.isin(sorted({*L.LATERALITY, *L.SEVERITY})) if level == "strict" else t.rlike(r"\p{Nd}")
    return F.filter(tokenize(sentence), lambda t: ~F.array_contains(allowed, t) & claims(t))


def parsed(template: Column, dictation: Column) -> Column:
    """struct(fields, heard, impression): what guard and render use of a case. Put it in a column of its own first, so that it is
    worked out once for a row."""
    return record(fields=fields_of(template), heard=tokenize(dictation), impression=split_sections(template)["impression"])


def guard(p: Column, case: Column, level: str = "numbers") -> Column:
    """struct(fields, impression, drops): fields by template label, in its order, with only supported sentences. case is `parsed`.

    A label that isn't the template's goes to the shortest template label that contains it or is contained (the first of such), else it
    is dropped. Of two entries for one field the last with anything left counts.
    """
    fields, heard = case["fields"], case["heard"]

    def near(key: Column) -> Column:
        found = F.filter(F.transform(fields, lambda f, i: record(n=F.char_length(f["label"]), i=i, label=f["label"])), lambda f: (key != "") & (F.contains(f["label"], key) | F.contains(key, f["label"])))
        return F.array_min(found)["label"]

    each = F.transform(F.coalesce(p["fields"], F.array().cast(FIELDS)), lambda e: record(key=canonical(e["label"]), label=e["label"], content=e["content"]))
    each = F.transform(each, lambda e: record(key=F.when(F.exists(fields, lambda f: f["label"] == e["key"]), e["key"]).otherwise(near(e["key"])), label=e["label"], sents=split_sentences(e["content"])))
    each = F.transform(each, lambda e: record(key=e["key"], label=e["label"], sents=e["sents"], allowed=F.array_union(heard, tokenize(F.coalesce(content_of(fields, e["key"]), F.lit(""))))))
    each = F.transform(each, lambda e: record(key=e["key"], label=e["label"], sents=F.transform(e["sents"], lambda s: record(s=s, ok=F.size(unsupported(s, e["allowed"], level)) == 0))))
    each = F.transform(each, lambda e: record(key=e["key"], label=e["label"], keep=F.transform(F.filter(e["sents"], lambda s: s["ok"]), lambda s: s["s"]), bad=F.transform(F.filter(e["sents"], lambda s: ~s["ok"]), lambda s: s["s"])))
    allowed = F.array_union(heard, tokenize(case["impression"]))
    keep = F.filter(split_sentences(F.coalesce(p["impression"], F.lit(""))), lambda s: F.size(unsupported(s, allowed, level)) == 0)

    def done(r: Column) -> Column:
        """From struct(each, keep), which a one-element array holds so that both are worked out once."""
        last = lambda label: F.try_element_at(F.filter(r["each"], lambda e: (e["key"] == label) & (F.size(e["keep"]) > 0)), F.lit(-1))
        clean = F.filter(F.transform(fields, lambda f: entry(f["label"], F.array_join(last(f["label"])["keep"], " "))), lambda e: e["content"].isNotNull())
        drops = F.flatten(F.transform(r["each"], lambda e: F.when(e["key"].isNull(), F.array(F.concat(F.lit("label:"), e["label"]))).otherwise(F.transform(e["bad"], lambda s: F.concat(F.lit("unsupported:"), F.substring(s, 1, 40))))))
        lost = (strip(F.coalesce(p["impression"], F.lit(""))) != "") & (F.size(r["keep"]) == 0)
        drops = F.concat(drops, F.when(lost, F.array(F.lit("impression_fully_unsupported"))).otherwise(F.array().cast("array<string>")))
        return record(fields=clean.cast(FIELDS), impression=F.array_join(r["keep"], "\n"), drops=drops)

    return F.get(F.transform(F.array(record(each=each, keep=keep)), done), F.lit(0))


# ---- impression, rendering, choice


def append_closer(impression: Column, closing: Column) -> Column:
    """The impression with the last sentence of the template's impression behind it, unless one is empty or it is there already."""
    imp, tail = strip(F.coalesce(impression, F.lit(""))), last_sentence(closing)
    return F.when((imp == "") | (tail == "") | F.contains(F.lower(imp), F.lower(tail)), imp).otherwise(strip(F.concat_ws(" ", imp, tail)))


def heuristic_impression(template: Column, dictation: Column) -> Column:
    """An impression by rule: what stands behind the last header line; else by the number of dictated sentences."""
    tpl, said = strip(split_sections(template)["impression"]), F.coalesce(dictation, F.lit(""))
    lines = F.transform(F.split(said, "\n", -1), strip)
    at = F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HEADER), i)), lambda i: i.isNotNull()))
    rest = strip(F.array_join(F.filter(F.slice(lines, at + 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x != ""), " "))
    sents = dict_sentences(said)
    n, tail = F.size(sents), last_sentence(tpl)
    bad = F.filter(sents, is_abnormal)
    closed = lambda k: F.when(F.size(bad) > 0, strip(F.array_join(F.concat(F.slice(bad, 1, k), F.array(tail)), " "))).otherwise(tpl)
    end = lambda k: F.array_join(F.slice(sents, -k, k), " ")
    by_size = F.when(n == 0, tpl).when(n == 1, strip(F.concat_ws(" ", strip(said), tail))).when(n <= 3, closed(3)).when(n <= 7, closed(6)).when(n <= 15, end(4)).otherwise(end(6))
    return F.when(at.isNotNull(), F.when(rest != "", rest).otherwise(F.get(lines, at))).otherwise(by_size)


def render(case: Column, clean: Column, closer: bool = True) -> Column:
    """The report: template fields in order as displayed, patched or as they were; a blank impression is the template's. case is `parsed`."""
    lines = F.transform(case["fields"], lambda f: F.regexp_replace(F.concat(f["display"], F.lit(": "), strip(F.coalesce(content_of(clean["fields"], f["label"]), f["content"]))), r"\s+$", ""))
    own = strip(F.coalesce(clean["impression"], F.lit("")))
    imp = F.when(own != "", own).otherwise(strip(case["impression"]))
    if closer:
        imp = F.when(F.coalesce(clean["impression"], F.lit("")) != "", append_closer(imp, case["impression"])).otherwise(imp)
    return F.concat(F.lit("FINDINGS:\n"), F.array_join(lines, "\n"), F.lit("\n\nIMPRESSION:\n"), imp)


def aggressiveness(clean: Column, impression_weight: float = 2.0) -> Column:
    return F.size(F.coalesce(clean["fields"], F.array().cast(FIELDS))) - impression_weight * (strip(F.coalesce(clean["impression"], F.lit(""))) == "").cast("double")


def select_patch(cleans: Column) -> Column:
    """Of an array of guarded patches the most aggressive, the earliest of equals; of none the empty patch."""
    best = F.array_max(F.transform(cleans, lambda c, i: record(a=aggressiveness(c), i=(-i))))
    none = record(fields=F.array().cast(FIELDS), impression=F.lit(""), drops=F.array().cast("array<string>"))
    return F.coalesce(F.get(cleans, -best["i"]), none)
