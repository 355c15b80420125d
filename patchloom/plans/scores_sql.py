"""SQL of the scores: the weighted edit distance as a recursive query, a row of its table at a time, and what is made of it."""

from __future__ import annotations

from ..functions import lexicon as L
from .cases import CASES_SQL


def normal_sql(x: str) -> str:
    """A text after normalisation, without the white space at its ends."""
    x = f"lower(coalesce({x}, ''))"
    for short, long in L.UNITS.items():
        x = f"regexp_replace({x}, '\\b(?:{'|'.join(long)})\\b', '{short}', 'g')"
    x = f"regexp_replace({x}, '(?m)^(?:[ \\t]*(?:\\d+[ \\t]*[.)]|[-*+•‣▪])[ \\t]+)+', '', 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def edit_sql(pairs: str, tokens, weight) -> str:  # noqa: ANN001
    """CTEs of which the last is e(a, b, edit) for the distinct rows of pairs(a, b), texts that are never null."""
    return f"""
ep AS MATERIALIZED (SELECT row_number() OVER () AS id, a, b, {tokens("a")} AS x, {tokens("b")} AS y FROM (SELECT DISTINCT a, b FROM {pairs})),
ew AS MATERIALIZED (SELECT *, list_transform(x, lambda t: {weight("t")}) AS wx, list_transform(y, lambda t: {weight("t")}) AS wy FROM ep),
ez AS MATERIALIZED (SELECT *, list_transform(range(0, len(y) + 1), lambda j: coalesce(list_sum(wy[1:j]), 0.0)) AS along FROM ew),
er AS (
  SELECT id, CAST(0 AS BIGINT) AS i, along AS line FROM ez
  UNION ALL
  SELECT id, i + 1, list_transform(range(1, len(d) + 1), lambda j: list_min(d[1:j]) + along[j]) FROM (
    SELECT er.id, er.i, ez.along,
           list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN line[1] + wx[i + 1] ELSE least(line[j + 1] + wx[i + 1], line[j] + CASE WHEN y[j] = x[i + 1] THEN 0.0 ELSE greatest(wy[j], wx[i + 1]) END) END - along[j + 1]) AS d
    FROM er JOIN ez ON er.id = ez.id WHERE er.i < len(ez.x))),
e AS MATERIALIZED (
  SELECT a, b, CASE WHEN greatest(coalesce(list_sum(wx), 0.0), coalesce(list_sum(wy), 0.0)) = 0 THEN 0.0 ELSE least(1.0, line[-1] / greatest(coalesce(list_sum(wx), 0.0), coalesce(list_sum(wy), 0.0))) END AS edit
  FROM ez JOIN er ON er.id = ez.id AND er.i = len(ez.x))"""


def scored_sql(tokens, weight) -> str:  # noqa: ANN001
    """CTEs from s(case_id, reference, submission, template) to sd, a row for each field, and sc(case_id, f, i, res)."""
    return rf"""
sx AS MATERIALIZED (SELECT case_id, col, regexp_extract(txt, '(?s)FINDINGS:(.*?)\nIMPRESSION:', 1) AS block, regexp_extract(txt, '(?s)\nIMPRESSION:(.*)$', 1) AS imp FROM (SELECT case_id, unnest(['r', 's', 't']) AS col, unnest([reference, submission, template]) AS txt FROM s)),
sf AS MATERIALIZED (
  SELECT case_id, col, trim(regexp_extract(line, '^([^:]+):', 1)) AS display, regexp_replace(upper(regexp_extract(line, '^([^:]+):', 1)), '[^A-Z0-9]+', '', 'g') AS label, trim(regexp_extract(line, '^[^:]+:(.*)$', 1)) AS content
  FROM (SELECT case_id, col, unnest(string_split(block, chr(10))) AS line FROM sx) WHERE trim(line) <> ''),
sj AS MATERIALIZED (
  SELECT j.*, t.content AS tpl FROM (
    SELECT coalesce(r.case_id, u.case_id) AS case_id, coalesce(r.label, u.label) AS label, coalesce(r.display, u.display) AS display, r.content AS ref, u.content AS sub
    FROM (SELECT * FROM sf WHERE col = 'r') r FULL JOIN (SELECT * FROM sf WHERE col = 's') u ON r.case_id = u.case_id AND r.label = u.label) j
  LEFT JOIN (SELECT * FROM sf WHERE col = 't') t ON t.case_id = j.case_id AND t.label = j.label),
si AS MATERIALIZED (SELECT r.case_id, r.imp AS ri, u.imp AS ui FROM (SELECT * FROM sx WHERE col = 'r') r JOIN (SELECT * FROM sx WHERE col = 's') u USING (case_id)),
sp AS (SELECT coalesce(ref, '') AS a, coalesce(sub, '') AS b FROM sj UNION ALL SELECT ri, ui FROM si),
{edit_sql("sp", tokens, weight)},
sd AS (
  SELECT case_id, label, display, sub IS NULL AS missing, CASE WHEN ref IS NOT NULL AND {normal_sql("ref")} <> {normal_sql("tpl")} THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CASE WHEN sub IS NULL THEN 1.0::DOUBLE ELSE edit END AS edit
  FROM sj JOIN e ON e.a = coalesce(ref, '') AND e.b = coalesce(sub, '')),
sc AS (
  SELECT case_id, coalesce(f, 0.0) AS f, i, 0.65::DOUBLE * coalesce(f, 0.0) + 0.35::DOUBLE * i AS res
  FROM (SELECT case_id, edit AS i FROM si JOIN e ON e.a = ri AND e.b = ui) LEFT JOIN (SELECT case_id, least(1.0, sum(w * edit) / sum(w)) AS f FROM sd GROUP BY case_id) USING (case_id))"""


MEANS = "round(avg(f), 9) AS f, round(avg(i), 9) AS i, count(*) AS n, round(0.65::DOUBLE * avg(f) + 0.35::DOUBLE * avg(i), 9) AS res"
CLOSING = r"regexp_extract(template_content, '(?s)IMPRESSION:\n(.*)$', 1)"
OWNER = "CASE body_part WHEN 'Chest' THEN 'PLEURA: ' WHEN 'Spine' THEN 'DISCS/DEGENERATIVE CHANGES: ' ELSE 'JOINTS: ' END"
NORMAL = "CASE body_part WHEN 'Chest' THEN 'No pleural effusion or pneumothorax.' WHEN 'Spine' THEN 'No significant facet arthropathy.' ELSE 'No joint effusion.' END"


def oracles(tokens, weight, number: str, strict: str, sentences, guard: str) -> dict[str, str]:  # noqa: ANN001
    """SQL by query. tokens and weight make the SQL of a text's tokens and of a token's weight; number and strict say of a word w that it is a
    claim; sentences makes the SQL of a text's sentences as a list; guard is the SQL of the guarded candidates."""
    scored = scored_sql(tokens, weight)
    plain = f"WITH RECURSIVE c AS ({CASES_SQL}), s AS (SELECT case_id, report AS reference, template_content AS submission, template_content AS template FROM c), {scored}"
    named = f"""WITH RECURSIVE c AS ({CASES_SQL}),
s AS (
  SELECT name || '|' || case_id AS case_id, report AS reference, submission, template_content AS template FROM (
    SELECT *, unnest(['oracle', 'template', 'dictation']) AS name, unnest([report, template_content, regexp_extract(template_content, '(?s)^(.*)IMPRESSION:', 1) || 'IMPRESSION:' || chr(10) || dictation]) AS submission FROM c)),
{scored} SELECT split_part(case_id, '|', 1) AS name, {MEANS} FROM sc GROUP BY 1"""
    # a gold patch has the one field that was changed, and the impression; what the guard lets pass takes the place of the template's
    holds = lambda claim, own: f"len(list_filter(said, lambda w: NOT list_contains(heard, w) AND NOT list_contains({own}, w) AND ({claim}))) = 0"
    level = lambda name, claim: f"SELECT '{name}' AS level, *, {holds(claim, 'normal')} AS ok, {holds(claim, 'closed')} AS iok FROM g"
    gold = rf"""WITH RECURSIVE c AS ({CASES_SQL}),
g AS MATERIALIZED (
  SELECT *, {tokens("dictation")} AS heard, {tokens("own")} AS said, {tokens(NORMAL)} AS normal, {tokens(CLOSING)} AS closed FROM (
    SELECT *, regexp_extract(report, '(?s)IMPRESSION:\n(.*)$', 1) AS own FROM c)),
v AS ({level("off", "false")} UNION ALL {level("numbers", number)} UNION ALL {level("strict", strict)}),
s AS (
  SELECT level || '|' || case_id AS case_id, report AS reference, template_content AS template,
         CASE WHEN k % 6 = 0 THEN template_content ELSE
           CASE WHEN ok THEN replace(regexp_extract(template_content, '(?s)^(.*)IMPRESSION:', 1), {OWNER} || {NORMAL}, {OWNER} || own) ELSE regexp_extract(template_content, '(?s)^(.*)IMPRESSION:', 1) END
           || 'IMPRESSION:' || chr(10) || CASE WHEN iok THEN own ELSE {CLOSING} END END AS submission
  FROM v),
{scored} SELECT split_part(case_id, '|', 1) AS level, {MEANS} FROM sc GROUP BY 1"""
    bakeoff = rf"""WITH RECURSIVE c AS (SELECT *, {CLOSING} AS closing, regexp_extract(report, '(?s)\nIMPRESSION:(.*)$', 1) AS ref, contains(dictation, 'IMPRESSION:') AS header FROM ({CASES_SQL})),
o AS (SELECT *, string_split(closing, chr(10))[-1] AS tail, p_impression AS own FROM c),
q AS (SELECT *, CASE WHEN dictation = '' THEN '' ELSE dictation || ' ' || tail END AS closer, CASE WHEN own = '' THEN '' ELSE own || ' ' || tail END AS closed, len(string_split(own, ' ')) AS n FROM o),
h AS (SELECT *, CASE WHEN dictation = '' THEN closing WHEN header THEN regexp_extract(dictation, '(?s)IMPRESSION:\n(.*)$', 1) ELSE closer END AS rule FROM q),
s AS MATERIALIZED (
  SELECT case_id, ref AS a,
         unnest(['template', 'dictation', 'dictation, closer', 'empty', 'heuristic', 'answer', 'answer, closer', 'answer, else heuristic', 'header: answer and last sentence, else answer, closer',
                 'header: heuristic, else heuristic, closer', 'answer, closer below 15 words', 'answer, closer below 25 words', 'answer, closer below 40 words']) AS strategy,
         unnest([closing, dictation, closer, '', rule, own, closed, CASE WHEN own = '' THEN rule ELSE own END, CASE WHEN header THEN own || ' ' || tail ELSE closed END,
                 CASE WHEN header OR contains(rule, tail) THEN rule ELSE rule || ' ' || tail END, CASE WHEN n < 15 THEN closed ELSE own END, CASE WHEN n < 25 THEN closed ELSE own END, CASE WHEN n < 40 THEN closed ELSE own END]) AS b FROM h),
{edit_sql("s", tokens, weight)}
SELECT strategy, round(avg(edit), 9) AS mean, round(quantile_cont(edit, 0.5), 9) AS median FROM s JOIN e USING (a, b) GROUP BY strategy"""
    share = lambda y: f"len(list_filter(list_distinct(x), lambda w: list_contains({y}, w))) / greatest(1, len(list_distinct(x)))::DOUBLE"
    changed = rf"""c AS ({CASES_SQL}),
s AS (SELECT case_id, report AS reference, template_content AS submission, template_content AS template FROM c),
{scored.split(",\nsi AS")[0]},
m AS (SELECT case_id, label, ref, tpl FROM sj WHERE ref IS NOT NULL AND {normal_sql("ref")} <> {normal_sql("tpl")})"""
    content = lambda x: f"list_filter({tokens(x)}, lambda w: w NOT IN ({', '.join(repr(w) for w in L.ROUTING_STOP)}))"
    heavy = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: {weight('t')})), 0.0)"
    return {
        "res_case": f"{plain} SELECT case_id, round(f, 9) AS f, round(i, 9) AS i, round(res, 9) AS res FROM sc",
        "res_dataset": f"{plain} SELECT {MEANS} FROM sc",
        "worst_k": f"{plain} SELECT case_id, round(f, 9) AS f, round(i, 9) AS i, round(res, 9) AS res FROM sc ORDER BY round(res, 9) DESC, case_id LIMIT 10",
        "field_loss": f"{plain}, l AS (SELECT display, sum(w * round(edit, 3)) AS loss, count(*) FILTER (missing) AS n_missing, count(DISTINCT case_id) AS n_cases FROM sd WHERE round(edit, 3) > 0.02 GROUP BY display) SELECT display, round(loss, 6) AS loss, n_missing, n_cases, round(loss / sum(loss) OVER (), 9) AS share FROM l",
        "baselines": named,
        "gold_ceiling": gold,
        "strategy_bakeoff": bakeoff,
        "vocabulary_source": f"""WITH {changed},
o AS (SELECT {tokens("ref")} AS x, {tokens("dictation")} AS y, {tokens("tpl")} AS z FROM m JOIN c USING (case_id)),
q AS (SELECT {share("y")} AS a, {share("z")} AS b FROM o)
SELECT CASE WHEN a > b THEN 'dictation' WHEN a < b THEN 'template' ELSE 'tie' END AS source, count(*) AS n FROM q GROUP BY 1""",
        "select_patch": f"SELECT case_id, CAST(fields <> '' AS BIGINT) AS n_fields, impression <> '' AS has_impression, CAST(fields <> '' AS INTEGER) - CASE WHEN impression = '' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM ({guard})",
        "router_labels": f"""WITH {changed},
n AS (SELECT case_id, unnest({sentences("dictation")}) AS sentence, generate_subscripts({sentences("dictation")}, 1) - 1 AS pos FROM c),
t AS MATERIALIZED (SELECT *, {content("sentence")} AS x FROM n),
f AS (SELECT case_id, label, {content("ref")} AS y FROM m WHERE label <> '{L.OTHER_FINDINGS}'),
z AS (SELECT t.case_id, pos, label, {heavy("list_filter(list_distinct(x), lambda w: list_contains(y, w))")} / CASE WHEN {heavy("x")} > 0 THEN {heavy("x")} ELSE 1.0 END AS sc FROM t JOIN f ON f.case_id = t.case_id AND len(y) > 0),
b AS (SELECT case_id, pos, arg_max(label, row(sc, label)) AS best, max(sc) AS first, coalesce(list_sort(list(sc), 'DESC')[2], 0.0) AS second FROM z GROUP BY case_id, pos)
SELECT t.case_id, CAST(t.pos AS BIGINT) AS pos, sentence, CASE WHEN len(x) > 0 AND first >= 0.6 AND first - second >= 0.4 THEN best ELSE '{L.DROP}' END AS label FROM t LEFT JOIN b ON b.case_id = t.case_id AND b.pos = t.pos""",
    }
