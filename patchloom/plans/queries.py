"""The registered queries of the template-edit operators, over the tables and over the generated cases, and their SQL.

The SQL is DuckDB's, whose regular expressions have no look-around: rules that look around are written as replacements of what was
caught. `scores_sql` has the edit distance as a recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import structure as S
from ..functions import text as X
from ..operators import cache as C
from ..operators import patch as P
from ..operators import report as R
from ..operators import retrieve as Q
from ..operators import router as N
from ..operators import score as D
from ..sources.tables import Settings
from . import run as B
from . import scores_sql
from .cases import CASES_SQL, candidate, cases


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.norm_key(F.col("text")).alias("tokens"))


def nfkc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of texts behind which stand a ligature, wide digits and a unit in one character."""
    odd = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n" + chr(0xFB01) + "brosis " + chr(0xFF11) + chr(0xFF12) + chr(0x339C))).alias("text"))
    return X.nfkc(odd, "text").select("doc_id", X.norm_key(F.col("text")).alias("tokens"))


def token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select(F.explode(X.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.select("token", "n", X.token_weight(F.col("token")).alias("weight"))


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.split_sentences(F.col("text")), "|").alias("sentences"))


def dict_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.dict_sentences(F.col("text")), "|").alias("sentences"))


def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(X.canonical(F.concat_ws("-", "source", "lang")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.clip(F.col("text")).cast("binary")).alias("digest"))


def token_sql(x: str) -> str:
    """Tokens of a text in normal form KC, as a list."""
    x = f"lower(coalesce({x}, ''))"
    for short, long in L.UNITS.items():
        x = f"regexp_replace({x}, '\\b(?:{'|'.join(long)})\\b', '{short}', 'g')"
    x = f"regexp_replace({x}, '(?m)^(?:[ \\t]*(?:\\d+[ \\t]*[.)]|[-*+•‣▪])[ \\t]+)+', '', 'g')"
    for pattern, into in ((r"[^\p{L}\p{N}_\s+/\-]", "' '"), (r"([\p{L}\p{N}_])/", r"'\1 '"), (r"/([\p{L}\p{N}_])", r"' \1'"), (r"\+\s*(\d+)", r"' ' || chr(57344) || '\1 '"), (r"-\s*(\d+)", r"' ' || chr(57345) || '\1 '"), (r"([a-z])-([a-z])", r"'\1\2'"), (r"([a-z])-([a-z])", r"'\1\2'"), (r"[+\-]", "' '"), (r"([a-z])(\d)", r"'\1 \2'"), (r"(\d)([a-z])", r"'\1 \2'")):
        x = f"regexp_replace({x}, '{pattern}', {into}, 'g')"
    x = f"replace(replace({x}, chr(57344), '+'), chr(57345), '-')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def weight_sql(t: str) -> str:
    return f"CASE WHEN {t} IN ({listed(L.CRITICAL_WORDS)}) THEN 4.0::DOUBLE WHEN {t} IN ({listed(L.FUNCTION_WORDS)}) THEN 0.25::DOUBLE WHEN regexp_matches({t}, '\\d') THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END"


def sentence_sql(split: str) -> str:
    """Sentences of conversations joined by |; split inserts chr(1) at the ends."""
    return rf"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM conversations),
p AS (SELECT conv_id, turn, pos, list_filter(list_transform(string_split({split}, chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM l)
SELECT conv_id, turn, array_to_string(flatten(list(parts ORDER BY pos)), '|') AS sentences FROM p GROUP BY conv_id, turn
"""


# ---- structure and scores on the generated cases


def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cases(spark, sf_dir).select("case_id", F.posexplode(S.fields_of(F.col("report"))).alias("pos", "f"))
    return own.select("case_id", F.col("pos").cast("bigint").alias("pos"), "f.label", "f.display", "f.content")


FIELDS_SQL = rf"""
c AS ({CASES_SQL}),
s AS (SELECT case_id, col, regexp_extract(txt, '(?s)FINDINGS:(.*?)\nIMPRESSION:', 1) AS block FROM (SELECT case_id, unnest(['r', 't']) AS col, unnest([report, template_content]) AS txt FROM c)),
l AS (SELECT case_id, col, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS p FROM s),
f AS (
  SELECT case_id, col, row_number() OVER (PARTITION BY case_id, col ORDER BY p) - 1 AS pos, trim(regexp_extract(line, '^([^:]+):', 1)) AS display,
         regexp_replace(upper(regexp_extract(line, '^([^:]+):', 1)), '[^A-Z0-9]+', '', 'g') AS label, trim(regexp_extract(line, '^[^:]+:(.*)$', 1)) AS content
  FROM l WHERE line <> '')"""


def gold_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cases(spark, sf_dir).select("case_id", "report", S.fields_of(F.col("template_content")).alias("t")).select("case_id", S.gold_patch(F.col("report"), F.col("t")).alias("p"))
    return own.select("case_id", F.size("p.fields").cast("bigint").alias("n_fields"), F.array_join(F.transform("p.fields", lambda f: F.concat_ws("=", f["label"], f["content"])), "|").alias("fields"), "p.impression")


def as_scored(c: DataFrame) -> DataFrame:
    return c.select("case_id", F.col("report").alias("reference"), F.col("template_content").alias("submission"), F.col("template_content").alias("template"))


def rounded(means: DataFrame, *names: str) -> DataFrame:
    """Means to nine places, as the order of a sum isn't fixed."""
    return means.withColumns({x: F.round(x, 9) for x in names or ("f", "i", "res")})


def res_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.score_cases(as_scored(cases(spark, sf_dir))).select("case_id", F.round("f", 9).alias("f"), F.round("i", 9).alias("i"), F.round("res", 9).alias("res"))


def res_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.score_dataset(D.score_cases(as_scored(cases(spark, sf_dir)))))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.baselines(cases(spark, sf_dir)))


def field_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.field_loss(D.field_details(as_scored(cases(spark, sf_dir)))), "loss", "share")


def worst_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.worst(res_case(spark, sf_dir), "res", 10)


def gold_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.gold_ceiling(cases(spark, sf_dir)))


# ---- retrieval


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return Q.query(Q.index(docs), asked, 3).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


TFIDF_SQL = f"""
WITH n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({token_sql("text")}) AS term FROM documents) GROUP BY ALL),
i AS (SELECT term, ln((SELECT n FROM n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM d GROUP BY term),
dv AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM d JOIN i USING (term)),
dn AS (SELECT id, sqrt(sum(w * w)) AS len FROM dv GROUP BY id),
q AS (SELECT item_id AS qid, term, count(*) AS tf FROM (SELECT item_id, unnest({token_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
qv AS (SELECT qid, q.term, (1 + ln(tf)) * coalesce(idf, ln((SELECT n FROM n)::DOUBLE) + 1) AS w FROM q LEFT JOIN i ON q.term = i.term),
qn AS (SELECT qid, sqrt(sum(w * w)) AS len FROM qv GROUP BY qid),
s AS (SELECT qid, id, sum(qv.w * dv.w / qn.len / dn.len) AS score FROM qv JOIN dv USING (term) JOIN qn USING (qid) JOIN dn USING (id) GROUP BY qid, id),
a AS (SELECT b.item_id AS qid, d.doc_id AS id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN s ON s.qid = b.item_id AND s.id = d.doc_id),
r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM a)
SELECT * FROM r WHERE rank <= 3
"""


def few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every case, with examples from all other cases."""
    c = cases(spark, sf_dir)
    asked = B.requests(c, c, Settings(n_shots=3), same=True)
    return asked.select("case_id", "sample", F.char_length("prompt").alias("n_chars"), "key")


# ---- patches


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties read as patches: valid JSON objects without the two keys give an empty patch."""
    own = read(spark, sf_dir, "events").select("event_id", P.parse_json(F.col("props")).alias("p"))
    return own.select("event_id", F.col("p").isNotNull().alias("parsed"), F.coalesce(F.size("p.fields"), F.lit(0)).cast("bigint").alias("n_fields"))


def guarded(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    own = cases(spark, sf_dir).withColumn("c", P.parsed(F.col("template_content"), F.col("dictation"))).withColumn("p", candidate())
    return own.withColumn("g", P.guard(F.col("p"), F.col("c"), level))


def guard_query(level: str):  # noqa: ANN201
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = guarded(spark, sf_dir, level)
        return g.select("case_id", F.array_join(F.transform("g.fields", lambda f: F.concat_ws("=", f["label"], f["content"])), "|").alias("fields"), "g.impression", F.array_join("g.drops", "|").alias("drops"))

    return query


#: What the rule of the generated cases makes of the guard: the number of the candidate is invented in one case of five, unless it is
#: heard or in the template's text; with strict so are grade and side.
GUARD_SQL = """
WITH c AS ({cases}),
t AS (SELECT *, {heard} AS heard, {content} AS said, regexp_replace(upper(p_label), '[^A-Z0-9]+', '', 'g') AS label, {normal} AS normal, {closing} AS closing FROM c),
j AS (
  SELECT *, len(list_filter(said, lambda w: NOT list_contains(heard, w) AND NOT list_contains(normal, w) AND ({claim}))) = 0 AS ok,
         p_impression <> '' AND len(list_filter({imp}, lambda w: NOT list_contains(heard, w) AND NOT list_contains(closing, w) AND ({claim}))) = 0 AS iok
  FROM t)
SELECT case_id, CASE WHEN ok THEN label || '=' || p_content ELSE '' END AS fields, CASE WHEN iok THEN p_impression ELSE '' END AS impression,
       array_to_string(list_filter([CASE WHEN NOT ok THEN 'unsupported:' || substr(p_content, 1, 40) END, 'label:' || p_extra, CASE WHEN p_impression <> '' AND NOT iok THEN 'impression_fully_unsupported' END], lambda x: x IS NOT NULL), '|') AS drops
FROM j
"""


def guard_sql(claim: str) -> str:
    owner = "CASE body_part WHEN 'Chest' THEN 'No pleural effusion or pneumothorax.' WHEN 'Spine' THEN 'No significant facet arthropathy.' ELSE 'No joint effusion.' END"
    closing = "regexp_extract(template_content, '(?s)IMPRESSION:(.*)$', 1)"
    return GUARD_SQL.format(cases=CASES_SQL, heard=token_sql("dictation"), content=token_sql("p_content"), normal=token_sql(owner), closing=token_sql(closing), imp=token_sql("p_impression"), claim=claim)


def render_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = guarded(spark, sf_dir, "off")
    return g.select("case_id", P.render(F.col("c"), F.col("g")).alias("report"))


RENDER_SQL = f"""
WITH c AS ({CASES_SQL}),
o AS (SELECT *, CASE body_part WHEN 'Chest' THEN 'No pleural effusion or pneumothorax.' WHEN 'Spine' THEN 'No significant facet arthropathy.' ELSE 'No joint effusion.' END AS normal,
             CASE body_part WHEN 'Chest' THEN 'PLEURA: ' WHEN 'Spine' THEN 'DISCS/DEGENERATIVE CHANGES: ' ELSE 'JOINTS: ' END AS owner,
             regexp_extract(template_content, '(?s)IMPRESSION:\\n(.*)$', 1) AS closing FROM c)
SELECT case_id, replace(regexp_extract(template_content, '(?s)^(.*)IMPRESSION:', 1), owner || normal, owner || p_content) || 'IMPRESSION:' || chr(10)
       || CASE WHEN p_impression = '' THEN closing ELSE p_impression || ' ' || string_split(closing, chr(10))[-1] END AS report
FROM o
"""


def heuristic_impression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", P.heuristic_impression(F.col("template_content"), F.col("dictation")).alias("impression"))


HEURISTIC_SQL = f"""
WITH c AS (SELECT *, regexp_extract(template_content, '(?s)IMPRESSION:\\n(.*)$', 1) AS closing FROM ({CASES_SQL}))
SELECT case_id, CASE WHEN dictation = '' THEN closing WHEN k % 11 = 0 THEN regexp_extract(dictation, '(?s)IMPRESSION:\\n(.*)$', 1) ELSE dictation || ' ' || string_split(closing, chr(10))[-1] END AS impression FROM c
"""


def select_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidate, the candidate without its impression, and the empty patch."""
    g = guarded(spark, sf_dir, "numbers")
    none = X.record(fields=F.array().cast(P.FIELDS), impression=F.lit(""), drops=F.array().cast("array<string>"))
    bare = X.record(fields=F.col("g.fields"), impression=F.lit(""), drops=F.col("g.drops"))
    own = g.select("case_id", F.array(none, bare, F.col("g")).alias("a")).withColumn("s", P.select_patch(F.col("a")))
    return own.select("case_id", F.size("s.fields").cast("bigint").alias("n_fields"), (F.col("s.impression") != "").alias("has_impression"), P.aggressiveness(F.col("s")).alias("score"))


def mock_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    return B.run_dataset(c, c, Settings(), B.mock)


def fallback_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    return B.run_dataset(c, c, Settings(level="off"), B.fallback)


# ---- router


def router_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's weights for labelled documents: class = quality, body part = language."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.col("text").alias("sentence"), F.col("quality").cast("string").alias("label"), F.col("lang").alias("body_part"))
    return N.fit(d).weights.select("label", "feature", F.round("ll", 6).alias("ll"))


ROUTER_SQL = f"""
WITH d AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label, lang, {token_sql("text")} AS t FROM documents JOIN labels USING (doc_id)),
f AS (
  SELECT label, unnest(t) AS feature FROM d
  UNION ALL SELECT label, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) FROM d
  UNION ALL SELECT label, 'bp=' || lower(trim(lang)) FROM d WHERE lang <> ''),
c AS (SELECT label, feature, count(*) AS k FROM f GROUP BY ALL),
v AS (SELECT feature, ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY feature),
w AS (SELECT label, feature, k * idf AS wc FROM c JOIN v USING (feature)),
s AS (SELECT label, ln(sum(wc) + 0.2 * (SELECT count(*) FROM v)) AS base FROM w GROUP BY label)
SELECT label, feature, round(ln(wc + 0.2) - base, 6) AS ll FROM w JOIN s USING (label)
"""


def router_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.training_set(cases(spark, sf_dir)).select("case_id", F.col("pos").cast("bigint").alias("pos"), "sentence", "label")


def router_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    out = N.route_cases(c, N.train(c))
    return out.select("case_id", "pos", "sentence", "label", "source", F.round("margin", 6).alias("margin"))


# ---- splits, validation, diagnostics


def dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dev_split(read(spark, sf_dir, "documents").select("doc_id"), 160, 42, "doc_id")


def validate_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates rendered without guard are valid but for what is planted: each 13th is empty, each 17th is missing."""
    c = cases(spark, sf_dir)
    sub = guarded(spark, sf_dir, "off").where("k % 17 <> 0").select("case_id", F.when(F.col("k") % 13 == 0, "").otherwise(P.render(F.col("c"), F.col("g"))).alias("report"))
    return R.validate_submission(sub, c)


VALIDATE_SQL = f"""
WITH c AS ({CASES_SQL})
SELECT case_id, 'missing id' AS problem FROM c WHERE k % 17 = 0
UNION ALL SELECT case_id, 'empty report' FROM c WHERE k % 17 <> 0 AND k % 13 = 0
UNION ALL SELECT NULL, 'rows ' || (SELECT count(*) FROM c WHERE k % 17 <> 0) || ' expected ' || (SELECT count(*) FROM c)
"""


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.diagnosis(cases(spark, sf_dir))
    return d.select("case_id", F.col("n_fields").cast("bigint").alias("n_fields"), F.col("n_changed").cast("bigint").alias("n_changed"), F.round("overlap", 9).alias("overlap"), "same_impression")


DIAGNOSIS_SQL = f"""
WITH {FIELDS_SQL},
r AS (SELECT a.case_id, count(*) AS n_fields, count(*) FILTER (a.content <> coalesce(b.content, '')) AS n_changed, coalesce(string_agg(a.content, ' ') FILTER (a.content <> coalesce(b.content, '')), '') AS said
      FROM (SELECT * FROM f WHERE col = 'r') a LEFT JOIN (SELECT * FROM f WHERE col = 't') b ON a.case_id = b.case_id AND a.label = b.label GROUP BY a.case_id),
o AS (SELECT r.*, c.k, list_distinct({token_sql("said")}) AS x, {token_sql("dictation")} AS y FROM r JOIN c USING (case_id))
SELECT case_id, n_fields, n_changed, round(len(list_filter(x, lambda w: list_contains(y, w))) / greatest(1, len(x))::DOUBLE, 9) AS overlap, k % 6 = 0 AS same_impression FROM o
"""


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("n", F.size(F.split("text", "\n", -1)))
    out = R.bucket_share(d.withColumn("bucket", R.length_bucket(F.col("n"))), "bucket", "n")
    return out.select("bucket", "n", F.round("mean", 9).alias("mean"), "total", F.round("share", 9).alias("share"))


BUCKET_SQL = """
WITH d AS (SELECT len(string_split(text, chr(10))) AS v FROM documents),
b AS (SELECT CASE WHEN v <= 1 THEN '(0, 1]' WHEN v <= 3 THEN '(1, 3]' WHEN v <= 7 THEN '(3, 7]' WHEN v <= 15 THEN '(7, 15]' WHEN v <= 999 THEN '(15, 999]' END AS bucket, v FROM d)
SELECT bucket, count(*) AS n, round(avg(v), 9) AS mean, CAST(sum(v) AS BIGINT) AS total, round(sum(v) / sum(sum(v)) OVER (), 9) AS share FROM b GROUP BY bucket
"""


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dev_split(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return R.value_counts(d.where("NOT dev"), d.where("dev"), "source", 10)


DEV = "(SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) <= 160 AS dev FROM documents)"
COUNTS_SQL = f"""
SELECT source AS value, count(*) FILTER (NOT dev) AS n_a, count(*) FILTER (dev) AS n_b FROM documents JOIN {DEV} USING (doc_id) GROUP BY source ORDER BY n_a DESC, n_b DESC, value LIMIT 10
"""


def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quantiles(read(spark, sf_dir, "documents").withColumn("n", F.char_length("text")), "n")


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.order_statistics(read(spark, sf_dir, "documents").withColumn("n", F.char_length("text")), "n")


def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("v", F.char_length("text"))
    return R.group_means(d, "source", "v", 3, 10).select("source", "n", F.round("mean", 6).alias("mean"), F.round("share", 9).alias("share"))


def label_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_inventory(cases(spark, sf_dir))


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_sets(cases(spark, sf_dir))


def strategy_bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.bake_off(R.strategy_counts(cases(spark, sf_dir), F.col("p_impression"))), "mean", "median")


def vocabulary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vocabulary_source(cases(spark, sf_dir))


def mean_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_length(cases(spark, sf_dir), "report")


# ---- cache


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests for all documents, and a store of answers for those that have labels."""
    asked = read(spark, sf_dir, "documents").select("doc_id", C.key(F.lit("mock"), F.col("lang"), F.col("text")).alias("key"))
    judged = read(spark, sf_dir, "labels").select("doc_id")
    store = C.merge(spark.createDataFrame([], "key string, raw string"), asked.join(judged, "doc_id", "left_semi").select("key", F.col("doc_id").cast("string").alias("raw")))
    return asked, store


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(*_cache(spark, sf_dir))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.misses(*_cache(spark, sf_dir)).select("doc_id", "key")


KEY_SQL = "k AS (SELECT doc_id, sha1('mock' || chr(0) || lang || chr(0) || text) AS key FROM documents), s AS (SELECT DISTINCT key FROM k WHERE doc_id IN (SELECT doc_id FROM labels))"

QUERIES = {
    "tfidf_topk": tfidf_topk, "tokenize_docs": tokenize_docs, "nfkc_tokens": nfkc_tokens, "token_weights": token_weights, "split_sentences": split_sentences, "dict_sentences": dict_sentences,
    "canonical_labels": canonical_labels, "clip_texts": clipped, "parse_fields": parse_fields, "gold_patch": gold_patch, "res_case": res_case, "res_dataset": res_dataset,
    "baselines": baselines, "field_loss": field_loss, "worst_k": worst_k, "gold_ceiling": gold_ceiling, "few_shot_prompt": few_shot_prompt, "json_props": json_props,
    "guard_off": guard_query("off"), "guard_numbers": guard_query("numbers"), "guard_strict": guard_query("strict"), "render_report": render_report,
    "heuristic_impression": heuristic_impression, "select_patch": select_patch, "mock_run": mock_run, "fallback_run": fallback_run, "router_weights": router_weights,
    "router_labels": router_labels, "router_route": router_route, "dev_split": dev_split, "validate_submission": validate_submission, "diagnosis": diagnosis,
    "length_buckets": length_buckets, "value_counts": value_counts, "length_quantiles": length_quantiles, "order_statistics": order_statistics, "group_means": group_means,
    "label_inventory": label_inventory, "label_sets": label_sets, "strategy_bakeoff": strategy_bakeoff, "vocabulary_source": vocabulary_source, "mean_length": mean_length,
    "cache_hits": cache_hits, "cache_misses": cache_misses,
}

NUMBER = r"regexp_matches(w, '\d')"
ORACLES = {
    "tfidf_topk": TFIDF_SQL,
    "tokenize_docs": f"SELECT doc_id, array_to_string({token_sql('text')}, ' ') AS tokens FROM documents",
    "token_weights": f"SELECT token, count(*) AS n, any_value({weight_sql('token')}) AS weight FROM (SELECT unnest({token_sql('text')}) AS token FROM documents) GROUP BY token",
    "split_sentences": sentence_sql(r'''regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '([.;:])\s+([A-Z0-9("\x27])', '\1' || chr(1) || '\2', 'g')'''),
    "dict_sentences": sentence_sql(r'''regexp_replace(trim(line), '([.!?])\s+(["\x27(]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g')'''),
    "canonical_labels": "SELECT regexp_replace(upper(source || '-' || lang), '[^A-Z0-9]+', '', 'g') AS label, count(*) AS n FROM documents GROUP BY 1",
    "clip_texts": "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || chr(10) || '...[truncated]' ELSE text END) AS digest FROM documents",
    "parse_fields": f"WITH {FIELDS_SQL} SELECT case_id, CAST(pos AS BIGINT) AS pos, label, display, content FROM f WHERE col = 'r'",
    "gold_patch": rf"""
WITH {FIELDS_SQL},
g AS (SELECT a.case_id, a.label, a.content FROM (SELECT * FROM f WHERE col = 'r') a JOIN (SELECT * FROM f WHERE col = 't') b ON a.case_id = b.case_id AND a.label = b.label WHERE a.content <> b.content)
SELECT c.case_id, count(g.label) AS n_fields, coalesce(string_agg(g.label || '=' || g.content, '|'), '') AS fields, any_value(regexp_extract(report, '(?s)IMPRESSION:\n(.*)$', 1)) AS impression
FROM c LEFT JOIN g USING (case_id) GROUP BY c.case_id""",
    "json_props": "SELECT event_id, coalesce(json_valid(props), false) AS parsed, CASE WHEN json_valid(props) THEN coalesce(len(json_keys(props, '$.fields')), 0) ELSE 0 END AS n_fields FROM events",
    "guard_off": guard_sql("false"),
    "guard_numbers": guard_sql(NUMBER),
    "guard_strict": guard_sql(f"{NUMBER} OR w IN ({listed(sorted({*L.LATERALITY, *L.SEVERITY}))})"),
    "render_report": RENDER_SQL,
    "heuristic_impression": HEURISTIC_SQL,
    "router_weights": ROUTER_SQL,
    "dev_split": f"SELECT * FROM {DEV}",
    "validate_submission": VALIDATE_SQL,
    "diagnosis": DIAGNOSIS_SQL,
    "length_buckets": BUCKET_SQL,
    "value_counts": COUNTS_SQL,
    "length_quantiles": "SELECT count(*) AS n, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, CAST(max(v) AS INTEGER) AS most FROM (SELECT length(text) AS v FROM documents)",
    "order_statistics": "WITH s AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT CAST(min(v) FILTER (p = n // 2) AS INTEGER) AS middle, CAST(min(v) FILTER (p = CAST(floor(n * 0.9) AS BIGINT)) AS INTEGER) AS ninety FROM s",
    "group_means": "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean, round(sum(length(text)) / (SELECT sum(length(text)) FROM documents), 9) AS share FROM documents GROUP BY source HAVING count(*) >= 3 ORDER BY avg(length(text)) DESC, source LIMIT 10",
    "label_inventory": f"WITH {FIELDS_SQL} SELECT display, count(*) AS n FROM f WHERE col = 't' GROUP BY display ORDER BY n DESC, display LIMIT 25",
    "label_sets": f"""
WITH {FIELDS_SQL},
n AS (SELECT case_id, coalesce(list(label) FILTER (col = 'r'), []) AS r, coalesce(list(label) FILTER (col = 't'), []) AS t FROM f GROUP BY case_id),
x AS (SELECT len(list_filter(r, lambda y: NOT list_contains(t, y))) AS a, len(list_filter(t, lambda y: NOT list_contains(r, y))) AS d FROM n)
SELECT count(*) FILTER (a = 0 AND d = 0) AS equal, count(*) FILTER (a > 0) AS adds, count(*) FILTER (d > 0) AS drops FROM x""",
    "nfkc_tokens": f"SELECT doc_id, array_to_string({token_sql("text || chr(10) || 'fibrosis 12 mm'")}, ' ') AS tokens FROM documents",
    "mean_length": f"SELECT avg(length(report)) AS mean_chars FROM ({CASES_SQL})",
    "cache_hits": f"WITH {KEY_SQL} SELECT count(*) AS n, count(*) FILTER (key IN (SELECT key FROM s)) AS n_hits FROM k",
    "cache_misses": f"WITH {KEY_SQL} SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM s)",
}
SENTENCE = r"""regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '([.;:])\s+([A-Z0-9("\x27])', '\1' || chr(1) || '\2', 'g')"""
ORACLES |= scores_sql.oracles(
    token_sql, weight_sql, NUMBER, f"{NUMBER} OR w IN ({listed(sorted({*L.LATERALITY, *L.SEVERITY}))})",
    lambda x: f"flatten(list_transform(string_split({x}, chr(10)), lambda line: list_filter(list_transform(string_split({SENTENCE}, chr(1)), lambda p: trim(p)), lambda p: p <> '')))", ORACLES["guard_numbers"],
)
