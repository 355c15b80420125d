"""Cases generated from `part` by a fixed rule, in SQL that Spark and DuckDB both read, so that both sides of a check start alike."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patch import FIELDS

NL = "chr(10)"

#: For each body part: what stands before the owning field's content, its normal content, what follows, the normal impression.
PARTS = {
    "Chest": (["FINDINGS:", "LUNGS: No focal airspace opacity.", "PLEURA: "], "No pleural effusion or pneumothorax.", ["BONES: No acute osseous abnormality.", "OTHER FINDINGS:"], ["No acute cardiopulmonary abnormality."], "PLEURA"),
    "Spine": (["FINDINGS:", "VERTEBRAE: Vertebral body heights are maintained.", "DISCS/DEGENERATIVE CHANGES: "], "No significant facet arthropathy.", ["Soft Tissues: Unremarkable."], ["No acute abnormality of the spine."], "DISCS/DEGENERATIVE CHANGES"),
    "Knee": (["FINDINGS:", "BONES: No acute fracture.", "JOINTS: "], "No joint effusion.", ["SOFT TISSUES: Unremarkable."], ["1. No acute fracture.", "2. No joint effusion."], "JOINTS"),
}


def _text(lines: list[str]) -> str:
    return f" || {NL} || ".join(f"'{x}'" for x in lines)


def _by_part(value) -> str:  # noqa: ANN001
    return "CASE body_part " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in PARTS.items()) + " END"


CASES_SQL = f"""
WITH k AS (
  SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS sz, CAST(floor(p_size / 5.0) AS BIGINT) * 5 AS lo,
         CASE p_partkey % 4 WHEN 0 THEN 'XRAY' WHEN 1 THEN 'MRI' WHEN 2 THEN 'CT' ELSE 'USG' END AS modality,
         CASE p_partkey % 3 WHEN 0 THEN 'Chest' WHEN 1 THEN 'Spine' ELSE 'Knee' END AS body_part,
         CASE p_partkey % 2 WHEN 0 THEN 'right' ELSE 'left' END AS side,
         CASE p_partkey % 5 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' WHEN 2 THEN 'severe' WHEN 3 THEN 'small' ELSE 'large' END AS severity
  FROM part),
f AS (
  SELECT *, severity || ' ' || side || ' ' || CASE body_part WHEN 'Chest' THEN 'pleural effusion' WHEN 'Spine' THEN 'facet arthropathy at L4-L5' ELSE 'joint effusion' END AS what FROM k),
g AS (
  SELECT *, what || ', ' || CAST(sz AS VARCHAR(9)) || ' mm' AS finding,
         upper(substr(what, 1, 1)) || substr(what, 2) || ', ' || CAST(sz AS VARCHAR(9)) || ' mm.' AS sentence,
         upper(substr(what, 1, 1)) || substr(what, 2) || ', ' || CAST(sz + 1 AS VARCHAR(9)) || ' mm.' AS wrong,
         {_by_part(lambda v: _text(v[0]))} AS pre, {_by_part(lambda v: f"'{v[1]}'")} AS normal, {_by_part(lambda v: _text(v[2]))} AS post, {_by_part(lambda v: _text(v[3]))} AS closing, {_by_part(lambda v: f"'{v[4]}'")} AS owner
  FROM f),
t AS (SELECT *, pre || normal || {NL} || post || {NL} || {NL} || 'IMPRESSION:' || {NL} || closing AS template_content FROM g)
SELECT k, 'P' || CAST(k AS VARCHAR(20)) AS case_id, modality, body_part, modality || ' ' || body_part AS study_description,
       CAST(lo AS VARCHAR(9)) || '-' || CAST(lo + 4 AS VARCHAR(9)) AS patient_age_band, CASE k % 2 WHEN 0 THEN 'male' ELSE 'female' END AS patient_sex, template_content,
       CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN 'Technique: routine views.' || {NL} || sentence || {NL} || 'IMPRESSION:' || {NL} || sentence ELSE finding END AS dictation,
       CASE WHEN k % 6 = 0 THEN template_content ELSE pre || sentence || {NL} || post || {NL} || {NL} || 'IMPRESSION:' || {NL} || sentence END AS report,
       CASE WHEN k % 8 = 0 THEN lower(owner) ELSE owner END AS p_label, CASE WHEN k % 5 = 0 THEN wrong ELSE sentence END AS p_content,
       CASE WHEN k % 9 = 0 THEN 'SPLEEN' END AS p_extra, CASE WHEN k % 10 = 0 THEN '' WHEN k % 5 = 0 THEN wrong ELSE sentence END AS p_impression
FROM t
"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases with the columns of the training table, k, and the parts of a candidate patch."""
    view = f"part_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/part.parquet").createTempView(view)
    out = spark.sql(CASES_SQL.replace("FROM part)", f"FROM {view})"))
    spark.catalog.dropTempView(view)
    return out


def candidate() -> Column:
    """The candidate patch of a generated case."""
    row = lambda l, c: F.struct(l.alias("label"), c.alias("content"))
    extra = F.when(F.col("p_extra").isNotNull(), F.array(row(F.col("p_extra"), F.lit("Enlarged.")))).otherwise(F.array().cast(FIELDS))
    return F.struct(F.concat(F.array(row(F.col("p_label"), F.col("p_content"))), extra).cast(FIELDS).alias("fields"), F.col("p_impression").alias("impression"))
