"""Guarding and rendering of patches that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc
from ..operators.patch import guard, parse_json, parsed, render


def rendered(answers: DataFrame, level: str = "numbers") -> DataFrame:
    """case_id, report, drops of a stream of answers(case_id, template_content, dictation, raw); rows without a patch get the template. Texts get
    normal form KC first."""
    own = nfkc(answers, "template_content", "dictation", "raw").select("case_id", parsed(F.col("template_content"), F.col("dictation")).alias("_c"), parse_json(F.col("raw")).alias("_p"))
    own = own.withColumn("_g", guard(F.col("_p"), F.col("_c"), level))
    return own.select("case_id", render(F.col("_c"), F.col("_g")).alias("report"), F.col("_g.drops").alias("drops"))
