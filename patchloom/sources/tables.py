"""CSV and JSON sources and sinks. Cells hold line feeds and doubled quotes, so both sides are told so explicitly."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfkc
from ..operators.cache import merge

TEXTS = ("modality", "body_part", "study_description", "patient_age_band", "patient_sex", "template_content", "dictation", "report")
TRAIN = T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", *TEXTS)])
TEST = T.StructType(TRAIN.fields[:-1])
SUBMISSION = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("report", T.StringType())])
CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("raw", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRAIN) -> DataFrame:
    """Rows of a quoted CSV with a header; null texts become empty, and texts get normal form KC once, here."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return nfkc(df, *(c for c in df.columns if c in TEXTS))


def write_csv(df: DataFrame, path: str) -> None:
    """One file, every cell quoted, for a submission; it holds one row for each case."""
    df.repartition(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_result(df: DataFrame, path: str) -> None:
    """Nested run summaries as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache table; one that isn't there is empty. Its newest whole version counts, as its marker of success tells."""
    versions = _versions(spark, path)
    return spark.read.schema(CACHE).parquet(f"{path}/{versions[-1]}") if versions else spark.createDataFrame([], CACHE)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions of a cache table, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(x for x in names if x.startswith("v-") and fs.exists(hadoop.Path(f"{path}/{x}/_SUCCESS")))


def write_cache(df: DataFrame, path: str) -> None:
    """Adds df to the cache as a new version beside the old ones: what they have and df hasn't is taken over, entries of df win. A version counts
    from when it is whole, so a crash loses nothing. Of two writers at a time one version is the newest; what only the other has is asked anew.
    The version before the last stays for those that still read it, older ones are deleted."""
    spark = df.sparkSession
    before = _versions(spark, path)
    merged = merge(read_cache(spark, path), df.select("key", "raw"))
    merged.write.parquet(f"{path}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for old in before[:-1]:
        at = hadoop.Path(f"{path}/{old}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Settings:
    """What the command-line flags of a run set, as values."""

    provider: str = "mock"
    model: str = "mock"
    n_dev: int = 160
    n_shots: int = 0
    level: str = "numbers"
    n_samples: int = 1
    seed: int = 42
    temperatures: tuple[float, ...] = field(default=(0.0, 0.7))

    def temperature(self, sample: int) -> float:
        return self.temperatures[min(sample, len(self.temperatures) - 1)]


def summary(scores: DataFrame, settings: Settings) -> DataFrame:
    """One nested row: provider, model, n_dev, variants, best, of scores(n_shots, level, f, i, res, n)."""
    v = F.struct("n_shots", "level", "f", "i", "res", "n")
    return scores.agg(F.sort_array(F.collect_list(v)).alias("variants"), F.min_by(v, "res").alias("best")).select(F.lit(settings.provider).alias("provider"), F.lit(settings.model).alias("model"), F.lit(settings.n_dev).alias("n_dev"), "variants", "best")
