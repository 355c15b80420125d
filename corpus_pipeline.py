"""A corpus pipeline over `documents`: five stages, each one operator of patchloom.llm over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import crf, mixing, nearby, pieces, recipes
from patchloom.llm._base import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those without a language for half of their words, go."""
    return crf.accepted(docs)


def keyed(spark: SparkSession, docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs with a hash of a row's file and place in it, the same whenever a task reads it again, and that column's name. What isn't read from files is written first.

    Two rows with one hash, of which 3 are expected in 1e10 documents, both stay if either does.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    try:
        place = docs.metadataColumn("_metadata")
    except AnalysisException:
        docs = Scratch(spark, label).write(docs, "input")
        place = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.xxhash64(place["file_path"], place["row_index"])), name


def one_each(rows: DataFrame, name: str, judged: DataFrame, group: str, *first: str) -> DataFrame:
    """rows less all but one of each group of judged(doc_id, ..), whose doc_id is the rows' column `name`: the greatest by the columns `first`, then the least doc_id (null last).

    Rows are told apart by that column alone, so a null or repeated doc_id neither saves a copy nor drops another text.
    """
    each = judged.withColumnRenamed("doc_id", "_r").join(rows.select(F.col(name).alias("_r"), F.col("doc_id").alias("_doc")), "_r")
    place = F.struct(*first, F.col("_doc").isNotNull().alias("known"), F.bitwise_not("_doc").alias("back"), F.col("_r").alias("row"))
    best = each.groupBy(group).agg(F.max(place)["row"].alias("_best"))
    # what is gone is mostly less than what stays, and may be small enough to spare the texts a shuffle
    gone = judged.select(F.col("doc_id").alias("_gone")).join(best, F.col("_gone") == F.col("_best"), "left_anti")
    return rows.join(gone, rows[name] == gone["_gone"], "left_anti").drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then that of the least doc_id. Rows that share a doc_id are judged one by one."""
    (rows, name), scratch = keyed(spark, docs, "stage2"), Scratch(spark, "stage2")
    judged = recipes.deduplicate(rows.select(F.col(name).alias("doc_id"), "text"), scratch)
    return one_each(rows, name, scratch.write(judged.select("doc_id", "keep_id", "n_points"), "judged"), "keep_id", "n_points")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays, that of the least doc_id (five words, a similarity of 0.8)."""
    (rows, name), scratch = keyed(spark, docs, "stage3"), Scratch(spark, "stage3")
    judged = nearby.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), scratch)
    return one_each(rows, name, scratch.write(judged.select("doc_id", "component_id"), "judged"), "component_id")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights of domains, languages and sources; a small leaf's come once for each epoch."""
    return mixing.mix_sources(docs, Scratch(spark, "stage5"), keep=docs.columns).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents, and digests of them and of the text that they decode to."""
    out = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The stages use a trained model and MinHash bands; their results are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage wrote for itself, and what it read, is deleted once its own table is written."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        before = len(Scratch.made)
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        for own in Scratch.made[before:]:
            own.close()
        if last:
            scratch.drop(last)
        last = name
    return docs
