"""The batch run: prompts, cached answers, guarded and chosen patches, rendered reports, scores. Answers come from a pluggable source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc
from ..operators import cache as C
from ..operators.once import digest, distinct, held
from ..operators.patch import FIELDS, fallback_patch, guard, mock_patch, parse_json, parsed, render, select_patch
from ..operators.retrieve import SYSTEM_PROMPT, shot_lists, user_prompt
from ..operators.score import score_dataset, score_predictions
from ..sources.tables import Settings

#: Takes requests(case_id, sample, key, prompt, template_content, dictation) and returns key, raw for those that it can answer.
PatchSource = Callable[[DataFrame], DataFrame]


def _answers(patch) -> PatchSource:  # noqa: ANN001
    to_json = lambda p: F.to_json(F.struct(F.map_from_entries(p["fields"]).alias("fields"), p["impression"].alias("impression")))
    return lambda requests: requests.select("key", "template_content", "dictation").dropDuplicates(["key"]).select("key", to_json(patch(F.col("template_content"), F.col("dictation"))).alias("raw"))


#: Sources that need no model.
mock: PatchSource = _answers(mock_patch)
fallback: PatchSource = _answers(fallback_patch)


def remote(complete: Callable[[str, str, float], str | None], settings: Settings, attempts: int = 3, wait: float = 2.0, fatal: tuple[type[Exception], ...] = (), tasks: int = 2) -> PatchSource:
    """A source that calls complete(prompt, system, temperature) for each request, with waits that double; an error of a kind in `fatal` ends the
    attempts at once, and what stays without answer gives no row. At most `tasks` requests run at a time; only they are in so few tasks. There is no default client."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for row in batch.to_pylist():
                for n in range(attempts):
                    try:
                        raw = complete(row["prompt"], SYSTEM_PROMPT, settings.temperature(row["sample"]))
                    except fatal:
                        break
                    except Exception:  # noqa: BLE001  any other failure of a remote service is tried again
                        time.sleep(min(wait * 2**n, 120))
                        continue
                    if raw:
                        keys.append(row["key"])
                        raws.append(raw)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(raws, pa.string())], names=["key", "raw"])

    return lambda requests: requests.select("key", "sample", "prompt").repartition(tasks).mapInArrow(run, "key string, raw string")


def cached(source: PatchSource, store: DataFrame) -> PatchSource:
    """Answers from the store first; only what it lacks is asked of the source."""

    def answer(requests: DataFrame) -> DataFrame:
        have = store.join(requests.select("key").distinct(), "key", "left_semi")
        return have.unionByName(source(C.misses(requests, store)))

    return answer


#: The columns of a case that its prompt, answer and report depend on.
CONTENT = ("template_content", "dictation", "study_description", "modality", "body_part", "patient_sex", "patient_age_band")
NO_SHOTS = "array<struct<rank:int,template_content:string,dictation:string,gold:string>>"


def requests(cases: DataFrame, pool: DataFrame, s: Settings, same: bool = False) -> DataFrame:
    """One row for each case and sample, with its prompt and cache key. With same, cases are of the pool and aren't their own example."""
    if s.n_shots > 0:
        of, lists = shot_lists(cases, pool, s.n_shots, same)
        own = cases.join(of, "case_id", "left")
    else:
        own, lists = cases.withColumn("list", F.lit("")), None
    # a prompt is made once for each content and list of examples
    rows = distinct(own, *CONTENT, "list").drop("n")
    rows = rows.withColumn("shots", F.lit(None).cast(NO_SHOTS)) if lists is None else rows.join(lists, "list", "left")
    rows = held(rows, prompt=user_prompt(F.col("shots"))).select(digest(*CONTENT, "list").alias("_p"), "prompt", F.explode(F.sequence(F.lit(0), F.lit(s.n_samples - 1))).alias("sample"))
    temperature = F.lit(s.temperature(1))
    for i in reversed(range(min(s.n_samples, 1))):
        temperature = F.when(F.col("sample") == i, s.temperature(i)).otherwise(temperature)
    rows = rows.withColumn("key", C.key(F.lit(s.provider), F.lit(s.model), temperature, F.lit(SYSTEM_PROMPT), F.col("prompt"), F.col("sample")))
    return own.withColumn("_p", digest(*CONTENT, "list")).drop("list").join(rows, "_p").drop("_p")


def reports(asked: DataFrame, answers: DataFrame, s: Settings) -> DataFrame:
    """case_id, report: of each case the most aggressive guarded answer, rendered; a case without an answer gets its template."""
    none = F.struct(F.array().cast(FIELDS).alias("fields"), F.lit("").alias("impression"))
    rows = asked.join(nfkc(answers, "raw"), "key", "left").withColumn("p", F.coalesce(parse_json(F.col("raw")), none))
    rows = rows.withColumn("c", parsed(F.col("template_content"), F.col("dictation")))
    rows = rows.withColumn("g", guard(F.col("p"), F.col("c"), s.level))
    best = rows.groupBy("case_id").agg(F.first("c").alias("c"), select_patch(F.transform(F.sort_array(F.collect_list(F.struct("sample", "g"))), lambda x: x["g"])).alias("clean"))
    return best.select("case_id", render(F.col("c"), F.col("clean")).alias("report"))


def run_dataset(cases: DataFrame, pool: DataFrame, s: Settings = Settings(), source: PatchSource = mock) -> DataFrame:
    """case_id, report: one row for each case_id. Cases of equal content are asked, guarded and rendered once, so the source sees a digest of the content as case_id."""
    ids = cases.select("case_id", digest(*CONTENT).alias("_id")).groupBy("case_id").agg(F.min("_id").alias("_id"))
    asked = requests(distinct(cases, *CONTENT).drop("n").withColumn("case_id", digest(*CONTENT)), pool, s)
    return ids.join(reports(asked, source(asked), s).withColumnRenamed("case_id", "_id"), "_id").select("case_id", "report")


def sweep(cases: DataFrame, pool: DataFrame, s: Settings, source: PatchSource = mock, n_shots: tuple[int, ...] = (0, 1, 3), levels: tuple[str, ...] = ("off", "numbers", "strict")) -> DataFrame:
    """n_shots, level, f, i, n, res of every combination; those with more examples than the pool has cases are passed over."""
    size, out = pool.count(), None
    for k in (x for x in n_shots if x <= size):
        for level in levels:
            now = Settings(s.provider, s.model, s.n_dev, k, level, s.n_samples, s.seed, s.temperatures)
            one = score_dataset(score_predictions(cases, run_dataset(cases, pool, now, source))).withColumns({"n_shots": F.lit(k), "level": F.lit(level)})
            out = one if out is None else out.unionByName(one)
    return out


def run_and_score(cases: DataFrame, pool: DataFrame, s: Settings = Settings(), source: PatchSource = mock) -> tuple[DataFrame, float]:
    """The scores as a table held in memory, and the seconds that it took."""
    begun = time.time()
    scores = score_predictions(cases, run_dataset(cases, pool, s, source)).cache()
    scores.count()
    return scores, time.time() - begun
