"""Trace rows of answered questions, appended to a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import half_even


def traces(answers: DataFrame, hits: DataFrame, mode: str, model: str = "standin:extractive", variant: str | None = None) -> DataFrame:
    """One row for each answer with the pages and scores it rests on, in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "source", "page", "score")))
    seen = hits.groupBy("qid").agg(listed.alias("h"))
    joined = answers.join(seen, "qid", "left")
    shown = F.transform("h", lambda x: F.concat(x["source"], F.lit(" p"), F.coalesce(x["page"].cast("string"), F.lit("None"))))
    return joined.select("qid", F.lit(mode).alias("mode"), F.lit(model).alias("model"), F.lit(variant).cast("string").alias("retriever_variant"), "query", "answer", "stop_reason", "input_tokens", "output_tokens", F.coalesce(F.size("h"), F.lit(0)).alias("n_hits"), F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("hit_pages"), F.coalesce(F.transform("h", lambda x: half_even(x["score"], 4)), F.array().cast("array<double>")).alias("hit_scores"))


def recorded(stages: dict[str, DataFrame], mode: str, path: str, **told) -> bool:
    """The trace of a mode's answers, appended to the table at path: whether it was written. stages: answers, and hits or what was rendered."""
    return append(traces(stages["answers"], stages["hits"] if "hits" in stages else stages["render"], mode, **told), path)


def append(rows: DataFrame, path: str) -> bool:
    """Best effort, as tracing must not fail an answer: whether it was written."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True
