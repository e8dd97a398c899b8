"""Second-stage reranking with a pluggable scorer of (query, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions.text import coverage
from tidepool.schema import MAX_PAIR_TOKENS

Scorer = Callable[[Column, Column], Column]


def term_coverage(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of query terms in the text, of as many tokens of both as the encoder takes."""
    return F.round(coverage(query, text, MAX_PAIR_TOKENS), 6)


def rerank(hits: DataFrame, queries: DataFrame, top_k: int | None = None, scorer: Scorer = term_coverage) -> DataFrame:
    """hits (qid, rank, text, ...) in the order of rerank_score, ties by their rank before; all, unless top_k."""
    text = F.coalesce("text", F.lit("")) if "text" in hits.columns else F.lit("")
    scored = hits.join(queries.select("qid", F.col("query").alias("_query")), "qid").withColumn("rerank_score", scorer(F.col("_query"), text)).drop("_query")
    order = W.partitionBy("qid").orderBy(F.desc("rerank_score"), "prior_rank")
    out = scored.withColumnRenamed("rank", "prior_rank").withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= top_k)
