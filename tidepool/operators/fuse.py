"""Weighted reciprocal-rank fusion of ranked lists of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.search import ranked
from tidepool.schema import DEFAULT_WEIGHT, K_HYBRID_MODE, RRF_K

_KEYS = ("qid", "source", "page", "rank")


def _side(hits: DataFrame, name: str, weight: Column, place: int, payload: dict[str, str]) -> DataFrame:
    own = [F.col(c) if c in hits.columns else F.lit(None).cast(t).alias(c) for c, t in payload.items()]
    first = F.struct(F.lit(place).alias("list"), F.col("rank"))  # the second list's ranks come after all of the first's
    return hits.where(F.col("source").isNotNull() | F.col("page").isNotNull()).select("qid", "source", "page", first.alias("ord"), F.lit(name).alias("list"), weight.alias("w"), "rank", F.struct(*own).alias("payload"))


def rrf(text: DataFrame, vision: DataFrame, weights: DataFrame | None = None, k: int = RRF_K, payload: tuple[str, ...] | None = None) -> DataFrame:
    """Pages of both lists with fused_score, sources and the payload of their first hit, all its columns unless some are named.

    Each hit adds weight / (k + rank) to its page, several of one list included; hits without source
    and page take a rank but no part. weights: qid, w_text, w_vision (one half each by default).
    """
    kinds = dict(vision.dtypes) | dict(text.dtypes)
    names = [c for c in dict.fromkeys([*text.columns, *vision.columns]) if c not in _KEYS] if payload is None else list(payload)
    own = {c: kinds[c] for c in names}
    if weights is None:
        sides = [(text, "text", F.lit(DEFAULT_WEIGHT), 0), (vision, "vision", F.lit(DEFAULT_WEIGHT), 1)]
    else:
        sides = [(text.join(weights, "qid"), "text", F.col("w_text"), 0), (vision.join(weights, "qid"), "vision", F.col("w_vision"), 1)]
    every = None
    for hits, name, weight, place in sides:
        one = _side(hits, name, weight, place, own)
        every = one if every is None else every.unionByName(one)
    order = F.array_sort(F.collect_list(F.struct("ord", "list", (F.col("w") / (k + F.col("rank"))).alias("part"))))
    fused = every.groupBy("qid", "source", "page").agg(order.alias("o"), F.min_by("payload", "ord").alias("payload"), F.min("ord").alias("first_ord"))
    total = F.aggregate("o", F.lit(0.0), lambda s, x: s + x["part"])
    return fused.select("qid", "source", "page", total.alias("fused_score"), F.transform("o", lambda x: x["list"]).alias("sources"), "first_ord", "payload.*")


def fused_topk(fused: DataFrame, k: int = K_HYBRID_MODE) -> DataFrame:
    """The k best pages of each query; ties keep the order in which pages were first seen."""
    return ranked(fused, k, by="fused_score", tie="first_ord")
