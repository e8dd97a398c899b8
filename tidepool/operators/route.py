"""The keyword router: how much a question weighs text and page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import contains_any
from tidepool.schema import CHART_KEYWORDS, PROSE_KEYWORDS, TABLE_KEYWORDS


def _decision(w_text: float, w_vision: float, rationale: str) -> Column:
    return F.struct(F.lit(w_text).alias("w_text"), F.lit(w_vision).alias("w_vision"), F.lit(rationale).alias("rationale"))


def decide(query: Column) -> Column:
    """A struct (w_text, w_vision, rationale); keywords count inside words too, the first rule that fits wins."""
    chart, table, prose = (contains_any(query, words) for words in (CHART_KEYWORDS, TABLE_KEYWORDS, PROSE_KEYWORDS))
    return (
        F.when(chart & ~prose, _decision(0.3, 0.7, "chart-leaning"))
        .when(table & ~prose, _decision(0.5, 0.5, "table — both useful"))
        .when(prose & ~chart & ~table, _decision(0.7, 0.3, "prose-leaning"))
        .otherwise(_decision(0.5, 0.5, "balanced (default)"))
    )


def route(queries: DataFrame) -> DataFrame:
    """queries (qid, query) with w_text, w_vision and rationale."""
    return queries.withColumn("_d", decide(F.coalesce("query", F.lit("")))).select(*queries.columns, "_d.*")


def share(routed: DataFrame) -> DataFrame:
    """How often each decision was taken."""
    counted = routed.groupBy("rationale").agg(F.count("*").alias("n"))
    total = routed.agg(F.count("*").alias("total"))
    return counted.join(F.broadcast(total), F.lit(True)).select("rationale", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
