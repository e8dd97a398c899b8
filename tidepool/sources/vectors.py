"""Multi-vector pages and the vectors of question tokens, out of one table of patch vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP, QUERY_TOKENS = 20, 4


def page_patches(embeddings: DataFrame) -> DataFrame:
    """Of each run of 20 vectors the last 16 are the patches of a page, numbered like a document."""
    group, place = F.expr(f"vec_id div {GROUP}"), F.col("vec_id") % GROUP
    return embeddings.where(place >= QUERY_TOKENS).select(group.alias("doc_id"), (place - QUERY_TOKENS).cast("int").alias("patch"), F.col("embedding").alias("vector"))


def question_tokens(embeddings: DataFrame) -> DataFrame:
    """The first 4 vectors of each run are the tokens of a question."""
    group, place = F.expr(f"vec_id div {GROUP}"), F.col("vec_id") % GROUP
    return embeddings.where(place < QUERY_TOKENS).select(group.alias("qid"), place.cast("int").alias("token"), F.col("embedding").alias("vector"))


def multivectors(patches: DataFrame, key: str) -> DataFrame:
    """One row for each key with its vectors in order; a page's patches are few, so the list is bounded."""
    order = "patch" if "patch" in patches.columns else "token"
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("vector").alias("v"))))
    return patches.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias("vectors")).withColumn("n_patches", F.size("vectors"))
