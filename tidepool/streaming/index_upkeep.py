"""Index upkeep from a stream of documents: each micro-batch is cut into blocks and upserted by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.functions.ids import block_id
from tidepool.operators.index import Collection, last_of_each
from tidepool.sources.blocks import document_source, extract_blocks


def points(documents: DataFrame) -> DataFrame:
    """The blocks of documents as an index keeps them."""
    blocks = extract_blocks(documents)
    return blocks.select(block_id(F.col("source"), F.col("block_type"), F.col("block_index")).alias("id"), "source", "page", "block_type", "block_index", "text")


def maintain(stream: DataFrame, collection: Collection, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Replays are harmless: ids follow from the blocks, and a batch that runs twice writes the same points.

    order: the column of the stream by which the last version of a document in a batch wins; without one the greatest row does.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        newest = last_of_each(batch.withColumn("_source", document_source()), order, "_source").drop("_source")
        collection.upsert(points(newest), unique=True)  # ids tell sources, types and indices apart, and each source is there once

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
