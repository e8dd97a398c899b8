"""Versions of documents as a keyed stream: what each one changes in the index, late and repeated ones dropped.

For each source the state holds its last version and the hash of every block of it, as one value, which is read and written once for each batch. Blocks pass through it as strings and
come out as one row for each source, as there are many small sources and frames or structs for each would cost more than all else. Rows of older or equal versions change
nothing, whenever they come; a newer version gives the blocks that are new or other than before as upserts and those that it
no longer has as deletions. So the changes of a source are in the order of its versions, however its rows arrive, and replayed batches give what they
gave. Rows that are further behind than the watermark are dropped by the engine; state of sources that have been silent for `silent` of event time is
given up, and the next version of such a source gives all of its blocks as upserts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidepool.functions.ids import block_id
from tidepool.functions.text import strip
from tidepool.operators.index import last_of_each
from tidepool.schema import MIN_TEXT_LEN
from tidepool.sources.blocks import block_lists

CHANGES = "source string, id string, version long, deleted boolean, page int, block_type string, block_index int, text string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastVersion(StatefulProcessor):
    """Changes of one source by its versions, as frames: for transformWithStateInPandas."""

    def __init__(self, silent_ms: int | None = None) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, blocks string")  # lines of id and hash

    def named(self, block) -> str:
        """The id and hash of a block, as the state holds them."""
        return f"{block['id']} {block['hash']}"

    def changed(self, told: Iterator[tuple[int, str, list]], timerValues) -> tuple[int, list, list[str]] | None:  # noqa: N803  Spark's name
        """Of rows (version, hash, blocks) of a source, the newest version, its blocks that are new or other than before, and the ids that it no longer has."""
        seen, held = self.last.get() or (None, "")
        newest = None
        for version, hash_, blocks in told:
            if newest is None or (version, hash_) > newest[:2]:  # of one version told twice differently the greater one
                newest = version, hash_, blocks
        if newest is None or seen is not None and newest[0] <= seen:
            return None
        version, _, blocks = newest
        before = set(held.split("\n")) if held else set()
        after = {self.named(b): b for b in blocks}
        ids = {name.split(" ")[0] for name in after}
        gone = [i for i in (name.split(" ")[0] for name in before - after.keys()) if i not in ids]
        self.last.update((version, "\n".join(after)))
        if self.silent_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.silent_ms)
        return version, [b for name, b in after.items() if name not in before], gone

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        told = ((int(version), hash_, blocks) for b in rows for version, hash_, blocks in zip(b["version"], b["hash"], b["blocks"], strict=True))
        version, blocks, gone = self.changed(told, timerValues) or (0, [], [])
        changes = [(key[0], b["id"], version, False, int(b["page"]), b["block_type"], int(b["block_index"]), b["text"]) for b in blocks]
        changes += [(key[0], i, version, True, None, None, None, None) for i in gone]
        if changes:
            yield pd.DataFrame(changes, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"page": "Int32", "block_index": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class PackedVersions(LastVersion):
    """The same over rows whose blocks are strings (packed): a row for each source that changed, and no frame is made for any source."""

    def named(self, block: str) -> str:
        return block[:_NAMED]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        version, blocks, gone = self.changed(((r["version"], r["hash"], r["blocks"]) for r in rows), timerValues) or (0, [], [])
        if blocks or gone:
            yield Row(source=key[0], version=version, changed=blocks, gone=gone)


_NAMED = 36 + 1 + 32  # characters of an id, a space and an MD5


def packed(block: Column) -> Column:
    """A block of hashed_blocks() as one string: id, hash, page, type, index and text, which may hold anything, after single spaces."""
    return F.concat_ws(" ", block["id"], block["hash"], block["page"].cast("string"), block["block_type"], block["block_index"].cast("string"), block["text"])


def unpacked(told: DataFrame) -> DataFrame:
    """Changes (CHANGES) of rows (source, version, changed, gone)."""
    rest = F.split(F.substr(F.col("b"), F.lit(_NAMED + 2)), " ", 4)
    new = F.transform("changed", lambda b: F.struct(F.substring(b, 1, 36).alias("id"), F.lit(False).alias("deleted"), b.alias("b")))
    old = F.transform("gone", lambda i: F.struct(i.alias("id"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("b")))
    rows = told.select("source", "version", F.inline(F.concat(new, old))).withColumn("r", rest)
    return rows.select("source", "id", "version", "deleted", F.col("r")[0].cast("int").alias("page"), F.col("r")[1].alias("block_type"), F.col("r")[2].cast("int").alias("block_index"), F.col("r")[3].alias("text"))


def hashed_blocks(documents: DataFrame, min_len: int = MIN_TEXT_LEN) -> DataFrame:
    """documents (doc_id, source, text, version, at) as rows of the stream: source, version, at, hash of all, and blocks with ids and hashes."""
    listed = block_lists(documents, keep=("version", "at"))
    text = F.transform("blocks", lambda x: F.struct(block_id(F.col("source"), x["block_type"], x["block_index"]).alias("id"), strip(x["raw"]).alias("text"), x["page"].alias("page"), x["block_type"].alias("block_type"), x["block_index"].alias("block_index")))
    kept = F.filter(text, lambda x: F.char_length(x["text"]) >= min_len)
    told = F.transform(kept, lambda x: F.struct(x["id"].alias("id"), F.md5(x["text"]).alias("hash"), x["page"].alias("page"), x["block_type"].alias("block_type"), x["block_index"].alias("block_index"), x["text"].alias("text")))
    rows = listed.where(F.col("version").isNotNull()).select("source", F.col("version").cast("long").alias("version"), "at", told.alias("blocks"))
    return rows.withColumn("hash", F.md5(F.array_join(F.transform("blocks", lambda x: x["hash"]), "")))


def follow(stream: DataFrame, changes: str, checkpoint: str, delay: str = "30 days", silent_ms: int | None = None, **trigger) -> StreamingQuery:
    """Write the changes that a stream of documents (doc_id, source, text, version, at) makes to the Parquet folder `changes`.

    State is kept in RocksDB, so it isn't bound by memory; the setting for it is the query's alone.
    """
    spark = stream.sparkSession
    rows = hashed_blocks(stream).withColumn("blocks", F.transform("blocks", packed)).withWatermark("at", delay).groupBy("source")
    told = unpacked(rows.transformWithState(PackedVersions(silent_ms), "source string, version long, changed array<string>, gone array<string>", "append", "eventTime"))
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:  # a query takes the session's settings when it starts
        return told.writeStream.format("parquet").option("path", changes).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def state_of(changes: DataFrame) -> DataFrame:
    """The blocks that are there after all changes."""
    return last_of_each(changes, "version", "id").where("not deleted").drop("deleted")
