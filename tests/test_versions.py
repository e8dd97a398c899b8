"""Versions of documents by a keyed stream."""

import datetime
import random

from pyspark.sql import functions as F

from tidepool.sources import storage
from tidepool.streaming import versions
from tidepool.streaming.index_upkeep import points

SCHEMA = "doc_id long, source string, text string, version long, at timestamp"


def _row(doc_id, version, lines, day=None):
    return (doc_id, "s", None if lines is None else "\n".join(lines), version, datetime.datetime(2024, 1, day or version or 1))


def _run(spark, batches, **settings):
    """Each batch as a file of its own, in order; the changes."""
    arriving, changes, progress = (storage.shared_path(spark, n) for n in ("arriving", "changes", "progress"))
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(SCHEMA).parquet(arriving)
        versions.follow(stream, changes, progress, **settings).awaitTermination()  # goes on from its checkpoint
    return spark.read.schema(versions.CHANGES).parquet(changes)


def _line(i, v=""):
    return f"line number {i} {v}".strip()


def test_late_repeated_and_shrunken_versions(spark):
    two = [_line(0), _line(1, "new")]
    three = [_line(i) for i in range(4)]
    changes = _run(spark, [[_row(1, 2, two), _row(2, 1, three)], [_row(1, 1, three), _row(1, 2, two)], [_row(2, 3, [_line(0), _line(2)]), _row(2, 2, None), _row(3, None, two)], [_row(2, 3, [_line(0), _line(2)])]])
    told = [(r.source, r.version, r.deleted, r.block_index, r.text) for r in changes.orderBy("source", "version", "deleted", "block_index").collect()]
    assert [t for t in told if t[0] == "s/1"] == [("s/1", 2, False, 0, _line(0)), ("s/1", 2, False, 1, _line(1, "new"))]
    assert [t[1:4] for t in told if t[0] == "s/2"] == [(1, False, 0), (1, False, 1), (1, False, 2), (1, False, 3), (3, False, 1), (3, True, None), (3, True, None)]
    assert not [t for t in told if t[0] == "s/3"]
    assert sorted(r.text for r in versions.state_of(changes).collect()) == sorted([*two, _line(0), _line(2)])


def test_any_order_of_arrival_gives_the_newest_versions(spark):
    rng = random.Random(5)
    rows = [_row(d, v, [_line(i, rng.choice(["", "a", "b"])) for i in range(rng.randrange(0, 6))] or None) for d in range(12) for v in range(1, 5)]
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    changes = _run(spark, [rows[a : a + 15] for a in range(0, len(rows), 15)])
    newest = spark.createDataFrame([r for r in rows if r[3] == 4], SCHEMA).dropDuplicates(["doc_id"])
    want = sorted((r.id, r.text) for r in points(newest).collect())
    assert sorted((r.id, r.text) for r in versions.state_of(changes).collect()) == want


def test_a_silent_source_is_forgotten(spark):
    changes = _run(spark, [[_row(1, 1, [_line(0)], 1)], [_row(2, 1, [_line(0)], 20)], [_row(2, 2, [_line(1)], 25)], [_row(1, 2, [_line(0)], 25)]], delay="1 day", silent_ms=5 * 86_400_000)
    got = [(r.version, r.deleted) for r in changes.where("source = 's/1'").orderBy("version").collect()]
    assert got == [(1, False), (2, False)]  # its block is told again though it is the same
    assert changes.where(F.col("source") == "s/2").count() == 2
