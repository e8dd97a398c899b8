"""What upkeep moves."""

from tidepool.operators import index
from tidepool.sources import storage
from tidepool.streaming.index_upkeep import maintain, points


def test_points_of_a_batch_are_not_deduplicated_again(spark, tmp_path, monkeypatch):
    rows = [(1, "a line of twenty characters and more", "s"), (1, "b line of twenty characters and more", "s"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    c = index.Collection(spark, storage.shared_path(spark, "upkeep"), points(docs).schema)
    keys, plain = [], index.last_of_each
    monkeypatch.setattr(index, "last_of_each", lambda points, order=None, key="id", ties=True: keys.append(key) or plain(points, order, key, ties))
    maintain(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "progress")).awaitTermination()
    assert not keys and [r.text[0] for r in c.scan().collect()] == ["b"]
