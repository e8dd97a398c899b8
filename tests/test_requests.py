"""Requests of any number of images as rows of blocks."""

import json

from tidepool.operators import generate
from tidepool.plans import queries


def test_blocks_make_up_the_request(spark):
    images = generate.image_messages(spark.createDataFrame([(1, r, f"{r}.png", bytearray(b"x%d" % r)) for r in (3, 1, 2, 5, 4)], "qid long, rank int, path string, content binary"))
    q = spark.createDataFrame([(1, 'say "hi"'), (2, None)], "qid long, query string")
    rows = generate.request_blocks(q, images).orderBy("qid", "part", "place").collect()
    for r in generate.vision_requests(q, images).collect():
        body = json.loads(r.body)
        assert [json.loads(x.block) for x in rows if x.qid == r.qid] == body["system"] + body["messages"][0]["content"]


def test_requests_hold_every_page(spark, tmp_path):
    spark.createDataFrame([(i * 2, f"http://a/{i}", f"<p>{i}</p>") for i in range(70)], "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.qid: r for r in queries.vision_requests(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(7)) and all(r.n_images == 10 and r.marked == 3 and r.first == "image,image" for r in got.values())
    assert got[0].question == "Question: http://a/0" and got[2].system_mark == "ephemeral"
