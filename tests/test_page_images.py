"""Page images at small memory."""

import struct

from tidepool.sources import blocks


def test_rasters_do_not_leave_their_task(spark):
    long_ = "x" * 30_000
    pages = spark.createDataFrame([("s", i, "\n".join([long_, "a b"])) for i in range(40)] + [("t", 0, "é😀\n\n"), ("t", 1, None)], "source string, page int, page_text string").coalesce(1)
    drawn = blocks.page_images(pages, 2.0)
    assert "ArrowEvalPython" not in drawn._jdf.queryExecution().optimizedPlan().toString() and drawn.columns == ["source", "page", "page_text", "image"]
    got = {(r.source, r.page): struct.unpack(">II", bytes(r.image)[16:24]) for r in drawn.select("source", "page", "image").collect()}
    assert len(got) == 42 and got["s", 7] == (60_000, 4) and got["t", 0] == (4, 6) and got["t", 1] == (2, 2)
