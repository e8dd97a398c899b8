"""Exact search of more questions than go beside the rows."""

from tidepool.operators import search


def test_wide_shares_move_rows_once_and_find_what_a_block_finds(spark, monkeypatch):
    rows = [(f"{i:03d}", " ".join(f"w{(i * j) % 17}" for j in range(1, 9)) + (" same" if i % 3 else ""), i) for i in range(90)]
    corpus = spark.createDataFrame(rows, "id string, text string, n int").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 17}" for j in range(4))) for i in range(12)] + [(98, ""), (99, None)], "qid long, query string")
    plain = lambda df: sorted((r.qid, r["rank"], r.id, r.score, r.n) for r in df.collect())
    once = plain(search.text_topk(corpus, queries, 4))
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "WIDE", 20)
    wide = search.text_topk(corpus, queries, 4, block=4)
    told = wide._jdf.queryExecution().optimizedPlan().toString()
    assert once == plain(wide) and len(once) == 48
    assert "explode(sequence(0, 3" not in told and "explode([0,1,2,3])" not in told  # four shares before
    assert plain(search.text_topk(corpus, queries, 4, block=3)) == once  # five shares


def test_rows_are_not_moved_to_one_block(spark):
    corpus = spark.createDataFrame([(i, f"word{i % 5} and more", i) for i in range(50)], "id long, text string, n int").repartition(4)
    found = search.text_topk(corpus.where("n >= 0"), spark.createDataFrame([(1, "word3"), (2, "word4 more")], "qid long, query string"), 3)
    assert [(r.qid, r.id) for r in found.orderBy("qid", "rank").collect()] == [(1, 3), (1, 8), (1, 13), (2, 4), (2, 9), (2, 14)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "_kind" not in plan  # no cells
