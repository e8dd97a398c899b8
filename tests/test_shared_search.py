"""Plans that ask the same questions several times search once."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import search
from tidepool.plans import modes, queries
from tidepool.sources import storage


def test_variants_search_once(spark, monkeypatch):
    seen, real = [], search._scored
    monkeypatch.setattr(search, "_scored", lambda *a, **b: seen.append(a[2]) or real(*a, **b))
    assert queries._variant_results(spark, "/root/testdata/sf0.001").groupBy("mode").count().count() == 3
    assert seen == [20]


def test_shared_hits_are_those_of_each_search(spark):
    corpus = spark.createDataFrame([(f"{i:03d}", " ".join(f"w{(i * j) % 17}" for j in range(1, 9)), i) for i in range(60)], "id string, text string, n int")
    a = spark.createDataFrame([(1, "w1 w2"), (2, "w1 w2"), (3, "nothing"), (4, None), (5, "")], "qid long, query string")
    b = spark.createDataFrame([(1, "w3"), (9, "w4 w5")], "qid long, query string")
    inner = modes.TextRetriever(corpus)
    shared = modes.SharedRetriever.of(inner, [a, b], 6, storage.written)
    plain = lambda df: sorted((r.qid, r["rank"], r.id, r.score, r.n, r.text) for r in df.collect())
    for q, k in ((a, 6), (a, 2), (b, 4)):
        assert plain(shared.search(q, k)) == plain(inner.search(q, k)) and set(shared.search(q, k).columns) == set(inner.search(q, k).columns)
    with pytest.raises(ValueError):
        shared.search(a, 7)
    with pytest.raises(Exception, match="wasn't searched"):
        shared.search(a.withColumn("query", F.lit("other")), 2).collect()


def test_modes_search_texts_and_patches_once(spark, monkeypatch):
    seen, real = [], search._scored
    monkeypatch.setattr(search, "_scored", lambda *a, **b: seen.append(tuple(a[3])) or real(*a, **b))
    assert queries.mode_traces(spark, "/root/testdata/sf0.001").groupBy("mode").count().count() == 5
    assert sorted(seen) == [("_t",), ("_t",), ("vectors",)]  # blocks, captions, patches


def test_pages_that_no_hit_names_do_not_move(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of {i}" for j in range(45)), "s") for i in range(6)], "doc_id long, text string, source string")
    hits = spark.createDataFrame([(1, 1, "s/2", 3), (1, 2, "s/4", 1), (2, 1, "s/2", 9), (2, 2, None, None)], "qid long, rank int, source string, page int")
    seen = []

    def write(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return storage.written(df)

    pages = queries.blocks.iter_pages(docs)
    plain = lambda df: sorted(map(str, df.select("qid", "rank", "source", "page", "page_text").collect()))
    assert plain(modes.hydrate(hits, pages, write)) == plain(modes.hydrate(hits, pages))
    assert "LeftSemi" in seen[-1]  # the other pages stay where they are


def test_points_of_unique_sources_are_not_told_apart_again(spark, tmp_path, monkeypatch):
    seen, real = [], queries.index.last_of_each
    monkeypatch.setattr(queries.index, "last_of_each", lambda *a, **b: seen.append(a[1]) or real(*a, **b))
    spark.createDataFrame([(1, "growth of revenue in spring")], "item_id long, text string").write.parquet(str(tmp_path / "one/benchmark.parquet"))
    spark.createDataFrame([(1, "growth of revenue in spring")], "item_id long, text string").write.parquet(str(tmp_path / "two/benchmark.parquet"))
    rows = [(1, "growth of revenue in spring\nnothing else is written here", "s"), (2, "growth of revenue in autumn", "s")]
    save = lambda rows, name: spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / name / "documents.parquet"))
    save(rows, "one")
    assert [r.source for r in queries.collection_search(spark, str(tmp_path / "one")).orderBy("rank").collect()] == ["s/1", "s/2"] and seen == ["_v"]  # the scan's alone
    save([*rows, (2, "growth of revenue in summer", "s")], "two")
    got = queries.collection_search(spark, str(tmp_path / "two")).orderBy("rank").collect()
    assert len(got) == len({r.id for r in got}) == 2 and seen == ["_v", None, None, "_v"]
