"""Kept indexes: approximate search by codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import ivfpq, patches, postings, search
from tidepool.plans import queries
from tidepool.sources import storage

SF = "/root/testdata/sf0.1"


def _pairs(df):
    return {(r.qid, r.id) for r in df.collect()}


def test_ivfpq_finds_nine_tenths_reading_few_vectors(spark):
    exact, found = _pairs(queries.cosine_topk(spark, SF)), _pairs(queries.ivfpq_topk(spark, SF))
    recall = len(exact & found) / len(exact)
    corpus, asked = queries._vectors(spark, SF)
    index = ivfpq.IvfPq(spark, storage.shared_path(spark, "ivfpq")).build(corpus.select("id", "vector"))
    n = corpus.count()
    assert len(index.model.centres) == round(n**0.5) and index.model.sizes.sum() == n
    read = index.candidates(asked.select("qid", "vector"), 11, storage.written).groupBy("qid").count().collect()
    share = sum(r["count"] for r in read) / len(read) / n
    print(f"recall {recall:.3f}, share of vectors read for a query {share:.3f}")
    assert recall >= 0.9 and share <= 0.2


def _clusters(spark, n=3_000, d=24):
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(60, d)), n // 60, axis=0) + 0.15 * rng.normal(size=(n, d))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")


def test_kept_index_prunes_lists_on_clusters(spark):
    points = _clusters(spark)
    asked = points.where("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    path = storage.shared_path(spark, "ivfpq")
    ivfpq.IvfPq(spark, path).build(points)
    again = ivfpq.IvfPq(spark, path)  # opened from its files
    exact = _pairs(search.cosine_topk(points, asked, 5))
    found = again.search(asked, 5)
    assert len(exact & _pairs(found)) >= 0.95 * len(exact)
    scores = {(r.qid, r.id): r.score for r in search.cosine_topk(points, asked, 5).collect()}
    assert all(abs(r.score - scores[r.qid, r.id]) < 1e-6 for r in found.collect() if (r.qid, r.id) in scores)
    floors = asked.withColumn("floor", F.lit(0.9))
    more = again._probes(floors, 80, 1 << 30).groupBy("qid").count().collect()
    assert sum(r["count"] for r in more) < 0.2 * len(again.model.sizes) * asked.count()
    # a filter on a list opens its files only
    plan = again.points().where("list = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan


def test_hot_vector_and_useless_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3_000)] + [(10_000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    rows += [(20_000, None), (20_001, []), (20_002, [0.0, 0.0, 0.0]), (20_003, [float("nan"), 1.0, 1.0]), (20_004, [1.0, 2.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    index = ivfpq.IvfPq(spark, storage.shared_path(spark, "ivfpq")).build(points)
    assert index.model.sizes.sum() == 3_300
    asked = spark.createDataFrame([(0, [2.0, 4.0, 6.0]), (1, None), (2, [0.0, 0.0, 0.0])], "qid long, vector array<double>")
    got = index.search(asked, 5).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [(0, i, 1.0) for i in range(5)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, None)]])
def test_tiny_indexes(spark, rows):
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    index = ivfpq.IvfPq(spark, storage.shared_path(spark, "ivfpq")).build(points)
    asked = spark.createDataFrame([(0, [1.0, 1.0])], "qid long, vector array<double>")
    assert [r.id for r in index.search(asked, 3).collect()] == [r[0] for r in rows if r[1]]


def _pages(spark, n=300, patches=8, d=24, spread=0.05):
    rng = np.random.default_rng(6)
    topics = rng.normal(size=(40, d))
    rows = []
    for i in range(n):
        own = topics[rng.integers(0, 40, size=3)][rng.integers(0, 3, size=patches)] + spread * rng.normal(size=(patches, d))
        rows.append((i, own.tolist()))
    asked = [(q, (topics[rng.integers(0, 40, size=3)] + spread * rng.normal(size=(3, d))).tolist()) for q in range(20)]
    kind = "vectors array<array<double>>"
    return spark.createDataFrame(rows, f"id long, {kind}"), spark.createDataFrame(asked, f"qid long, {kind}")


def _scores(df):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())


def test_pruned_late_interaction_is_exact_and_scores_few_pages(spark):
    pages, asked = _pages(spark)
    index = patches.PatchIndex(pages, storage.written)
    assert _scores(index.search(asked, 5)) == _scores(search.maxsim_topk(pages, asked, 5))
    told = index.scored(asked, 5).collect()
    share = sum(r.n for r in told) / len(told) / pages.count()
    print(f"share of pages scored on clustered patches {share:.3f}")
    assert share < 0.3


@pytest.mark.parametrize("spread", [0.5, 3.0])
def test_pruned_late_interaction_is_exact_without_structure(spark, spread):
    pages, asked = _pages(spark, n=120, spread=spread)
    index = patches.PatchIndex(pages, storage.written)
    assert _scores(index.search(asked, 7)) == _scores(search.maxsim_topk(pages, asked, 7))


def test_pruned_late_interaction_of_few_and_odd_pages(spark):
    kind = "vectors array<array<double>>"
    rows = [(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[1.0, 0.0], [0.0, 1.0]]), (3, []), (4, None), (5, [[0.0, 0.0]]), (6, [[-1.0, 0.0], [0.0, 0.0]])]
    asked = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, []), (3, None), (4, [[0.0, 0.0]])], f"qid long, {kind}")
    index = patches.PatchIndex(spark.createDataFrame(rows, f"id long, {kind}"), storage.written)
    assert _scores(index.search(asked, 5)) == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 6, -1.0)]
    none = patches.PatchIndex(spark.createDataFrame([], f"id long, {kind}"), storage.written)
    assert none.search(asked, 5).count() == 0


def _brute_bm25(rows, asked, k):
    import math
    import re
    from collections import Counter

    words = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in rows}
    mean = sum(map(len, words.values())) / max(1, len(words))
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in asked:
        scores = []
        for i, ws in words.items():
            s = 0.0
            for w, times in Counter(x for x in re.split(r"[\W_]+", (text or "").lower()) if x).items():
                tf = ws.count(w)
                if tf:
                    s += times * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if s:
                scores.append((-round(s, 6), i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def _texts(n=4_000):
    rng = np.random.default_rng(8)
    common = ["the", "of", "and", "in", "to"]
    rows = []
    for i in range(n):
        size = int(rng.integers(1, 30))
        rows.append((i, " ".join(common[int(rng.zipf(1.6)) % 5] if rng.random() < 0.6 else f"w{int(rng.zipf(1.3)) % 3000}" for _ in range(size))))
    return rows


def test_postings_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(postings, "RARE", 50)
    rows = _texts() + [(10_000, None), (10_001, ""), (10_002, "?!"), (10_003, "the"), (10_004, "the")]
    asked = [(1, "the w17"), (2, "w2999 w2998 and of"), (3, "the the of"), (4, "unknown"), (5, None), (6, ""), (7, "W1 w2 w3 w4 w5 in"), (8, "w40 W40 w41")]
    index = postings.PostingsIndex(spark, storage.shared_path(spark, "postings"), spark.createDataFrame(rows, "id long, text string").repartition(3)).build(segment=5_000, block=16)  # hot terms lie in many segments
    assert index._table("postings").select("segment").distinct().count() >= 6
    for k in (1, 5, 40):
        got = [(r.qid, r["rank"], r.id, r.score) for r in index.search(spark.createDataFrame(asked, "qid long, query string"), k).orderBy("qid", "rank").collect()]
        assert got == _brute_bm25(rows, asked, k)


def test_rare_terms_read_few_postings(spark):
    rows = _texts(20_000)
    index = postings.PostingsIndex(spark, storage.shared_path(spark, "postings"), spark.createDataFrame(rows, "id long, text string").repartition(3)).build()
    asked = spark.createDataFrame([(i, f"the w{1500 + i} of w{1600 + i}") for i in range(20)], "qid long, query string")
    told = index.reads(asked, 5).collect()
    share = sum(r.n_read for r in told) / sum(r.n_all for r in told)
    print(f"share of postings read for rare terms {share:.4f}")
    assert len(told) == 20 and share < 0.1
    assert index.search(asked, 5).groupBy("qid").count().count() == 20


def test_questions_of_frequent_terms_score_few_texts(spark):
    rows = _texts(4_000)
    index = postings.PostingsIndex(spark, storage.shared_path(spark, "postings"), spark.createDataFrame(rows, "id long, text string").repartition(3)).build(segment=20_000)
    asked = [(i, f"the of and in w{i} w{i + 1} w{i + 2}") for i in range(12)]
    seen = {}

    def write(df, name):
        seen[name] = storage.written(df, name)
        return seen[name]

    got = [(r.qid, r["rank"], r.id, r.score) for r in index.search(spark.createDataFrame(asked, "qid long, query string"), 5, write).orderBy("qid", "rank").collect()]
    assert got == _brute_bm25(rows, asked, 5)
    segments = index._table("postings").select("segment").distinct().count()
    n = seen["candidates"].count()
    print(f"candidates {n} of {len(rows)} texts in {segments} segments")
    assert n <= 2 * 5 * 12 * segments
    plan = index._open(seen["floors"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "generate" not in plan.lower()  # no row for each posting


def test_an_empty_postings_index(spark):
    index = postings.PostingsIndex(spark, storage.shared_path(spark, "postings"), spark.createDataFrame([], "id long, text string")).build()
    assert index.search(spark.createDataFrame([(1, "a")], "qid long, query string"), 5).count() == 0
