import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import neighbours as N


def exact(rows, k=5, ask=lambda i: i % 50 == 0):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if ask(i):
            own = [(-(v @ u) / np.sqrt((v @ v) * (u @ u)), j) for j, u in good if j != i and len(u) == len(v)]
            out[i] = [j for _, j in sorted((round(s, 12), j) for s, j in own)[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append(r.vec_id)
    return out


def test_hadamard_keeps_lengths():
    v = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(N.hadamard(v), axis=1), np.linalg.norm(v, axis=1))
    assert np.allclose(N.hadamard(N.hadamard(v)), v)


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("settings", [{}, {"chunk": 7}, {"fill": 0.1}])
def test_recall(spark, settings):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in e.collect()])
    assert recall(by_query(N.search(e, F.col("vec_id") % 50 == 0, **settings)), want) >= 0.9


@pytest.mark.parametrize("fill", [N.FILL, 20])  # one hash, two hashes
def test_recall_above_a_few_thousand(spark, fill):
    """Loose vectors, a tight cluster of thousands and a few far from it."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    v = np.concatenate([rng.normal(size=(2_500, 32)), centre + 0.05 * rng.normal(size=(3_000, 32)), -centre + rng.normal(size=(20, 32))])
    rows = [(i, x.tolist()) for i, x in zip(rng.permutation(len(v)).tolist(), v, strict=True)]
    want = exact(rows)
    got = by_query(N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, fill=fill))
    assert recall(got, want) >= 0.9 and {len(w) for w in got.values()} == {5}
    far = {i for i, x in rows if np.dot(x, centre) < 0} & set(want)
    assert recall(got, {q: want[q] for q in far}) >= 0.9


def test_ties_among_scaled_copies_go_to_the_smaller_id(spark):
    order = np.random.default_rng(7).permutation(np.arange(1, 101)).tolist()
    rows = [(0, [1.0, 2.0, 3.0, 5.0])] + [(i, [x * 2.0**n for x in (1.0, 2.0, 3.0, 5.0)]) for n, i in enumerate(order, -50)]
    got = by_query(N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


def test_few_vectors_of_another_dimension_are_all_found(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(3_000)] + [(10_000 + i, rng.normal(size=64).tolist()) for i in range(8)] + [(20_000 + 50 * i, rng.normal(size=16).tolist()) for i in range(4)]
    got = by_query(N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    want = exact(rows)
    assert got[10_000] == want[10_000] and all(got[i] == want[i] and len(got[i]) == 3 for i in (20_000, 20_050, 20_100, 20_150))


def test_scores_are_exact(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    for r in N.search(e, F.col("vec_id") % 50 == 0).collect():
        a, b = v[r.query_id], v[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_copies_ties_and_useless_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 130)] + [(200, [2.0, 4.0, 6.0]), (250, [3.0, -1.0, 0.0]), (251, None), (252, []), (253, [0.0, 0.0, 0.0]), (254, [nan, 1.0, 1.0]), (255, [1.0, None, 1.0]), (300, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (350, [1.0, 1.0]), (351, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("q", F.lit("x"))
    got = by_query(N.search(df, F.col("vec_id") % 50 == 0))
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[200] == [0, 1, 2, 3, 4]
    assert got == exact(rows)
    assert got[350] == [351]
    assert not {251, 252, 253, 254, 255, 300} & set(got)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.search(none, F.col("vec_id") % 50 == 0).count() == 0


def test_hashing_leaves_out_what_lies_elsewhere(spark):
    """Tight clusters: nine tenths are found by looking at a small share of the vectors, and no query looks at every one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    v = np.repeat(centres, 50, axis=0) + 0.25 * rng.normal(size=(3_000, 64))
    rows = [(i, x.tolist()) for i, x in zip(rng.permutation(len(v)).tolist(), v, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(by_query(N.search(df, F.col("vec_id") % 50 == 0)), exact(rows)) >= 0.9
    looked = N.candidates(df, F.col("vec_id") % 50 == 0).collect()
    share = sum(r.n for r in looked) / len(looked) / len(rows)
    print(f"tight clusters: share looked at {share:.3f}")
    assert not any(r.whole for r in looked) and share < 0.35


def test_share_on_vectors_without_structure(spark):
    """sf0.1's nearest cosines are about 0.45: hashing leaves out less there, but no query goes to all vectors by rule."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    looked = N.candidates(e, F.col("vec_id") % 50 == 0).collect()
    share = sum(r.n for r in looked) / len(looked) / e.count()
    print(f"sf0.1: share looked at {share:.3f}")
    assert len(looked) == 40 and not any(r.whole for r in looked) and share < 0.95


def test_an_id_that_repeats_is_looked_at_once_for_each_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(7, rng.normal(size=8).tolist()) for _ in range(300)] + [(209, [1.0] * 8)] * 20 + [(211, [1.0] * 8), (213, [1.0] * 8), (211, [2.0] * 8)]
    got = by_query(N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 211))
    assert got[211][:2] == [209, 213] and len(got[211]) == len(set(got[211])) == 5
