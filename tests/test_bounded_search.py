"""Exact search of term vectors that scores few pairs."""

import numpy as np
import pyarrow as pa

from tidepool.operators import search

WIDTH = 256


def _lists(m):
    row, place = np.nonzero(m)
    cuts = np.searchsorted(row, np.arange(len(m) + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (place, m[row, place])]


def _tables(rng, rows, asks):
    """Words of two languages, some rows without any, some equal."""
    p = 1 / np.arange(1, WIDTH // 2 + 1)
    counts = lambda: np.roll(np.concatenate([rng.multinomial(rng.integers(0, 40), p / p.sum()), np.zeros(WIDTH // 2, int)]), rng.integers(0, 2) * WIDTH // 2)
    m = np.array([counts() for _ in range(rows)])
    m[rng.integers(0, rows, rows // 10)] = m[5]
    return m, np.array([counts() for _ in range(asks)])


def _brute(m, q, k):
    long_, asked = np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    out = []
    for i in range(len(q)):
        dots = m @ q[i]
        some = [(-round(dots[j] / (long_[j] * asked[i]), 6), f"{j:05d}") for j in np.flatnonzero(dots)]
        out += [(i, name, -score) for score, name in sorted(some)[:k]]
    return out


def test_few_pairs_are_scored_and_the_best_are_those_of_all(monkeypatch):
    rng = np.random.default_rng(3)
    m, q = _tables(rng, 6_000, 60)
    monkeypatch.setattr(search, "_TILE", 25)
    monkeypatch.setattr(search, "_HEAD", 40)
    monkeypatch.setattr(search, "_SHARES", 30)
    scored, real = [], search._BestTerms._exact
    monkeypatch.setattr(search._BestTerms, "_exact", lambda self, rows, row, which: scored.append(len(row)) or real(self, rows, row, which))
    best = search._BestTerms(4, pa.array(range(len(q))), *_lists(q), WIDTH)
    columns = [pa.array([f"{i:05d}" for i in range(len(m))]), *_lists(m)]
    for a in range(0, len(m), 1_500):
        best.add(pa.RecordBatch.from_arrays([c.slice(a, 1_500) for c in columns], names=["id", "terms", "tf"]))
    got = pa.Table.from_batches(best.told())
    got = sorted(zip(got["qid"].to_pylist(), (-np.round(got["score"], 6)).tolist(), got["id"].to_pylist(), strict=True))
    assert [(i, name, -score) for i, score, name in got] == _brute(m, q, 4)
    assert sum(scored) < 0.1 * m.shape[0] * q.shape[0]


def test_copies_beyond_k_are_left_out_and_ties_go_by_id(spark):
    left = []
    rows = [(f"{i:03d}", f"same words{' other' if i % 9 == 0 else ''}") for i in range(90)] + [(f"x{i}", "") for i in range(5)]
    corpus = spark.createDataFrame(rows, "id string, text string").repartition(3)
    asks = spark.createDataFrame([(i, "same words" if i % 2 else "other same") for i in range(9)], "qid long, query string")
    plain = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    once = plain(search.text_topk(corpus, asks, 3))
    assert plain(search.text_topk(corpus, asks, 3, block=4)) == once and [r[2] for r in once if r[0] == 1] == ["001", "002", "003"]
    batch = pa.RecordBatch.from_pydict({"_like": [1, 1, 1, 1, 1, 2, 2], "id": list("abcdefg"), "terms": [[1], [1], [1], [2], [2], [2], [2]], "tf": [[1]] * 7})
    copies = search._Copies(2, ["terms", "tf"])
    for a, b in ((0, 2), (2, 6), (6, 7)):
        left += copies.left_out(batch.slice(a, b - a)).column("id").to_pylist()
    assert left == list("abdefg")
