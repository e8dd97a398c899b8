"""Tokens are hashed without a Python object for each, and as MD5 says."""

import hashlib
import random

import pyarrow as pa

from tidepool.operators import search


def test_heads_are_those_of_md5():
    rng = random.Random(3)
    words = ["", "a", "é", "語", "w" * 55, "w" * 56, "w" * 300, "ß" * 28] + ["".join(rng.choices("abcdefghijkäöü0123456789", k=rng.randint(1, 60))) for _ in range(9_000)]
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    assert search._heads(pa.array(words)).tolist() == want
    assert search._heads(pa.array(words).slice(5, 5_000)).tolist() == want[5:5_005]
    assert search._heads(pa.array([], pa.string())).tolist() == []


def test_short_tokens_are_not_kept():
    search._HASHES.clear()
    counts = search._term_counts(pa.array([["a", "b", "a"], None, [], [f"t{i}" for i in range(500)]], pa.list_(pa.string())), 64)
    assert counts.sum(axis=1).tolist() == [3, 0, 0, 500] and not search._HASHES
