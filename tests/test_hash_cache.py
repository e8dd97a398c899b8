"""The memory of hashed tokens is small, whatever the number of tokens."""

from tidepool.operators import search


def test_hashes_are_forgotten():
    held = search._Hashes()
    assert held["a"] == held["a"] and len(held) == 1
    for i in range(60_000):
        held[f"t{i}"]
    assert len(held) <= 50_000
