import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import packing as P


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.tokenizer_path())


ODD = ["", "  ", "a b c\x1cd <|endoftext|>x", "é ́a don't I'LL 12ab\x85q ﬁ İ Σας ΣΑΣ\n\n'S", "<|startoftext|><|endoftext|> ", " lead trail\t", "àÀ ÿŸ Ýĩ. ñÑ, Ķķ ß ĲĳªºÅÅ µ.. Ơơ Ả ẖ H̱ H̱.", "a.b, É. É., 's a's."]


def test_ids_are_the_tokenizer_s(encoder, small, monkeypatch):
    monkeypatch.setattr(P, "_CACHED", 3_000)
    texts = ODD + [r.text for r in small.limit(150).collect()]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(a) for a in encoder.encode_all(texts, most=5_000)] == want
    assert [list(encoder.encode(t)) for t in texts] == want


@pytest.mark.parametrize("kinds", [1, 3, 12, 60])
def test_plan_places_every_piece_without_gaps(kinds):
    rng = random.Random(kinds)
    for _ in range(20):
        capacity = rng.choice([10, 64, 300])
        counts = {rng.randint(1, capacity): rng.randint(1, 200) for _ in range(kinds)}
        runs, bins = P.plan(counts, capacity)
        at = {}
        for n, _, count, each, first, offset in runs.tolist():
            for k in range(count):
                at.setdefault(first + k // each, []).append((offset + k % each * n, n))
        assert sum(map(len, at.values())) == sum(counts.values()) and len(at) == bins
        for parts in at.values():
            end = 0
            for offset, n in sorted(parts):
                assert offset == end
                end += n
            assert end <= capacity
        total = -(-sum(n * c for n, c in counts.items()) // capacity)
        first_fit = _first_fit_decreasing(counts, capacity)
        assert total <= bins <= first_fit * 1.05 + 1


def _first_fit_decreasing(counts, capacity):
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        for i, r in enumerate(rooms):
            if r >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


def check(df, capacity):
    at = {}
    for r in df.collect():
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    return at


@pytest.mark.parametrize("tasks", [1, 9])
def test_whole_table(spark, small, encoder, tasks):
    got = P.pack_documents(small.repartition(tasks), capacity=256)
    check(got, 256)
    texts = {r.doc_id: r.text for r in small.collect()}
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, rows in pieces.items():
        ids = np.append(encoder.encode(texts[d]), 1).astype("<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(-(-len(ids) // 256)))
        for r in rows:
            assert r.start == 256 * r.piece and r.length == len(ids[r.start : r.start + 256])
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + 256].tobytes())


def test_odd_documents(odd_docs, no_docs):
    got = P.pack_documents(odd_docs)
    check(got, 4096)
    assert [(r.length, r.piece) for r in got.where("doc_id in (2, 3, 4)").collect()] == [(1, 0)] * 3
    assert got.select("piece").where("piece = 0").count() == odd_docs.count()
    assert got.where("doc_id = 5").agg(F.sum("length")).first()[0] > 4096
    assert P.pack_documents(no_docs).count() == 0


def test_sequences_hold_the_ids(small, encoder):
    got = P.assemble(P.pack_documents(small.limit(20), with_ids=True))
    assert sum(len(r.ids) for r in got.collect()) == sum(len(encoder.encode(r.text)) + 1 for r in small.limit(20).collect())


def test_equal_pieces_of_one_length_are_ranked_by_their_tasks(spark):
    pieces = spark.range(30_000, numPartitions=12).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 90 + 1).cast("long").alias("length"), F.lit(None).cast("string").alias("offset"), F.lit("x").alias("name"))
    got = P.pack(pieces, 100)
    assert got.columns == ["length", "name", "sequence_id", "offset"]
    at = check(got, 100)
    assert sum(map(len, at.values())) == 30_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    with pytest.raises(ValueError, match="every length"):
        P.pack(pieces, 50)
