import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepool.llm import cuckoo, queries

SF = "/root/testdata/sf0.001"


def _keys(n, seed=0):
    rng = random.Random(seed)
    return [rng.randbytes(cuckoo.KEY_BYTES) for _ in range(n)]


def test_filter_holds_what_was_put_in_and_not_deleted():
    f, held, rng = cuckoo.Filter(), set(), random.Random(1)
    keys = _keys(4_000)
    for step in range(20_000):
        k = keys[rng.randrange(len(keys))]
        assert (f.find(k) >= 0) == (k in held)
        if k in held and rng.random() < 0.6:
            assert f.delete(k) >= 0
            held.remove(k)
        elif k not in held:
            assert f.keys[f.insert(k)] == k
            held.add(k)
        if step % 5_000 == 0:
            assert set(f.keys) == held and sum(x > 0 for x in f.prints) == len(held)
    assert f.grown >= 8 and f.delete(b"x" * cuckoo.KEY_BYTES) == -1


def test_overflow_grows_from_the_stored_keys():
    f = cuckoo.Filter(1)
    keys = _keys(1_000)
    for k in keys:
        f.insert(k)
    assert f.grown >= 8 and f.buckets * cuckoo.SLOTS < 4 * len(keys)
    assert [f.keys[f.find(k)] for k in keys] == keys


def test_equal_fingerprints_are_verified_by_content():
    f = cuckoo.Filter(4)
    same = [b"abcdefgh" + bytes([i]) * (cuckoo.KEY_BYTES - 8) for i in range(6)]
    for k in same:
        assert f.find(k) == -1
        f.insert(k)
    assert f.false_hits > 0 and [f.find(k) for k in same] == list(range(6))
    f.delete(same[2])
    assert f.find(same[2]) == -1 and all(f.find(k) >= 0 for k in same if k != same[2])


def test_filter_survives_being_written():
    f = cuckoo.Filter()
    keys = _keys(500)
    for k in keys:
        f.insert(k)
    g = cuckoo.Filter.load(f.buckets, f.prints.tobytes(), f.refs.tobytes(), b"".join(f.keys))
    assert all(g.find(k) == f.find(k) for k in keys)


def _brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in ids:
            here = not kept and i == keep
            kept |= here
            out.append((i, keep, len(ids), here, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_query_against_brute_force_and_sql(spark, small):
    got = _rows(queries.op11_exact_dedup(spark, SF))
    assert got == _brute([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.ORACLE_SQL['op11_exact_dedup']})").fetchall()
    assert got == sorted(want, key=repr)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = cuckoo.classes(odd_docs)
    assert set(odd_docs.columns) - {"text", "kept"} <= set(got.columns)
    assert _rows(got) == _brute(rows)
    assert cuckoo.classes(no_docs).count() == 0 and cuckoo.dedup(no_docs).count() == 0
    kept = cuckoo.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.select("text").collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {t or "" for _, t in rows}


def test_one_text_in_a_third_of_all_rows(spark):
    docs = spark.range(0, 6_000, 1, 16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 2_500).cast("string"))).alias("text"))
    index = cuckoo.CuckooIndex(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert _rows(cuckoo.classes(docs, index=index)) == _brute(rows)
    told = index.statistics().first()
    assert told["keys"] == len({t for _, t in rows}) and told["grown"] > 0 and told["slots"] >= told["keys"]
    # what reaches the shards is aggregated: the hot text comes once from each of 16 partitions
    assert told["hits"] - told["false_hits"] <= 6_000 // 3 * 2


def test_batches_deletion_and_splitting(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = cuckoo.CuckooIndex(spark, shard_keys=8)
    index.shards = 2
    first = [(i, f"t{i % 150}") for i in range(300)]
    assert sum(r.kept for r in cuckoo.classes(docs(first), index=index).collect()) == 150
    assert index.shards >= 4  # 150 keys at most 32 a shard
    assert index.state.agg(F.max("n_keys")).first()[0] <= 32
    # a later batch: a live text stays where its id is larger, a new one and a larger id are kept
    later = {r.doc_id: r for r in cuckoo.classes(docs([(5, "t7"), (1_000, "t8"), (6, "new")]), index=index).collect()}
    assert (later[5].kept, later[5].keep_id, later[5].group_size) == (False, 157, 3)
    assert (later[1_000].kept, later[1_000].keep_id) == (True, 1_000) and later[6].kept
    gone = index.delete(docs([(0, "t7"), (0, "t7"), (0, "never")]))
    assert sorted((r.found, r.group_size) for r in gone.collect()) == [(False, 0), (True, 3)]
    there = {r.text_sha256: r for r in index.contains(docs([(0, f"t{i}") for i in range(150)])).collect()}
    assert sum(r.found for r in there.values()) == 149
    assert not there[hashlib.sha256(b"t7").hexdigest()].found
    again = cuckoo.classes(docs([(3, "t7")]), index=index).first()
    assert again.kept and again.group_size == 1


@pytest.mark.parametrize("text", [None, "", "é" * 100_000])
def test_key_spells_digest_and_length(spark, text):
    key = bytes(spark.createDataFrame([(text,)], "text string").select(cuckoo.content_key(F.col("text"))).first()[0])
    raw = (text or "").encode()
    assert key[:32] == hashlib.sha256(raw).digest() and int.from_bytes(key[32:40], "big") == len(raw) and len(key) == cuckoo.KEY_BYTES
