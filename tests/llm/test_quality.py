import math
import re

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm import common, quality as Q


def test_held_out_ranking_and_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = Q.score(docs, Q.learn(docs, labels), ["doc_id"]).join(labels, "doc_id").where(common.held_out()).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([a > b for a in good for b in bad]) >= 0.97
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) >= 0.9


def test_features_by_hand():
    def of(*texts):
        raw = "".join(texts).encode()
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        place, row = Q.features(np.frombuffer(raw, np.uint8), offsets)
        return [sorted(place[row == i].tolist()) for i in range(len(texts))]

    a, b, c, d = of("x y!!", "X  Y !!", "", "y!!")
    assert a == b and len(a) == 5 and c == [] and len(d) == 3
    assert of("x yz", "z") != of("x y", "zz")
    (same,), (other,) = of("no no"), of("so so")
    assert len(set(same) & set(other)) == 1  # a repeated token is a feature of its own


def test_updates_move_towards_the_label():
    m = Q.Ftrl(3)
    at, x = np.array([0, 2]), np.ones(2)
    for _ in range(20):
        m.update(at, x, 1.0)
    assert Q.sigmoid(float(m.weights(at) @ x)) > 0.8 and m.weights(np.array([1]))[0] == 0


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None), (None, 1), (7, 0), (7, 1)], "doc_id long, quality int")
    rows = Q.score(odd_docs, Q.learn(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    nothing = Q.learn(no_docs, labels.limit(0))
    assert {r.score for r in Q.score(odd_docs, nothing).collect()} == {0.5}
    assert Q.score(no_docs, nothing).count() == 0
    assert Q.score(odd_docs.withColumn("score", F.lit(7)), nothing, ["doc_id", "score"]).columns == ["doc_id", "score"]


M64 = (1 << 64) - 1


def plain_mix(h):
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & M64
    return h ^ h >> 31


def plain_hash(word):
    salt = plain_mix(0x9E3779B97F4A7C15)
    h = plain_mix(len(word) ^ salt)
    if len(word) > 64:
        return h ^ xxhash.xxh3_64_intdigest(word, salt)
    for a in range(0, len(word), 8):
        h = plain_mix(((h ^ int.from_bytes(word[a : a + 8], "little")) * 0xBF58476D1CE4E5B9 + salt) & M64)
    return h


def plain_vector(text):
    """{place: value} of a text, by its tokens and neighbouring pairs."""
    raw = (text or "").encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    own = [plain_hash(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+", lower)]
    pairs = [plain_mix(0x2545F4914F6CDD1D if a == b else (3 * a + 5 * b) & M64) for a, b in zip(own, own[1:], strict=False)]
    counts = {}
    for h in own + pairs:
        counts[h >> 64 - Q.BITS] = counts.get(h >> 64 - Q.BITS, 0) + 1
    n = sum(counts.values())
    return {k: Q.SCALE * c / n for k, c in counts.items()} | {1 << Q.BITS: 1.0}


def test_every_score_against_a_plain_run(spark, small):
    """FTRL-proximal updates and dot products by loops over dicts, on all documents."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    order = [r.doc_id for r in small.where(~common.held_out()).orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").collect()]
    told = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    vectors = {r.doc_id: plain_vector(r.text) for r in small.collect()}
    alpha, beta, l1, l2 = 0.5, 0.1, 0.05, 0.01
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    def chance(x):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight(k) * v for k, v in x.items())))))

    for _ in range(Q.EPOCHS):
        for i in (i for i in order if i in told):
            x = vectors[i]
            w, p = {k: weight(k) for k in x}, chance(x)
            for k, v in x.items():
                g = (p - told[i]) * v
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[k]
                n[k] = old + g * g
    rows = Q.score(small, Q.learn(small, labels)).collect()
    assert len(rows) == len(vectors) and len({r.score for r in rows}) > 50
    assert max(abs(r.score - chance(vectors[r.doc_id])) for r in rows) < 1e-9


def test_one_text_is_learnt_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, t) for t in ("good words", "other words", None)] * 50 + [(3, "bad news")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    some = docs.where("text is null or text <> 'good words'").dropDuplicates()
    first = min((__import__("zlib").crc32((t or "").encode()), t or "") for t in ("good words", "other words", None))[1]
    alone = spark.createDataFrame([(1, first), (3, "bad news")], "doc_id long, text string")
    assert (Q.learn(docs, labels) == Q.learn(alone, labels)).all() and some.count() == 3
