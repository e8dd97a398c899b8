import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepool.llm import simhash as S


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, radius=3):
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            m = min(label[j] for j in np.flatnonzero(near[i]))
            if m < label[i]:
                label[i], changed = m, True
    least = {}
    for i, l in enumerate(label):
        if ids[i] is not None:
            least[l] = min(least.get(l, ids[i]), ids[i])
    return [least.get(l) for l in label]


def test_fingerprints(monkeypatch, small):
    monkeypatch.setattr(S, "_PIECE", 7)
    for t in [None, "", " \t", "one", "One TWO", "a b c", "a b c d", "É é x\x0by z"] + [r.text for r in small.limit(15).collect()]:
        assert S.fingerprint_of(t) == plain_fingerprint(t)


def test_the_engine_s_hash_is_the_same(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b ç"))).first()[0]
    assert h & 0xFFFFFFFFFFFFFFFF == xxhash.xxh64_intdigest("a b ç".encode(), 42)


@pytest.mark.parametrize("split", [20_000, 3])
def test_links_join_all_that_are_near(spark, split):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1}
    for _ in range(200):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long").select(F.col("fp").alias("node"), "fp")
    found = {r.node: r.root for r in S.components(S.links(nodes, 3, split=split)).collect()}
    got = [found.get(S._signed(x), S._signed(x)) for x in fps]
    want = components(fps, [S._signed(x) for x in fps])
    assert got == want


def test_chains_and_stars_become_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100)
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(small):
    rows = sorted(small.collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text) for r in rows]
    want = components(fps, [r.doc_id for r in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(small).collect()}
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)}


def test_odd_documents(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted((str(r.doc_id), f"{f:016x}", c) for r, f, c in zip(rows, fps, components(fps, [r.doc_id for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(odd_docs).collect()) == want
    assert S.near_duplicates(no_docs).count() == 0


def test_near_dedup_keeps_one_of_each(spark, odd_docs, no_docs):
    kept = S.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7, 8, 9, 10]
    assert S.near_dedup(no_docs).count() == 0
    rng = random.Random(1)
    texts = [[f"w{rng.randrange(500)}" for _ in range(300)] for _ in range(12)]
    near = [t[:70] + ["new"] + t[71:200] + ["words"] + t[201:] for t in texts[:6]]
    half = [t[:150] + [f"v{rng.randrange(500)}" for _ in range(150)] for t in texts[6:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + near + half + texts[:2])], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.near_dedup(docs).collect()) == [*range(12), *range(18, 24)]


def edited(t, kind, words):
    n = len(t)
    return {
        "scattered": lambda: [w if i % 50 else next(words) for i, w in enumerate(t)],
        "appended": lambda: t + [next(words) for _ in range(n * 18 // 100)],
        "led": lambda: [next(words) for _ in range(n * 18 // 100)] + t,
        "truncated": lambda: t[: n * 84 // 100],
        "replaced": lambda: t[: n // 3] + [next(words) for _ in range(n * 8 // 100)] + t[n // 3 + n * 8 // 100 :],
    }[kind]()


def grams(t):
    return {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}


def similarity(t, u):
    a, b = grams(t), grams(u)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("kind", ["scattered", "appended", "led", "truncated", "replaced"])
def test_near_dedup_finds_copies_wherever_they_differ(spark, kind):
    rng = random.Random(kind)
    words = iter(lambda: f"w{rng.randrange(3000)}", None)
    pairs = []
    while len(pairs) < 200:
        t = [next(words) for _ in range(rng.randint(60, 600))]
        u = edited(t, kind, words)
        if similarity(t, u) >= 0.8:
            pairs.append((t, u))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([t for t, _ in pairs] + [u for _, u in pairs])], "doc_id long, text string")
    kept = {r.doc_id for r in S.near_dedup(docs).collect()}
    assert kept >= set(range(200))
    recall = (400 - len(kept)) / 200
    assert recall >= 0.97, recall


def test_near_dedup_keeps_what_shares_less(spark):
    rng = random.Random(5)
    words = iter(lambda: f"w{rng.randrange(3000)}", None)
    texts = []
    for _ in range(200):
        t = [next(words) for _ in range(rng.randint(60, 600))]
        texts += [t, t + [next(words) for _ in range(len(t) * rng.randint(27, 40) // 100)]]
    assert all(0.65 < similarity(t, u) < 0.8 for t, u in zip(texts[::2], texts[1::2], strict=True))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert S.near_dedup(docs).count() == 400


@pytest.mark.parametrize(("large", "split"), [(64, 10_000), (5, 10_000), (5, 6)])
def test_links_join_what_shares_enough(spark, large, split):
    rng = random.Random(6)
    words = iter(lambda: f"w{rng.randrange(3000)}", None)
    base = [next(words) for _ in range(200)]
    texts = [base[:60] + [next(words) for _ in range(k)] + base[60 + k :] for k in range(1, 15)] + [base[:145], base[:140] + [next(words) for _ in range(25)]]
    texts += [[next(words) for _ in range(200)] for _ in range(3)]
    hashes = [S.shingles(np.array([xxhash.xxh64_intdigest(w) for w in t], np.uint64)) for t in texts]
    rows = [(i, bytearray(S._sketch(h, h)[1]), S.subset_keys(h).view(np.int64).tolist(), bytearray(h.tobytes())) for i, h in enumerate(hashes)]
    nodes = spark.createDataFrame(rows, "node long, wide binary, keys array<long>, shingles binary")
    found = S.proposed(nodes, 64, split)
    assert {r.node for r in found.collect()} >= set(range(14)) and not {r.node for r in found.collect()} & {16, 17, 18}
    joined = {r.node: r.root for r in S.components(S.confirmed(nodes.join(found, "node"), 64, 80, large, split)).collect()}
    got = [joined.get(i, i) for i in range(len(texts))]
    want = list(range(len(texts)))
    for _ in want:
        want = [min(want[j] for j, u in enumerate(texts) if similarity(t, u) >= 0.8) for t in texts]
    assert got == want


def test_equal_values_share_a_node_of_the_tree():
    import time

    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        tree = S.Tree([5] * n + [6])
        assert len(list(tree.chains(3))) == n and len(tree.value) == 2
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.01)  # four times as many: linear, not quadratic


def test_permutations_of_one_word_set(spark):
    """Thousands of texts of the same words in other orders share no shingle and all stay."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(3_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert S.near_dedup(docs).count() == 3_000
