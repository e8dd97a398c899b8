import hashlib
import random
import re

import pytest

from tidepool.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        n = min(window, len(own))
        for s in range(len(own) - n + 1) if n else ():
            for i in range(len(doc) - n + 1):
                if doc[i : i + n] == own[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        window, text = rng.randint(2, 5), " ".join(rng.choice("abcz") for _ in range(rng.randint(0, 40)))
        spans, found = D.Automaton([(n, D.words_of(t)) for n, t in items], window).search(D.words_of(text))
        want = plain(text, items, window)
        assert (sum(spans[1::2]) - sum(spans[::2]), len(found)) == want[1:3]
        assert all(a < b for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("shard_bytes", [D.SHARD_BYTES, 2_000])
def test_whole_table_against_brute_force(spark, small, shard_bytes):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    texts = {r.doc_id: r.text for r in small.collect()}
    got = D.contamination(small, bench, shard_bytes=shard_bytes).collect()
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got:
        assert tuple(r)[1:] == plain(texts[r.doc_id], items, 10)


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "The CAT sat on the mat and the dog ran"), (1, "off with it"), (None, "the dog"), (2, None), (3, " ")], "item_id long, text string")
    rows = D.contamination(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r.n_hit, r.n_items) for r in rows if r.contaminated) == [(13, 1)] * 3
    assert [(r.n_words, r.n_hit) for r in rows if r.doc_id == 2] == [(0, 0)]
    assert D.contamination(no_docs, bench).count() == 0
    assert not [r for r in D.contamination(odd_docs, bench.limit(0)).collect() if r.contaminated]


@pytest.mark.parametrize("shard_bytes", [D.SHARD_BYTES, 80])
def test_removal(spark, odd_docs, shard_bytes):
    bench = spark.createDataFrame([(1, "on the mat"), (2, "never seen")], "item_id long, text string")
    got = D.decontaminate(odd_docs, bench, shard_bytes=shard_bytes)
    assert got.columns == odd_docs.columns
    assert sorted(str(r.text) for r in got.where("doc_id = 1").collect()) == ["the cat sat  and the dog ran off with it"] * 2
    assert got.count() == odd_docs.count()
    assert D.decontaminate(odd_docs, bench, max_coverage=0.1).where("doc_id = 1").count() == 0
    assert D.contamination(got, bench).where("contaminated").count() == 0


def test_text_around_a_span_stays():
    text = "Ä, one-TWO; three!  (four)"
    assert D._cut(text, [1, 3]) == "Ä, ; three!  (four)"


@pytest.mark.parametrize("shards", [1, 50, 100])
def test_documents_are_read_once_whatever_the_benchmark_s_size(spark, shards):
    rng = random.Random(shards)
    vocabulary = [f"v{i}" for i in range(400)] + ["a", "b", "c"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 40])))) for i in range(300)]
    items = [(n, t) for n, t in items if len(t.split()) > 1 or n.endswith("7")]
    texts = []
    for _ in range(150):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own) + 1)
            parts += [" ".join(own[a : a + rng.randint(3, 30)]), " ".join(rng.choices(vocabulary, k=5))]
        texts.append(" ".join(parts))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).mapInArrow(counted, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    size = sum(len(t) + 64 for _, t in items)
    got = D.contamination(docs, bench, shard_bytes=-(-size // shards)).collect()
    assert read.value == len(texts)
    assert sum(r.contaminated for r in got) > 50
    for r in got:
        assert tuple(r)[1:] == plain(texts[r.doc_id], items, 10)
