import hashlib
import random
from collections import Counter

import pytest

from tidepool.llm import substrings as S


def plain(texts, length=35):
    words = [(t or "").encode().split() for t in texts]
    times = Counter(b" ".join(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        hit = {j for i in range(len(w) - length + 1) if times[b" ".join(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = [x for j, x in enumerate(w) if j not in hit]
        out.append((len(w), len(hit), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def told(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_whole_table(small, hot):
    rows = small.collect()
    want = sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True))
    got = told(S.dedup(small, hot=hot))
    assert got == want and sum(w[2] for w in want) > 0


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_small_words_and_periods(spark, tmp_path, hot):
    rng = random.Random(4)
    texts = ["a " * 50, "a b " * 30, "x y z " * 13, "only once here", " ".join(map(str, range(60))), " ".join(map(str, range(30, 75)))]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = docs.collect()
    for length, seed in ((35, 12), (8, 3), (5, 5)):
        want = sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows], length), strict=True))
        assert told(S.dedup(docs, length, seed, hot)) == want


def test_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = S.dedup(odd_docs)
    assert told(got) == sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True))
    assert {r.kept for r in got.where("doc_id = 9").collect()} == {r.text for r in rows if r.doc_id == 9}
    assert S.dedup(no_docs).count() == 0


def test_words_that_polynomials_confuse_are_told_apart(spark):
    """The Thue-Morse word and its complement agree under every polynomial hash modulo 2**64 with an odd base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{common} {one}"), (2, f"{common} {other}"), (3, f"{one} {other} " * 20), (4, " ".join([*(f"a{i}" for i in range(10)), *(["x", "y"] * 20)]))], "doc_id long, text string")
    rows = docs.collect()
    assert told(S.dedup(docs)) == sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True))
    assert {r.doc_id: r.n_removed for r in S.dedup(docs).collect()}[1] == 0


def test_rows_in_another_order_each_time_are_written_first(spark, small):
    mixed = small.repartition(3).orderBy("n_chars").limit(200)
    rows = mixed.collect()
    assert S.dedup(mixed).count() == len(rows) == 200


def test_a_window_in_all_documents_is_counted_by_partial_aggregates(spark, tmp_path):
    """One passage in 3,000 documents, alone in its slice in 40 of them: no task holds its places."""
    passage = " ".join(f"licence{i}" for i in range(40))
    texts = [f"{i} {passage} {i + 1} {'own' * (i % 3)}{i}" for i in range(3000)] + [f"{'x' * 600_000}{i} {passage}" for i in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = docs.collect()
    want = sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True))
    assert told(S.dedup(docs)) == want and {w[2] for w in want} == {40}
    _, spans = S.repeats(docs)
    plan = spans._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "windows-again" in plan
