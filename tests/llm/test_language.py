import numpy as np
import pytest
from pyspark.sql import functions

from tidepool.llm import common, language as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.predict(docs, L.learn(docs)).withColumn("out", common.held_out()).where("out").collect()
    assert len(found) > 200
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def plain_grams(text):
    """The same counts by slices of padded words."""
    out = {}
    parts = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for n in (1, 2, 3):
        for w in parts:
            padded = w if n == 1 else f"\x01{w}\x01"
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip("\x01"):
                    out[g] = out.get(g, 0) + 1
    return out


def test_grams_against_slices(small):
    for r in small.limit(20).collect():
        names, counts = L.grams(r.text)
        got = {}
        for g, n in zip(names.tolist(), counts.tolist(), strict=True):
            points = [g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF]
            got["".join(chr(p) for p in points if p)] = n
        assert got == plain_grams(r.text)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "abc d " * 50
    whole = L.grams(text)
    monkeypatch.setattr(L, "_PIECE", 60)
    assert all(np.array_equal(a, b) for a, b in zip(L.grams(text), whole, strict=True))


def test_distance_by_hand():
    p = L.Profiles({"a": [1 << 3, 2 << 3], "b": [2 << 3, 1 << 3]}, size=2)
    assert p.predict(None) == ("und", 0.0) and p.predict("12 !") == ("und", 0.0)
    assert L.Profiles({}).predict("text") == ("und", 0.0)


def test_odd_documents(odd_docs, no_docs):
    model = L.learn(odd_docs)
    rows = L.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.text is None or r.doc_id in (3, 4, 7)} == {"und"}
    assert L.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in L.predict(odd_docs, L.learn(no_docs)).collect()} == {"und"}
    kept = L.keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert not kept.where("text is null or doc_id = 7").count()


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def plain_rank(counts, size=L.SIZE):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def plain_prediction(text, profiles, size=L.SIZE):
    """Out-of-place distances by loops; the nearest language, the first by name if several are."""
    own = plain_rank(plain_grams(text or ""), size)
    if not own or not profiles:
        return "und", 0.0
    distance = {}
    for lang, ranks in profiles.items():
        distance[lang] = 0
        for place, gram in enumerate(own):
            distance[lang] += abs(ranks[gram] - place) if gram in ranks else size
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (len(own) * size)


def test_every_document_against_loops_over_plain_profiles(spark, small):
    rows = small.withColumn("out", common.held_out()).collect()
    total = {}
    for r in rows:
        if not r.out and r.lang is not None and r.text is not None:
            for g, n in plain_grams(r.text).items():
                own = total.setdefault(r.lang, {})
                own[g] = own.get(g, 0) + n
    profiles = {lang: {g: i for i, g in enumerate(plain_rank(own))} for lang, own in total.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(small, L.learn(small)).collect()}
    assert len(got) == len(rows) > 100
    for r in rows:
        lang, score = plain_prediction(r.text, profiles)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-9


def test_equal_distances_go_to_the_first_language_by_name():
    grams = [code(g) for g in ("a", "\x01a", "a\x01")]
    for names in (("de", "en"), ("en", "de")):
        model = L.Profiles({n: grams for n in names}, size=3)
        assert model.predict("a")[0] == "de"
    near = {"b": [code("a"), code("b")], "a": [code("b"), code("c")]}
    model = L.Profiles(near, size=2)
    assert model.predict("b")[0] == plain_prediction("b", {n: {chr(g): i for i, g in enumerate(v)} for n, v in near.items()}, 2)[0]


def test_every_language_is_learnt(spark):
    """Three hundred invented languages of their own alphabets, none left out."""
    rows = []
    for i in range(300):
        letters = [chr(0x4E00 + 12 * i + j) for j in range(12)]
        for k in range(2):
            rows.append((1_000 * k + i, "".join(letters[(7 * n + k * n * n) % 12] + (" " if n % 4 == 3 else "") for n in range(80)), f"l{i:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.where(~common.held_out())
    want = {r.lang for r in known.collect()}
    assert len(want) > 256
    model = L.learn(docs)
    assert set(model.languages) == want
    got = L.predict(docs, model).where(functions.col("lang").isin(sorted(want))).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_too_many_languages_to_send_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_NUMBERS", 600)
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="values of lang"):
        L.learn(docs)
