"""The corpus pipeline against a plain restatement of its stages, and the registered queries."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_packing import check
from tests.llm.test_pseudonyms import key, plain as pseudonyms  # noqa: F401  the fixture sets the key
from tidepool.llm import decontaminate, language, packing, queries

SF_DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text).strip(" \t\n\x0b\f\r"))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


def test_run_against_plain_stages(spark, small):
    model = language.learn(small)
    docs = {r.doc_id: r.text for r in small.collect()}
    docs = {i: t for i, t in docs.items() if model.predict(t)[0] != "und" and model.predict(t)[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 10 * both >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = {i: docs[i] for i in ids if find(i) == i}
    items = [(str(r.item_id), decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    auto = decontaminate.Automaton(items, 10)
    left = {}
    for i, t in docs.items():
        words = decontaminate.words_of(t)
        spans, _ = auto.search(words)
        if 2 * (sum(spans[1::2]) - sum(spans[::2])) <= len(words):
            left[i] = pseudonyms(decontaminate._cut(t, spans))
    enc = packing.Encoder(packing.tokenizer_path())
    got = corpus_pipeline.run(spark, SF_DIR)
    check(got, 4096)
    lengths = {}
    for r in got.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(enc.encode(t)) + 1 for i, t in left.items()}
    assert len(lengths) < small.count()


def test_stages_return_the_columns_of_documents(spark, odd_docs, no_docs, tmp_path):
    docs = odd_docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == odd_docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() > 0
        assert stage(spark, no_docs, SF_DIR).count() == 0
    check(corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR), 4096)


def test_every_operator_has_a_query():
    names = entry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF_DIR)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
