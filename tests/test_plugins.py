"""Errors by row, phrases, observed metrics, the table function and the lookup table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool.operators import evaluate, guard, observe, rewrite
from tidepool.plans import queries
from tidepool.sources import blocks, lookup, storage, udtf

SF = "/root/testdata/sf0.001"


def test_a_plug_in_fails_by_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "qid long, text string")

    def run(row):
        if row["qid"] == 3:
            raise KeyError("no such model")
        return len(row["text"])

    got = guard.guarded(rows, run, "size long").orderBy("qid").collect()
    assert [(r.size, r.error and r.error.split(":")[0]) for r in got] == [(1, None), (None, "TypeError"), (None, "KeyError")]
    wrong = guard.guarded(rows, lambda row: "x", "size long").collect()
    assert all(r.size is None and r.error for r in wrong)
    assert guard.guarded(rows.limit(0), run, "size long").count() == 0


def test_one_raising_question_fails_its_cell_only(spark):
    def answerer(row):
        if row["qid"] == bad:
            raise RuntimeError("the service is down")
        return row["answer"]

    plain = {r.qid: r for r in queries.mode_matrix(spark, SF).collect()}
    bad = next(q for q, r in plain.items() if any(r[m] for m in queries.MODES))
    results = storage.written(queries.mode_results(spark, SF, answerer))
    errors = results.where("error is not null").collect()
    assert {(r.qid, r["mode"]) for r in errors} == {(bad, m) for m in queries.MODES} and all(r.error == "RuntimeError: the service is down" for r in errors)
    got = {r.qid: r for r in evaluate.pass_matrix(results, list(queries.MODES)).collect()}
    assert not any(got[bad][m] for m in queries.MODES)
    assert all(got[q] == r for q, r in plain.items() if q != bad)


def _loop(text, glossary):
    """Phrases by trying all of them at every word."""
    words, out, i = (text or "").split(" "), [], 0
    kept = [bool(re.search(r"\d", w)) for w in words]
    kept = [k or i > 0 and kept[i - 1] and words[i].lower() in rewrite.UNITS for i, k in enumerate(kept)]
    while i < len(words):
        best = None
        for phrase, target in glossary:
            p = phrase.lower().split(" ")
            if [w.lower() for w in words[i : i + len(p)]] == p and not any(kept[i : i + len(p)]) and (best is None or len(p) > best[0]):
                best = (len(p), target)
        out.append(best[1] if best else words[i])
        i += best[0] if best else 1
    return " ".join(out)


def test_phrases_against_a_loop():
    rng = random.Random(2)
    words = ["a", "b", "c", "B", "5", "m", "kg", "", "Q3", "2024", "é"]
    glossary = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))), f"<{i}>") for i in range(12)] + [("m", "metre"), ("5 m", "five"), ("é", "e"), ("kg b", "x")]
    glossary = list(dict(glossary).items())
    run = rewrite.phrase_rewriter(glossary)
    for _ in range(3_000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
        assert run(text) == _loop(text, glossary), text
    assert run(None) == "" and rewrite.phrase_rewriter([])("a b") == "a b"
    assert run("5 m of m") == "5 m of metre"


def test_phrases_of_a_table(spark, monkeypatch):
    q = spark.createDataFrame([(1, "Growth RATE of 5 percent"), (2, None)], "qid long, query string")
    g = spark.createDataFrame([("growth", "x"), ("growth rate", "Wachstumsrate"), ("percent", "Prozent"), (None, "y")], "term string, target string")
    assert {r.qid: r.rewritten_query for r in rewrite.translate_phrases(q, g).collect()} == {1: "Wachstumsrate of 5 percent", 2: ""}
    monkeypatch.setattr(rewrite, "MOST_PHRASES", 2)
    with pytest.raises(ValueError, match="too large"):
        rewrite.translate_phrases(q, g)


def test_metrics_come_from_the_job_that_writes(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    done, told = observe.observed(spark.range(1_000), {"total": F.sum("id")}, storage.written, "job")
    assert told["rows"] == 1_000 and told["total"] == 499_500 and told["seconds"] > 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 2 and done.count() == 1_000


def test_poisson_interval_holds_the_mean_and_shrinks(spark):
    small, large = ([(q, float(q % 3 == 0), 0.25) for q in range(n)] for n in (30, 3_000))
    widths = []
    for rows in (small, large):
        r = evaluate.bootstrap_poisson(spark.createDataFrame(rows, "qid long, a double, b double"), 300).first()
        assert r.low <= r["mean"] <= r.high
        widths.append(r.high - r.low)
    assert 6 < widths[0] / widths[1] < 16  # about the root of a hundred
    assert evaluate.bootstrap_poisson(spark.createDataFrame([], "qid long, a double, b double")).first()["mean"] is None


def test_blocks_as_a_table_function(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    udtf.register(spark)
    blocks.iter_pages(docs).repartition(7).createOrReplaceTempView("some_pages")
    columns = ["source", "page", "block_type", "block_index", "text"]
    want = sorted(map(tuple, blocks.extract_blocks(docs).select(*columns).collect()))
    assert sorted(map(tuple, spark.sql("SELECT * FROM tidepool_blocks(TABLE(some_pages))").select(*columns).collect())) == want
    every = spark.sql("SELECT count(*) FROM tidepool_blocks(TABLE(some_pages), 0)").first()[0]
    assert every == blocks.raw_blocks(docs).count()
    spark.range(3).createOrReplaceTempView("no_pages")
    with pytest.raises(Exception, match="takes a table with source"):
        spark.sql("SELECT * FROM tidepool_blocks(TABLE(no_pages))").collect()


def test_lookups_leave_the_table_where_it_is(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = blocks.iter_pages(docs).select("source", "page", "page_text")
    kept = lookup.bucketed(pages, "source", storage.shared_path(spark, "bucketed"), "kept_pages", 4)
    wanted = spark.createDataFrame([("src0/0", 1), ("src1/21", 1), ("src1/21", 99), ("none", 1)], "source string, page int")
    found = lookup.looked_up(kept, wanted, "source", ("page",))
    want = pages.join(wanted, ["source", "page"]).select("source", "page", "page_text").collect()
    assert sorted(found.select("source", "page", "page_text").collect()) == sorted(want) and want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where what is asked for is large
    try:
        moved = lookup.looked_up(kept, wanted, "source", ("page",))
        lines = moved._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sorted(moved.select("source", "page", "page_text").collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (scan,) = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line]
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert join < scan and not any("Exchange" in line for line in lines[join:scan])
    one = lookup.one(kept, "source", "src1/21")
    assert one.count() == pages.where("source = 'src1/21'").count()
