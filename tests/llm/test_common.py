"""Hashes, sampling shares, shared folders and row numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import common as C
from tidepool.llm import language, quality, simhash


def hashes(text, seed=0):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = C.word_spans(C.IS_DARK[data], np.array([0, len(data)]))
    return C.words_hash(data, starts, ends, seed)


def test_equal_words_and_only_those_hash_alike():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("ab\u00e9"), rng.integers(1, 90))) for _ in range(5_000)]
    got = hashes(" ".join(words)).tolist()
    assert len(set(got)) == len(set(words)) == len(set(zip(words, got, strict=True)))
    assert hashes(words[0])[0] == got[0] and hashes(words[0], 1)[0] != got[0]
    assert len(hashes(" \t ")) == 0


def test_runs_hash_depends_on_the_words_of_the_run_alone():
    words = hashes(" ".join("abcdefghij"[i * i % 10] for i in range(200)))
    for width in (1, 5, 12, 35):
        whole = C.runs_hash(words, width)
        assert len(whole) == 200 - width + 1
        assert (whole == C.runs_hash(words, width, step=17)).all()
        assert all(C.runs_hash(words[i : i + width], width)[0] == whole[i] for i in (0, 3, 100))
    assert len(C.runs_hash(words[:3], 5)) == 0


def test_shares_of_very_large_tables_are_not_rounded_to_nothing(spark):
    ids = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    assert 800 < ids.where(C.sampled(F.col("h"), 1_000 * 50_000, 10**10)).count() < 1_200
    assert ids.where(C.sampled(F.col("h"), 5, 5)).count() == 200_000
    table = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    got = {r.lang: r["count"] for r in table.where(language.sample_of({"en": 10**10, "de": 1_000}, 10**8)).groupBy("lang").count().collect()}
    assert got["de"] == 100_000 and 800 < got["en"] < 1_200


def test_learning_goes_on_where_a_language_has_billions_of_documents(spark, small, monkeypatch):
    monkeypatch.setattr(language, "sampled", lambda place, wanted, total: C.sampled(place, wanted * 10**8, total * 10**8))
    assert language.learn(small, per_language=10).languages
    monkeypatch.setattr(quality, "sampled", lambda place, wanted, total: C.sampled(place, wanted * 10**9, total * 10**9))
    assert np.count_nonzero(quality.learn(small, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), max_train=40))


def test_no_machine_s_own_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Cluster()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        C.shared_dir(Session())
    Cluster.master = "local[4]"
    assert C.shared_dir(Session()).startswith("file:")


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        simhash.components(edges, rounds=1)


def test_numbers_are_written_unless_rows_come_straight_from_files(spark, small):
    assert "Exchange" not in C.numbered(small.where("doc_id > 3").select("text"), "t")._jdf.queryExecution().toString()
    for df in (small.repartition(3), small.withColumn("r", F.rand()), small.groupBy("lang").count()):
        kept = C.numbered(df, "t")
        assert kept.inputFiles() and C.shared_dir(spark).rpartition("/")[2] in kept.inputFiles()[0]


def test_tables_of_earlier_stages_can_be_dropped(spark):
    first = C.tables_written()
    a, b = (C.materialise(spark.range(3), "t") for _ in "ab")
    C.drop_since(first, b)
    assert b.count() == 3 and C.tables_written() == first + 1
    with pytest.raises(Exception, match="(?i)not exist|found"):
        a.count()
