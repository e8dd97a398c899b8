"""Text files as a data source."""

import os

from pyspark.sql import functions as F

from tidepool.sources import blocks, files

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((r.source, r.page, r.page_text) for r in df.select("source", "page", "page_text").collect())


def _pushed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_give_the_pages_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = str(tmp_path / "files")
    told = files.write_documents(docs, root).agg(F.sum("files"), F.sum("bytes")).first()
    assert told[0] == docs.count() and told[1] == docs.agg(F.sum(F.octet_length("text"))).first()[0]
    want = _rows(blocks.iter_pages(docs))
    assert _rows(files.read_pages(spark, [root])) == want
    assert _rows(files.read_pages(spark, ["file://" + root])) == want
    back = files.read_documents(spark, [root])
    assert sorted((int(r.doc_id), r.source, r.text) for r in back.collect()) == sorted((r.doc_id, r.source, r.text) for r in docs.collect())


def test_a_filter_on_one_source_opens_one_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "\n".join(f"line {i} {j}" for j in range(50))) for i in range(60)], "doc_id long, source string, text string")
    root = str(tmp_path / "files")
    files.write_documents(docs, root).collect()
    wanted = "s1/4"
    for d, _, names in os.walk(root):  # every other file is no text: reading one shows as an error
        for n in names:
            if files.source_of(f"{d}/{n}") != wanted:
                with open(f"{d}/{n}", "wb") as f:
                    f.write(b"\xff\xfe")
    pages = files.read_pages(spark, [root])
    assert pages.where("error is not null").count() == 59
    one = pages.where(F.col("source") == wanted)
    assert [(r.source, r.page, r.error) for r in one.orderBy("page").collect()] == [(wanted, 1, None), (wanted, 2, None), (wanted, 3, None)]
    second = one.where("page = 2").collect()
    assert [(r.page, r.page_text.split("\n")[0]) for r in second] == [(2, "line 4 20")]
    reader = files._Reader([root], "pages", 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("source",), wanted), In(("page",), (1, 3)), GreaterThan(("page",), 0)]))
    assert left == [GreaterThan(("page",), 0)]
    (run,) = reader.partitions()
    assert run.paths == [(f"{root}/{files.path_of(wanted)}", wanted)]
    assert [r[1] for r in reader.read(run)] == [1, 3]


def test_missing_paths_and_names_of_any_kind(spark, tmp_path):
    odd = ["", "a/b", "ä ö?", "..", "%2F", "x.txt"]
    docs = spark.createDataFrame([(i, s, None if i == 0 else f"text {i}") for i, s in enumerate(odd)] + [(99, None, "t")], "doc_id long, source string, text string")
    root = str(tmp_path / "files")
    files.write_documents(docs, root).collect()
    plain = tmp_path / "notes.txt"
    plain.write_text("one\ntwo")
    got = files.read_pages(spark, [root, str(plain), str(tmp_path / "none.txt")]).collect()
    assert {(r.source, r.page_text) for r in got if not r.error} == {(r.source, r.page_text) for r in blocks.iter_pages(docs).collect()} | {(str(plain), "one\ntwo")}
    assert [(r.source, r.error) for r in got if r.error] == [(str(tmp_path / "none.txt"), "no such file")]
