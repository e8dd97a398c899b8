"""Sources, the wire format, the streaming path and what tests of it need."""

import base64
import struct
import urllib.error
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import vector
from tidepool.operators import evaluate, generate, trace
from tidepool.operators.index import Collection
from tidepool.plans import modes
from tidepool.sources import blocks, embedding_service, vectors
from tidepool.sources.embedding_server import EmbeddingServer, hashed_vectors
from tidepool.streaming import index_upkeep


def test_missing_files_are_told_and_skipped(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    found, missing = blocks.read_files(spark, [str(tmp_path / "a.bin"), str(tmp_path / "b.bin")])
    assert found.first().content == b"abc" and missing == [str(tmp_path / "b.bin")]
    assert blocks.read_files(spark, [str(tmp_path / "b.bin")])[0] is None


def test_tables_become_markdown(spark):
    docs = spark.createDataFrame([(1, "a | b\n1|2|3\ntext\n| x | y |\n| only |\n| x | y |\nend", "s"), (2, None, "s"), (3, "none", "s")], "doc_id long, text string, source string")
    got = [(r.first_line, r.n_rows, r.markdown) for r in blocks.table_markdown(docs).orderBy("first_line").collect()]
    assert got == [(0, 2, "| a | b |\n| --- | --- |\n| 1 | 2 |"), (3, 3, "| x | y |\n| --- | --- |\n| only |  |\n| x | y |")]


def test_html(spark):
    html = "<h1>A heading here</h1><script>var p='<p>not this one at all</p>'</script><p class='x'>Some <b>bold</b> words</p><!-- <li>nor this one here</li> --><li>short</li>"
    got = blocks.html_blocks(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string"))
    assert [(r.block_index, r.text) for r in got.orderBy("block_index").collect()] == [(0, "A heading here"), (1, "Some bold words")]


def test_wire_round_trip(spark):
    df = spark.createDataFrame([(1, [1.0, 0.5, -2.0, 0.25]), (2, None)], "i int, v array<float>")
    got = df.select("i", vector.from_wire(vector.to_wire("v"), F.array(F.lit(2), F.lit(2))).alias("m")).orderBy("i").collect()
    assert got[0].m == [[1.0, 0.5], [-2.0, 0.25]] and got[1].m is None


def test_embedding_service(spark):
    class FakeClient:
        def embed_queries(self, queries):
            assert len(queries) <= 8
            return [{"shape": [1, 2], "embedding_b64": base64.b64encode(np.array([len(q), 1], np.float16).tobytes()).decode()} for q in queries]

    q = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(20)], "qid long, query string")
    got = embedding_service.embed_queries(q, FakeClient).collect()
    assert {r.qid: r.vectors for r in got} == {i: [[i + 1.0, 1.0]] for i in range(20)}
    with pytest.raises(Exception, match="blank"):
        embedding_service.embed_queries(spark.createDataFrame([(1, " ")], "qid long, query string"), FakeClient).collect()


def test_multivectors_keep_order(spark):
    p = spark.createDataFrame([(1, 2, [2.0]), (1, 1, [1.0])], "doc_id long, patch int, vector array<double>")
    assert vectors.multivectors(p, "doc_id").first().vectors == [[1.0], [2.0]]


def test_media_types(spark):
    paths = [("a.JPG", "image/jpeg"), ("x/b.webp", "image/webp"), ("c.bmp", "image/png"), ("dir.d/e", "image/png")]
    df = spark.createDataFrame([(1, i, p, bytearray(b"x" * 100)) for i, (p, _) in enumerate(paths, 1)], "qid long, rank int, path string, content binary")
    got = generate.image_messages(df).orderBy("rank").collect()
    assert [r.media_type for r in got] == [k for _, k in paths]
    assert [r.cached for r in got] == [True, True, True, False]
    assert got[0].data == base64.b64encode(b"x" * 100).decode()


def test_stream_upserts_and_replays_do_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a line that is long enough\nanother line, long too", "s")], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    schema = index_upkeep.points(docs).schema
    c = Collection(spark, str(tmp_path / "index"), schema)
    for checkpoint in ("c1", "c1", "c2"):  # the last reads all of the stream again
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        index_upkeep.maintain(stream, c, str(tmp_path / checkpoint)).awaitTermination()
        assert c.scan().count() == 2


def test_traces_never_fail(spark, tmp_path):
    answers = spark.createDataFrame([(1, "q", "a", "end_turn", 1, 1)], "qid long, query string, answer string, stop_reason string, input_tokens long, output_tokens long")
    hits = spark.createDataFrame([], "qid long, rank int, source string, page int, score double")
    rows = trace.traces(answers, hits, "text_only")
    assert rows.first().n_hits == 0
    assert trace.append(rows, str(tmp_path / "t")) and not trace.append(rows, "nosuchscheme://x/y")


def test_client_and_server_agree(spark):
    with EmbeddingServer() as server:
        url = server.url
        make = lambda: embedding_service.EmbeddingClient(url)
        assert make().health() == {"status": "ok"}
        q = spark.createDataFrame([(i, f"query number {i}") for i in range(19)], "qid long, query string")
        many, one = ({r.qid: r.vectors for r in f(q, make).collect()} for f in (embedding_service.embed_queries, embedding_service.embed_query))
        assert many == one and {i: v for i, v in many.items()} == {i: hashed_vectors(f"query number {i}".encode()).tolist() for i in range(19)}
        with pytest.raises(Exception, match="400"):
            embedding_service.embed_queries(q.coalesce(1), make, batch=9).collect()
        for path, body in (("/embed_query", {"query": " "}), ("/embed_queries", {"queries": ["a", ""]}), ("/embed_queries", {}), ("/nothing", {})):
            with pytest.raises(urllib.error.HTTPError, match="404" if path == "/nothing" else "400"):
                make()._call(path, body)
        pages = blocks.page_images(spark.createDataFrame([("s", 1, "some text\nmore")], "source string, page int, page_text string"))
        got = embedding_service.embed_images(pages.select("source", "page", "image"), make).first()
        assert got.n_patches == len(got.vectors) == len(hashed_vectors(bytes(pages.first().image))) and (got.source, got.page) == ("s", 1)


def test_as_many_embeddings_as_inputs(spark):
    class Short:
        def embed_queries(self, queries):
            return []

    with pytest.raises(Exception, match="0 embeddings for 1 inputs"):
        embedding_service.embed_queries(spark.createDataFrame([(1, "a")], "qid long, query string"), Short).collect()


def test_page_images_are_png_files(spark):
    pages = spark.createDataFrame([("s", 1, "ab c\n\nd"), ("s", 2, None)], "source string, page int, page_text string")
    rows = blocks.page_images(pages, 2.0).orderBy("page").collect()
    raw = bytes(rows[0].image)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (8, 6)
    size = struct.unpack(">I", raw[33:37])[0]
    lines = zlib.decompress(raw[41 : 41 + size])
    assert lines[:13] == b"\0" + b"\x40" * 12 and lines[13:25] == b"\xff" * 6 + b"\x40" * 6 and len(lines) == 6 * 25 and len(rows[1].image) > 0
    images = spark.createDataFrame([(1, 2, 3, bytearray(b"\1\2\3\4\5\6")), (1, 1, 4, bytearray(b"\1\2\3\4")), (1, 1, 1, None)], "h int, w int, n int, d binary")
    got = [r[0] and zlib.decompress(bytes(r[0])[41 : 41 + struct.unpack(">I", bytes(r[0])[33:37])[0]]) for r in images.select(vector.png_of("h", "w", "n", "d")).collect()]
    assert got == [b"\0\3\2\1\6\5\4", b"\0\3\2\1", None]
    with pytest.raises(Exception, match="not an image"):
        spark.createDataFrame([(1, 1, 2, bytearray(b"ab"))], "h int, w int, n int, d binary").select(vector.png_of("h", "w", "n", "d")).collect()


def test_hosts_of_what_is_no_url(spark):
    from tidepool.functions.text import host_of

    urls = ["http://a.example:80/x", "http://a b/", "no url", None, "https://[::1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u"))).collect()]
    assert got == ["a.example", "localhost", "localhost", "localhost", "localhost"]


def test_default_paths_and_the_report_of_skipped_ones(spark, tmp_path, monkeypatch):
    (tmp_path / "b.pdf").write_bytes(b"x")
    monkeypatch.setattr(blocks, "DEFAULT_PATHS", (str(tmp_path / "*.pdf"), str(tmp_path / "*.none")))
    found, missing = blocks.read_files(spark)
    assert found.count() == 1 and blocks.skip_report(missing) == f"SKIP {tmp_path / '*.none'}: no such file"


def test_the_last_version_in_a_batch_wins(spark, tmp_path):
    rows = [(1, f"version {v} of a long enough line", "s", v) for v in (2, 5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, version int")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    c = Collection(spark, str(tmp_path / "index"), index_upkeep.points(docs).schema)
    index_upkeep.maintain(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "c"), order="version").awaitTermination()
    assert [r.text for r in c.scan().collect()] == ["version 5 of a long enough line"]
    schema = "id string, v int, t string"
    d = Collection(spark, str(tmp_path / "d"), spark.createDataFrame([], schema).schema)
    d.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z")], schema).repartition(3), order="v")
    assert [r.t for r in d.scan().collect()] == ["y"]


def test_a_collection_keeps_its_settings(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, v array<double>").schema
    Collection(spark, str(tmp_path / "c"), schema, "v", 2).ensure()
    Collection(spark, str(tmp_path / "c"), schema, "v", 2).ensure()
    with pytest.raises(ValueError, match="max_sim"):
        Collection(spark, str(tmp_path / "c"), schema, "v", 2, comparator="max_sim").ensure()


def test_a_mode_traces_what_it_rests_on_by_one_search(spark, tmp_path):
    points = spark.createDataFrame([("a", "s1", 1, "text", "growth of revenue"), ("b", "s2", 3, "text", "nothing alike")], "id string, source string, page int, block_type string, text string")
    q = spark.createDataFrame([(1, "revenue growth"), (2, ""), (3, None)], "qid long, query string")
    runs = []

    def write(df):
        runs.append(df)
        df.write.parquet(str(tmp_path / f"hits{len(runs)}"))
        return spark.read.parquet(str(tmp_path / f"hits{len(runs)}"))

    stages = modes.text_only(q, modes.WrittenRetriever(modes.TextRetriever(points), write), 1)
    assert trace.recorded(stages, "text_only", str(tmp_path / "t"), variant="baseline") and len(runs) == 1
    captions = modes.caption_only(q, points.drop("block_type"), 1, write)
    assert trace.recorded(captions, "caption", str(tmp_path / "t")) and len(runs) == 2
    got = {(r.qid, r.mode): (r.n_hits, r.hit_pages, r.retriever_variant) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {(i, m): (*((1, "s1 p1") if i == 1 else (0, "")), v) for i in (1, 2, 3) for m, v in (("text_only", "baseline"), ("caption", None))}
    assert not trace.recorded(stages, "text_only", "nosuchscheme://x/y")


def test_records_by_language_with_several_gold_pages(spark):
    schema = "id string, q_ko string, q_en string, gold_pages array<struct<source: string, page: int>>, block_type string, type string"
    rows = [("r1", "k", "e", [("s", 1), ("s", 2), ("s", 1)], "text", "number"), ("r2", None, "e", [("s", 9)], "table", None), ("r3", "k", None, None, "text", "x"), ("r4", "k", "e", [], None, "x"), (None, "k", "e", [("s", 1)], "text", "x")]
    records = spark.createDataFrame(rows, schema)
    hits = spark.createDataFrame([("r1:ko", "s", 2, 1), ("r1:ko", "s", 2, 2), ("r1:ko", "s", 1, 7), ("r1:en", "s", 7, 1), ("r9:en", "s", 1, 1)], "qid string, source string, page int, rank int")
    assert {r.qid for r in evaluate.record_questions(records).collect()} == {"r1:ko", "r1:en", "r2:en", "r3:ko", "r4:ko", "r4:en"}
    got = {r.qid: (r.language, r.type, r.n_gold, r.recall_1, r.recall_5, r.ndcg_1) for r in evaluate.record_metrics(hits, records, (1, 5), 1).collect()}
    assert got == {"r1:ko": ("ko", "number", 2, 0.5, 1.0, 1.0), "r1:en": ("en", "number", 2, 0.0, 0.0, 0.0), "r2:en": ("en", None, 1, 0.0, 0.0, 0.0)}
    assert evaluate.record_metrics(hits.limit(0), records.limit(0)).count() == 0


def test_gold_pages(spark):
    pages = spark.createDataFrame([("s", 1, 'a "b" c d e'), ("s", 2, "x a b c d e y"), (None, 1, "z a b c d e f"), ("t", 1, None)], "source string, page int, page_text string")
    q = spark.createDataFrame([(1, "a b c d e"), (2, "none of it")], "qid long, query string")
    assert {tuple(r) for r in evaluate.gold_pages(pages, q).collect()} == {(1, "s", 2), (1, None, 1)}
