"""Hand-computed cases of the retrieval engine's rules."""

import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidepool.functions import ids, text, vector
from tidepool.operators import evaluate, fuse, generate, index, rerank, rewrite, route, search
from tidepool.schema import CAPTION_NAMESPACE, TEXT_NAMESPACE, VISION_NAMESPACE
from tidepool.sources import blocks

HITS = "qid long, rank int, source string, page int, id string, score double"


def hits(spark, pages, qid=1):
    rows = [(qid, i, *(p or (None, None)), f"{i}", 1.0 / i) for i, p in enumerate(pages, 1)]
    return spark.createDataFrame(rows, HITS)


def fused(spark, a, b, wa=0.5, wb=0.5):
    weights = spark.createDataFrame([(1, wa, wb)], "qid long, w_text double, w_vision double")
    out = fuse.fused_topk(fuse.rrf(hits(spark, a), hits(spark, b), weights), 100).orderBy("rank").collect()
    return [((r.source, r.page), round(r.fused_score, 8), r.sources) for r in out]


def test_rrf_counts_duplicates_and_keyless_hits_take_a_rank(spark):
    got = fused(spark, [("A", 1), ("A", 2), ("A", 1), None, ("B", 3)], [("B", 3), ("A", 9), ("A", 2)], 0.3, 0.7)
    assert got == [
        (("B", 3), 0.01609079, ["text", "vision"]),
        (("A", 2), 0.01594982, ["text", "vision"]),
        (("A", 9), 0.01129032, ["vision"]),
        (("A", 1), 0.00967994, ["text", "text"]),
    ]


def test_rrf_ties_keep_the_order_of_first_sight(spark):
    assert [p for p, _, _ in fused(spark, [("A", 1)], [("B", 1)])] == [("A", 1), ("B", 1)]


def test_rrf_of_nothing(spark):
    assert fused(spark, [], []) == []


def test_rrf_against_a_plain_restatement(spark):
    rng = random.Random(5)
    for _ in range(4):
        a, b = ([rng.choice([("A", 1), ("A", 2), ("B", 1), ("B", None), None]) for _ in range(rng.randint(0, 7))] for _ in range(2))
        score, seen = {}, {}
        for name, w, pages in (("text", 0.3, a), ("vision", 0.7, b)):
            for r, p in enumerate(pages, 1):
                if p:
                    score[p] = score.get(p, 0.0) + w / (60 + r)
                    seen.setdefault(p, []).append(name)
        want = sorted(score, key=lambda p: -score[p])
        assert fused(spark, a, b, 0.3, 0.7) == [(p, round(score[p], 8), seen[p]) for p in want]


@pytest.mark.parametrize(
    ("query", "rationale"),
    [
        ("corporate strategy", "chart-leaning"),
        ("paragraph 3", "chart-leaning"),
        ("tablet dosing", "table — both useful"),
        ("회사의 목표는?", "table — both useful"),
        ("sales by indication", "balanced (default)"),
        ("explain the trend", "balanced (default)"),
        ("indication", "prose-leaning"),
        ("Sales by region", "table — both useful"),
        ("table of growth", "chart-leaning"),
        ("", "balanced (default)"),
    ],
)
def test_router(spark, query, rationale):
    assert route.route(spark.createDataFrame([(1, query)], "qid long, query string")).first().rationale == rationale


def test_uuid5(spark):
    row = spark.range(1).select(ids.block_id(F.lit("Q1.pdf"), F.lit("text"), F.lit(7)), ids.page_id(F.lit("é.pdf"), F.lit(2)), ids.caption_id(F.lit("x"), F.lit(3))).first()
    assert row[0] == "d73871a4-816a-5b01-80d6-7d97d910408a"
    for got, space, name in zip(row, (TEXT_NAMESPACE, VISION_NAMESPACE, CAPTION_NAMESPACE), ("Q1.pdf:text:7", "é.pdf:page:2", "x:caption:page:3"), strict=True):
        assert got == str(uuid.uuid5(uuid.UUID(space), name))


def test_strip(spark):
    stripped = ["\t", "\n", " ", "　", "\u0085", "\x1c", " "]
    rows = [(c + "x y" + c,) for c in stripped + ["​", "﻿"]] + [(None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.strip(F.col("t"))).collect()]
    assert got == ["x y"] * len(stripped) + ["​x y​", "﻿x y﻿", ""]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_length_boundary(spark):
    got = blocks.extract_blocks(docs(spark, "123456789\n1234567890\n12345678901\n  \t123456789 ", None)).collect()
    assert sorted(len(r.text) for r in got) == [10, 11]


def test_indices_keep_gaps_for_each_type(spark):
    got = blocks.extract_blocks(docs(spark, "short\nlong enough line\n\na | table line\nanother long line")).collect()
    assert sorted((r.block_type, r.block_index) for r in got) == [("table", 0), ("text", 1), ("text", 3)]


def test_pages(spark):
    d = docs(spark, "\n".join(map(str, range(45))), "")
    assert [(r.source, r.n_pages) for r in blocks.page_count(d).orderBy("source").collect()] == [("s/0", 3), ("s/1", 1)]
    wanted = spark.createDataFrame([("s/0", 3), ("s/0", 4), ("s/1", 0)], "source string, page int")
    assert [r.page_text for r in blocks.lookup_pages(d, wanted).collect()] == ["40\n41\n42\n43\n44"]


def test_first_page(spark):
    rows = spark.createDataFrame([([(3,), (5,)],), ([],)], "prov array<struct<page_no: int>>")
    assert [r[0] for r in rows.select(blocks.first_page(F.col("prov"))).collect()] == [3, None]


def test_maxsim(spark):
    pages = spark.createDataFrame([("P", [[1.0, 0.0], [0.6, 0.8]]), ("R", [[0.0, 1.0]]), ("E", [])], "id string, vectors array<array<double>>")
    tokens = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "qid long, vectors array<array<double>>")
    assert [(r.id, r.score) for r in search.maxsim_topk(pages, tokens).orderBy("rank").collect()] == [("P", 1.8), ("R", 1.0)]
    same = spark.createDataFrame([(1, [[2.0, 2.0], [1.0, 1.0]])], "qid long, vectors array<array<double>>")
    flat = spark.createDataFrame([("A", [[3.0, 3.0]])], "id string, vectors array<array<double>>")
    assert search.maxsim_topk(flat, same).first().score == 2.0


def test_cosine_against_loops_on_ties_zeros_and_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(60)]
    asked = [(i, [1.0, float(i), 0.5]) for i in range(5)]
    corpus, queries = spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(asked, "qid long, vector array<double>")

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)

    want = set()
    for q, v in asked:
        near = sorted((-cosine(v, u), i) for i, u in rows if any(u))[:7]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(near, 1)}
    for got in (search.cosine_topk(corpus, queries, 7, block=2), search.cluster_topk(corpus, queries, 7, clusters=4, probes=4, chunk=5)):
        assert {(r.qid, r["rank"], r.id, round(r.score, 6)) for r in got.collect()} == want
    assert search.cosine_topk(corpus.limit(0), queries).count() == 0
    assert search.cosine_topk(corpus, queries.limit(0)).count() == 0
    assert search.cluster_topk(corpus.limit(0), queries).count() == 0


def test_text_topk_of_copies_orders_by_id(spark):
    corpus = spark.createDataFrame([(f"d{i}", "same words here") for i in range(40)] + [("e", None), ("f", "")], "id string, text string")
    got = search.text_topk(corpus, spark.createDataFrame([(1, "words"), (2, ""), (3, None)], "qid long, query string"), 3).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in got] == [(1, "d0"), (1, "d1"), (1, "d10")]


def test_ndcg_and_recall(spark):
    h = hits(spark, [("a", 1), ("b", 1), ("c", 1), ("a", 1)])
    gold = spark.createDataFrame([(1, "a", 1), (1, "c", 1), (2, "z", 1)], "qid long, source string, page int")
    assert {r.qid: r.ndcg for r in evaluate.ndcg_at_k(h, gold).collect()} == {1: 0.919721, 2: 0.0}
    assert {r.qid: (r.recall, r.hit) for r in evaluate.recall_at_k(h, gold, 5).collect()} == {1: (1.0, True), 2: (0.0, False)}


def test_rerank_is_stable_and_takes_all_without_k(spark):
    h = spark.createDataFrame([(1, i, t) for i, t in enumerate(["b", "a", None, "b a"], 1)], "qid long, rank int, text string")
    q = spark.createDataFrame([(1, "a")], "qid long, query string")
    assert [(r.prior_rank, r.rerank_score) for r in rerank.rerank(h, q).orderBy("rank").collect()] == [(2, 1.0), (4, 1.0), (1, 0.0), (3, 0.0)]
    assert rerank.rerank(h.limit(0), q).count() == 0
    assert [r.rerank_score for r in rerank.rerank(h.drop("text"), q, 2).collect()] == [0.0, 0.0]


def test_context(spark):
    h = spark.createDataFrame([(1, 2, "S", None, "table", "two"), (1, 1, "S", 1, "text", "one")], "qid long, rank int, source string, page int, block_type string, text string")
    assert generate.passages(h).first().context == "[Passage 1 — S p1 text]\none\n\n[Passage 2 — S pNone table]\ntwo"
    assert generate.passages(h.drop("block_type")).first().context.startswith("[Passage 1 — S p1 ?]")


def test_answers_refuse_in_the_question_s_language(spark):
    q = spark.createDataFrame([(1, "매출은?"), (2, "sales?")], "qid long, query string")
    none = spark.createDataFrame([], HITS + ", text string")
    got = {r.qid: r.answer for r in generate.extractive_answers(q, none).collect()}
    assert got == {1: "정보를 찾을 수 없습니다.", 2: "Not found in the provided pages."}
    assert spark.createDataFrame(list(got.items()), "q long, a string").where(evaluate.refuses(F.col("a"))).count() == 2


def test_glossary_keeps_order_and_unknown_words(spark):
    q = spark.createDataFrame([(1, "The cat the"), (2, None)], "qid long, query string")
    g = spark.createDataFrame([("the", "die"), ("cat", "Katze")], "term string, target string")
    assert {r.qid: r.rewritten_query for r in rewrite.translate(q, g).collect()} == {1: "die Katze die", 2: ""}


def test_collection_upsert_replace_drop(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, source string, v array<float>").schema
    c = index.Collection(spark, str(tmp_path / "c"), schema, "v", 1)
    assert c.scan().count() == 0
    c.ensure()
    c.ensure()
    c.upsert(spark.createDataFrame([("x", "s", [1.0]), ("y", "s", [2.0])], schema))
    new = spark.createDataFrame([("y", "s", [3.0]), ("z", "t", [4.0])], schema)
    for _ in range(2):
        c.upsert(new)
        assert {r.id: r.v[0] for r in c.scan().collect()} == {"x": 1.0, "y": 3.0, "z": 4.0}
    c.replace(spark.createDataFrame([("w", "s", [5.0])], schema))
    assert {r.id for r in c.scan().collect()} == {"w", "z"}
    with pytest.raises(Exception, match="1 components"):
        c.upsert(spark.createDataFrame([("x", "s", [1.0, 2.0])], schema))
    small = index.Collection(spark, str(tmp_path / "m"), schema, most_deltas=3)
    for i in range(6):
        small.upsert(spark.createDataFrame([("x", "s", [float(i)]), (f"y{i}", "s", [0.0])], schema))
        assert len(small._versions()) <= 3
    assert {r.id: r.v[0] for r in small.scan().collect()} == {"x": 5.0} | {f"y{i}": 0.0 for i in range(6)}
    c.drop()
    assert not c.exists()


def test_exact_match_f1_and_bootstrap(spark):
    row = spark.range(1).select(evaluate.exact_match(F.lit(" €3,480 Million "), F.lit("€3480  million")), evaluate.f1(F.lit("a a b"), F.lit("a b b")), evaluate.f1(F.lit(""), F.lit(None))).first()
    assert (row[0], row[1], row[2]) == (True, 0.666667, 1.0)
    same = spark.createDataFrame([(i, 1.0, 0.0) for i in range(9)], "qid long, a double, b double")
    assert tuple(evaluate.bootstrap(same, 20).first()) == (1.0, 1.0, 1.0)


def test_usage_and_cost(spark):
    row = spark.range(1).select(generate.usage(F.lit(3), F.lit(None)), evaluate.dollars(F.lit(1_000_000), F.lit(200_000)), generate.short_completion(F.lit(" a b c "), 2), generate.short_completion(F.lit("a b"), 0)).first()
    assert tuple(row[0]) == (3, 0, 0, 0)
    assert (row[1], row[2], row[3]) == (2.0, "a b", "a b")


def test_l2_of_zero(spark):
    assert spark.range(1).select(vector.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_a_raising_mode_fails_its_own_cells_only(spark):
    from tidepool.sources.storage import written

    cases = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    fine = lambda: cases.select("qid", (F.col("qid") < 3).alias("hit")).where("qid <> 2")

    def broken():
        raise RuntimeError("no service")

    def lazily():
        return cases.select("qid", F.raise_error(F.lit("late")).cast("boolean").alias("hit"))

    def alone(one):
        return one.select("qid", F.when(F.col("qid") == 2, F.raise_error(F.lit("only two")).cast("boolean")).otherwise(F.lit(True)).alias("hit"))

    results = None
    for name, run, each in (("fine", fine, None), ("broken", broken, None), ("late", lazily, None), ("each", lazily, alone)):
        got = evaluate.isolated(cases, name, run, written, each)
        results = got if results is None else results.unionByName(got)
    names = ["fine", "broken", "late", "each", "absent"]
    matrix = evaluate.pass_matrix(results, names)
    assert {tuple(r) for r in matrix.collect()} == {(1, True, False, False, True, False), (2, False, False, False, False, False), (3, False, False, False, True, False)}
    assert results.where("mode = 'broken'").first().error == "RuntimeError: no service"
    lines = evaluate.report(matrix, names).splitlines()
    assert lines[1].split() == ["1", "OK", "FAIL", "FAIL", "OK", "FAIL"] and lines[-1].split() == ["passed", "1/3", "0/3", "0/3", "2/3", "0/3"]


def test_reports_and_latency(spark, tmp_path):
    from tidepool.sources.storage import written

    matrix = spark.createDataFrame([(1, True)], "qid long, m boolean")
    evaluate.write_report(matrix, str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("1", "true")]
    got = evaluate.timed("m", lambda: matrix, written, 2).first()
    assert got.rows == 1 and got.seconds > 0 and got.per_item == got.seconds / 2


def test_gold_by_words_and_by_search(spark):
    d = spark.createDataFrame([("a", "xx one two three four five yy"), ("b", "xxone two three four fiveyy"), ("c", "one two three four"), ("d", None), ("e", "one  two three four five"), ("f", "b c")], "source string, text string")
    q = spark.createDataFrame([(1, "one two three four five"), (2, "b c"), (3, None), (4, "ne two three four fiv")], "qid long, query string")
    want = {(1, "a"), (1, "b"), (4, "a"), (4, "b"), (2, "f")}
    assert {(r.qid, r.source) for r in evaluate.gold_sources(d, q).collect()} == want


def test_f1_scores_and_marks(spark):
    pairs = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", None), (3, "x", "y")], "qid long, answer string, gold string")
    assert {r.qid: r.f1 for r in evaluate.f1_scores(pairs).collect()} == {1: 0.666667, 2: 1.0, 3: 0.0}
    judge = lambda q, a, g: F.when(a == "x", 9).when(a == "", None).otherwise(3)
    got = {r.qid: r.mark for r in evaluate.judged(pairs.withColumn("query", F.lit("q")), judge).collect()}
    assert got == {1: 3, 2: 1, 3: 5}


def test_kept_terms_and_other_embedders(spark):
    from tidepool.plans import modes

    corpus = spark.createDataFrame([("d1", "same words here"), ("d2", "other words, other words"), ("e", None), ("f", "")], "id string, text string")
    q = spark.createDataFrame([(1, "words other"), (2, "")], "qid long, query string")
    a = [(r.qid, r["rank"], r.id, r.score) for r in search.text_topk(corpus, q).orderBy("rank").collect()]
    b = [(r.qid, r["rank"], r.id, r.score) for r in search.terms_topk(search.with_terms(corpus), q).orderBy("rank").collect()]
    assert a == b and [x[2] for x in a] == ["d2", "d1"]
    length = lambda t: F.array(F.length(F.coalesce(t, F.lit(""))).cast("double"), F.lit(1.0))
    got = modes.TextRetriever(corpus, embed=length).search(q.where("qid = 2"), 1).first()
    assert got.id in ("e", "f") and got.score == 1.0
    assert rewrite.written(q, lambda t: F.concat(t, F.lit(" ")), 1).orderBy("qid").collect()[0].rewritten_query == "words"


def test_questions_of_very_long_conversations_stay_apart(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in (1, 2) for t in range(2_100)]
    got = rewrite.drafts_from_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    assert got.select("qid").distinct().count() == got.count() == 2_100


def test_messages_put_images_first(spark):
    images = generate.image_messages(spark.createDataFrame([(1, r, f"{r}.png", bytearray(b"x")) for r in range(1, 6)], "qid long, rank int, path string, content binary"))
    q = spark.createDataFrame([(1, 'say "hi"'), (2, None)], "qid long, query string")
    got = {r.qid: json.loads(r.body) for r in generate.vision_requests(q, images, "m", 7).collect()}
    content = got[1]["messages"][0]["content"]
    assert [c["type"] for c in content] == ["image"] * 5 + ["text"] and ["cache_control" in c for c in content] == [True] * 3 + [False] * 3
    assert got[1]["system"][0]["cache_control"] == {"type": "ephemeral"} and (got[1]["model"], got[1]["max_tokens"]) == ("m", 7)
    assert content[-1] == {"type": "text", "text": 'Question: say "hi"'} and content[0]["source"] == {"type": "base64", "media_type": "image/png", "data": "eA=="}
    assert got[2]["messages"][0]["content"] == [{"type": "text", "text": "Question: "}]
    answers = {r.qid: r for r in generate.vision_generate(q, images, generate.echoing_generator).collect()}
    assert answers[1].answer == 'Question: say "hi"' and answers[1].usage.cache_creation_input_tokens == 4 and answers[1].stop_reason == "end_turn"
    odd = spark.createDataFrame([(1, '{"content": [{"type": "tool"}]}'), (2, "broken")], "qid long, response string")
    assert [(r.answer, r.usage.input_tokens) for r in generate.parsed_responses(odd).orderBy("qid").collect()] == [("", 0), ("", 0)]


def test_evaluation_questions_are_read(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "q_en": "how much?", "answer": "3", "gold_pages": [{"source": "a", "page": 2}]}\n')
    got = evaluate.read_questions(spark, str(tmp_path / "q.jsonl")).first()
    assert got.gold_pages[0].page == 2 and got.q_ko is None


def test_half_even(spark):
    row = spark.range(1).select(*(text.half_even(F.lit(v), 2) for v in (0.125, 0.375, 2.675, 1234.565))).first()
    assert list(row) == [round(v, 2) for v in (0.125, 0.375, 2.675, 1234.565)]


def test_gold_by_keys_of_any_length(spark):
    """Questions of no, one, two and more words against a plain search in all texts; no nested loop in the plan."""
    texts = ["the quick brown fox jumps over", "quick", "a b", "xquick brownish", "the quick  brown", "", None, "fox", "ünï cödé words here now", "brown fox"]
    asked = ["quick brown fox", "quick", "quick brown", "k b", "", " ", "ox", "o", "the quick brown fox jumps", "ï cödé w", "missing words here", "fox jumps over the", None]
    d = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "source string, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    want = {(i, f"s{j}") for i, a in enumerate(asked) for j, t in enumerate(texts) if a is not None and t is not None and a in t}
    found = evaluate.gold_sources(d, q)
    assert {(r.qid, r.source) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert evaluate.gold_sources(d, q.limit(0)).count() == 0


def test_strip_of_long_inner_runs_takes_a_moment(spark):
    import time

    from tidepool.functions.text import strip

    df = spark.createDataFrame([("a" + " " * 1_000_000 + "b",), (" \t" * 500_000 + "x",), ("x" + " \x1c" * 500_000,)], "text string").select(strip(F.col("text")).alias("t"))
    df.limit(0).count()
    began = time.monotonic()
    assert [len(r.t) for r in df.collect()] == [1_000_002, 1, 1]
    assert time.monotonic() - began < 20


def test_reranking_sees_so_many_tokens_of_a_pair(spark):
    rows = [(1, "late word", " ".join(["x"] * 509) + " late word"), (2, "late word", " ".join(["x"] * 508) + " late word"), (3, " ".join(["a"] * 600), "a"), (4, "late", "late")]
    from tidepool.operators.rerank import term_coverage

    df = spark.createDataFrame(rows, "qid long, q string, t string").select("qid", term_coverage(F.col("q"), F.col("t")).alias("c"))
    assert {r.qid: r.c for r in df.collect()} == {1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0}
