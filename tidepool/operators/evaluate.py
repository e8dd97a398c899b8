"""Retrieval and answer metrics, pass matrices, bootstrap intervals and costs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import contains_any, coverage, tokens
from tidepool.schema import DOLLARS_PER_MILLION_IN, DOLLARS_PER_MILLION_OUT, EVAL_QUESTION, REFUSAL_SIGNS


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from JSON lines."""
    return spark.read.schema(EVAL_QUESTION).json(path)


def keyword_hits(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """qid and hit: whether any keyword of cases (qid, keywords) is in the joined texts of the query's hits."""
    texts = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("_all"))
    return cases.join(texts, "qid", "left").select("qid", F.coalesce(contains_any(F.col("_all"), F.col("keywords")), F.lit(False)).alias("hit"))


def answer_hit(answer: Column, keywords: Column) -> Column:
    """Whether any keyword is in the answer; no answer is no hit."""
    return F.coalesce(contains_any(answer, keywords), F.lit(False))


def refuses(answer: Column) -> Column:
    return contains_any(answer, REFUSAL_SIGNS)


def pass_matrix(results: DataFrame, modes: list[str]) -> DataFrame:
    """A row for each query, a column for each mode; what is missing or failed is false."""
    wide = results.groupBy("qid").pivot("mode", modes).agg(F.max(F.col("hit").cast("int")))
    return wide.select("qid", *((F.coalesce(m, F.lit(0)) == 1).alias(m) for m in modes))


def isolated(cases: DataFrame, mode: str, run: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame], by_query: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, mode, hit, error) of a mode for every case; an error fails the cases that it hits and nothing else.

    run() gives (qid, hit) of all cases, and error where a plug-in failed for one (guard.guarded), written and read again by
    write. Where the whole of it raises, by_query runs each case alone, if it is given; else all cases of the mode fail with the message.
    """

    def failed(some: DataFrame, error: Exception) -> DataFrame:
        return some.select("qid", F.lit(mode).alias("mode"), F.lit(False).alias("hit"), F.lit(f"{type(error).__name__}: {str(error)[:200]}").alias("error"))

    def told(some: DataFrame, got: DataFrame) -> DataFrame:
        own = F.col("error") if "error" in got.columns else F.lit(None).cast("string")
        joined = some.select("qid").join(got.select("qid", "hit", own.alias("error")), "qid", "left")
        return joined.select("qid", F.lit(mode).alias("mode"), F.coalesce("hit", F.lit(False)).alias("hit"), "error")

    try:
        return told(cases, write(run()))
    except Exception as error:  # noqa: BLE001  whatever a mode raises is a failed cell
        if by_query is None:
            return failed(cases, error)
    out = None
    for row in cases.select("qid").collect():  # an evaluation set
        one = cases.where(F.col("qid") == F.lit(row["qid"]))
        try:
            cell = told(one, write(by_query(one)))
        except Exception as error:  # noqa: BLE001
            cell = failed(one, error)
        out = cell if out is None else out.unionByName(cell)
    return failed(cases, ValueError("no cases")) if out is None else out


def report(matrix: DataFrame, modes: list[str], width: int = 8) -> str:
    """The matrix as fixed-width lines with a total; it is an evaluation set's, so it fits the driver."""
    names = [max(width, len(m)) for m in modes]
    lines = ["qid".ljust(12) + " ".join(m.rjust(n) for m, n in zip(modes, names, strict=True))]
    rows = matrix.orderBy("qid").collect()
    for r in rows:
        lines.append(str(r["qid"])[:12].ljust(12) + " ".join(("OK" if r[m] else "FAIL").rjust(n) for m, n in zip(modes, names, strict=True)))
    lines.append("passed".ljust(12) + " ".join(f"{sum(r[m] for r in rows)}/{len(rows)}".rjust(n) for m, n in zip(modes, names, strict=True)))
    return "\n".join(lines)


def write_report(matrix: DataFrame, path: str) -> None:
    """The matrix as a CSV folder."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def timed(name: str, run: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame], n: int = 1) -> DataFrame:
    """(name, rows, seconds, per_item) of what run() gives once it is written: latency by questions, indexing time by pages."""
    began = time.monotonic()
    rows = write(run()).count()
    seconds = time.monotonic() - began
    spark = SparkSession.active()
    return spark.createDataFrame([(name, rows, seconds, seconds / max(1, n))], "name string, rows long, seconds double, per_item double")


def _keys(kind: int) -> Column:
    """Structs (_kind, _k) of all a text (text, _w) holds of one kind: runs of `kind` words, or if negative of so many characters; of kind 0 one for each text."""
    n, size, run = abs(kind), "size(_w)" if kind > 0 else "length(text)", "slice(_w" if kind > 0 else "substr(text"
    last = f"{size} - {n - 1}" if n else "1"
    hashes = f"if({size} < {n}, array(), array_distinct(transform(sequence(1, {last}), i -> xxhash64({run}, i, {n})))))"
    return F.expr(f"transform({hashes}, k -> named_struct('_kind', {kind}, '_k', k))")


def gold_sources(documents: DataFrame, questions: DataFrame, words: int = 3) -> DataFrame:
    """(qid, source) of documents (source, text; a source is one document) that hold a question's text (qid, query).

    A text that holds a question holds all of its words but the first and the last as words of its own, so documents
    meet questions by an equi-join on the first few of these; questions of two words or fewer meet them by their first
    characters. Documents are exploded to the kinds of keys that occur, without their texts; these are joined to what has met.
    """
    asked = questions.where(F.col("query").isNotNull()).select("qid", "query", F.split("query", " ").alias("_w"))
    inner = F.least(F.size("_w") - 2, F.lit(words))
    kind = F.when(inner > 0, inner).otherwise(-F.least(F.char_length("query"), F.lit(3)))
    key = F.when(inner > 0, F.xxhash64(F.slice("_w", F.lit(2), inner))).otherwise(F.xxhash64(F.substring("query", F.lit(1), -kind)))
    asked = asked.select("qid", "query", kind.alias("_kind"), key.alias("_k"))
    texts = documents.where(F.col("text").isNotNull()).select("source", "text", F.split("text", " ").alias("_w"))
    kinds = sorted(r[0] for r in asked.select("_kind").distinct().collect())  # seven at most
    if not kinds:
        return documents.select("source").limit(0).crossJoin(questions.select("qid").limit(0)).select("qid", "source")
    held = F.concat(*(_keys(n) for n in kinds))
    met = texts.select("source", F.inline(held)).join(asked.select("qid", "_kind", "_k"), ["_kind", "_k"]).select("qid", "source").distinct()
    found = met.join(asked.select("qid", "query"), "qid").join(documents.select("source", "text"), "source")
    return found.where(F.contains("text", F.col("query"))).select("qid", "source").distinct()


def _first_ranks(hits: DataFrame, page: list[str]) -> DataFrame:
    """Pages in the order of their best hit, ranked anew without repeats."""
    from tidepool.operators.search import ranked

    first = hits.groupBy("qid", *page).agg(F.min("rank").alias("_r")).withColumn("_s", -F.col("_r"))
    return ranked(first, 1 << 30, by="_s", tie="_r").drop("_s", "_r")


def recall_at_k(hits: DataFrame, gold: DataFrame, k: int, page: tuple[str, ...] = ("source", "page")) -> DataFrame:
    """qid, recall (share of gold pages among the first k pages) and hit (any of them), for queries with gold."""
    top = _first_ranks(hits, list(page)).where(F.col("rank") <= k)
    gold = gold.select("qid", *page).distinct()
    got = gold.join(top.withColumn("_in", F.lit(1)), ["qid", *page], "left").groupBy("qid").agg(F.count("_in").alias("n_found"), F.count("*").alias("n_gold"))
    return got.select("qid", "n_found", "n_gold", F.round(F.col("n_found") / F.col("n_gold"), 6).alias("recall"), (F.col("n_found") > 0).alias("hit"))


def ndcg_at_k(hits: DataFrame, gold: DataFrame, k: int = 5, page: tuple[str, ...] = ("source", "page")) -> DataFrame:
    """qid and ndcg with binary gain, for queries with gold."""
    top = _first_ranks(hits, list(page)).where(F.col("rank") <= k)
    gold = gold.select("qid", *page).distinct()
    gain = 1 / F.log2(F.col("rank") + 1.0)
    got = gold.join(top, ["qid", *page], "left").groupBy("qid").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return got.select("qid", F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def gold_pages(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, source, page) of pages (source, page, page_text) that hold a question's text, as gold_sources tells of documents."""
    keyed = pages.select(F.to_json(F.struct("source", "page")).alias("source"), F.col("page_text").alias("text"))
    return gold_sources(keyed, questions).select("qid", F.inline(F.array(F.from_json("source", "source string, page int"))))


def record_questions(records: DataFrame) -> DataFrame:
    """(qid, id, language, query, type, block_type): a row for each language in which an evaluation record asks; qid is id:language."""
    asked = F.inline(F.array(*(F.struct(F.lit(x).alias("language"), F.col(f"q_{x}").alias("query")) for x in ("ko", "en"))))
    each = records.where("id is not null").select("id", "type", "block_type", asked).where("query is not null")
    return each.select(F.concat_ws(":", "id", "language").alias("qid"), "id", "language", "query", "type", "block_type")


def record_metrics(hits: DataFrame, records: DataFrame, ks: tuple[int, ...] = (5, 10), ndcg: int = 5) -> DataFrame:
    """(qid, id, language, type, block_type, n_gold, recall_k of each of ks, ndcg_k) of the hits (qid, source, page, rank) of record_questions(records).

    Pages count by their best hit, as in recall_at_k and ndcg_at_k, all metrics in one pass over the hits and not rounded, so that means of them are rounded once. Records without gold
    pages, null or empty, have no row; a gold page that a record lists twice counts once; a question without hits has zeros.
    """
    asked = record_questions(records).drop("query")
    gold = records.where("id is not null").select("id", F.inline("gold_pages")).distinct()
    found = asked.join(gold, "id").join(_first_ranks(hits, ["source", "page"]), ["qid", "source", "page"], "left")
    gain = F.when(F.col("rank") <= ndcg, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    counts = found.groupBy("qid", "id", "language", "type", "block_type").agg(F.count(F.lit(1)).alias("n_gold"), *(F.count_if(F.col("rank") <= k).alias(f"recall_{k}") for k in ks), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(ndcg)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    recalls = ((F.col(f"recall_{k}") / F.col("n_gold")).alias(f"recall_{k}") for k in ks)
    return counts.select("qid", "id", "language", "type", "block_type", "n_gold", *recalls, (F.col("dcg") / ideal).alias(f"ndcg_{ndcg}"))


def normalised_answer(text: Column) -> Column:
    """Lower case, single spaces, no separators within numbers."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([0-9]),([0-9])", "$1$2")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def exact_match(answer: Column, gold: Column) -> Column:
    return normalised_answer(answer) == normalised_answer(gold)


def f1(answer: Column, gold: Column) -> Column:
    """The harmonic mean of precision and recall of the two token multisets, for short texts; f1_scores() for others."""
    a, g = tokens(answer), tokens(gold)
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(g, t)))
    return F.when(F.size(a) + F.size(g) == 0, 1.0).otherwise(F.round(2.0 * shared / (F.size(a) + F.size(g)), 6))


def f1_scores(pairs: DataFrame) -> DataFrame:
    """qid and f1 of pairs (qid, answer, gold), by counting tokens: work grows with the texts' lengths only."""
    sides = pairs.select("qid", tokens(F.col("answer")).alias("a"), tokens(F.col("gold")).alias("g"))
    sizes = sides.select("qid", (F.size("a") + F.size("g")).alias("n"))
    every = sides.select("qid", F.explode(F.concat(F.transform("a", lambda t: F.struct(t.alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y"))), F.transform("g", lambda t: F.struct(t.alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y"))))).alias("e"))
    shared = every.groupBy("qid", "e.t").agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y")).groupBy("qid").agg(F.sum(F.least("x", "y")).alias("shared"))
    value = F.when(F.col("n") == 0, 1.0).otherwise(F.round(2.0 * F.coalesce("shared", F.lit(0)) / F.col("n"), 6))
    return sizes.join(shared, "qid", "left").select("qid", value.alias("f1"))


Judge = Callable[[Column, Column, Column], Column]  # (query, answer, gold) -> a mark from 1 to 5


def covering_judge(query: Column, answer: Column, gold: Column) -> Column:
    """A stand-in for a judging model: from 1 to 5 by the share of the gold answer's tokens that the answer has."""
    return (F.lit(1) + F.floor(4 * coverage(gold, answer) + 0.5)).cast("int")


def judged(answers: DataFrame, judge: Judge = covering_judge) -> DataFrame:
    """answers (qid, query, answer, gold) with a mark; what the judge can't tell is the worst, marks stay from 1 to 5."""
    mark = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(judge(F.col("query"), F.col("answer"), F.col("gold")).cast("int"), F.lit(1))))
    return answers.withColumn("mark", mark)


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """The share of an answer's numbers that the context lacks: a stand-in for a judge of hallucination."""
    own = F.array_distinct(F.regexp_extract_all(answer, F.lit("[0-9]+"), F.lit(0)))
    there = F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.round(F.size(F.array_except(own, there)) / F.size(own), 6))


def bootstrap(paired: DataFrame, rounds: int = 1_000, seed: str = "bootstrap") -> DataFrame:
    """Mean difference of a and b over paired (qid, a, b) and its 95 % interval by resampling questions.

    Which question each draw picks follows from a digest of (seed, round, draw), so any engine can repeat it.
    Questions are an evaluation set: their number, squared nowhere, times rounds is the size of the work.
    """
    from pyspark.sql import Window as W

    numbered = paired.select((F.row_number().over(W.orderBy("qid")) - 1).alias("i"), (F.col("a") - F.col("b")).alias("d"))
    size = paired.agg(F.count("*").alias("n"))
    spark = paired.sparkSession
    draws = spark.range(rounds).select(F.col("id").alias("b")).join(F.broadcast(size), F.lit(True)).where("n > 0").select("b", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("j"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("b").cast("string"), F.col("j").cast("string")))
    picked = draws.select("b", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n")).alias("i"))
    means = picked.join(numbered, "i").groupBy("b").agg(F.avg("d").alias("m"))
    edges = means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    mean = paired.agg(F.avg(F.col("a") - F.col("b")).alias("mean"))
    return mean.join(edges, F.lit(True)).select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


#: For each round a question counts so many times as there are of these at or below 32 bits of a digest: Poisson with mean 1.
_POISSON = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817, 4294967252]


def bootstrap_poisson(paired: DataFrame, rounds: int = 1_000, seed: str = "poisson") -> DataFrame:
    """bootstrap() in one pass: each question counts in each round as often as a digest of (seed, question, round) says, by a Poisson law of mean 1.

    Questions aren't numbered, drawn or shuffled: each gives its weights where it is, and rounds' sums are partial aggregates. A round
    that nothing counts in has no mean.
    """
    each = paired.select(F.col("qid").cast("string").alias("qid"), (F.col("a") - F.col("b")).alias("d")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "qid", F.col("b").cast("string"))), 1, 8), 16, 10).cast("long")
    times = sum((F.when(bits >= t, 1).otherwise(0) for t in _POISSON), F.lit(0))
    sums = each.select("b", "d", times.alias("w")).where("w > 0").groupBy("b").agg(F.sum(F.col("w") * F.col("d")).alias("s"), F.sum("w").alias("n"))
    edges = sums.select((F.col("s") / F.col("n")).alias("m")).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    mean = paired.agg(F.avg(F.col("a") - F.col("b")).alias("mean"))
    return mean.join(edges, F.lit(True)).select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def dollars(input_tokens: Column, output_tokens: Column) -> Column:
    return (input_tokens * DOLLARS_PER_MILLION_IN + output_tokens * DOLLARS_PER_MILLION_OUT) / 1_000_000


def average_runs(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means over repeated runs, against the variance of answers."""
    return results.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.countDistinct("run_id").alias("runs"))


def breakdown(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means of a metric over every combination of the dimensions; null stands for all."""
    return results.cube(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
