"""Context, prompts, answers, captions: the surface around a generating model, with plain stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import coverage, tokens
from tidepool.functions.vector import media_type
from tidepool.schema import MAX_CACHED_IMAGES, REFUSAL_ENGLISH, REFUSAL_KOREAN

#: (requests: qid, body) -> (qid, response), both JSON; a model's client or a stand-in.
Generator = Callable[[DataFrame], DataFrame]

SYSTEM_PROMPT = "Answer the question from the given pages alone. Say which pages you used. If they don't hold the answer, say that it was not found."


def passages(hits: DataFrame) -> DataFrame:
    """qid and context: numbered passages in rank order; a null field prints None, an absent one a question mark."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None")) if name in hits.columns else F.lit("?")

    listed = F.array_sort(F.collect_list(F.struct("rank", shown("source").alias("s"), shown("page").alias("p"), shown("block_type").alias("b"), F.coalesce("text", F.lit("")).alias("t"))))
    label = lambda x, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit(" — "), x["s"], F.lit(" p"), x["p"], F.lit(" "), x["b"], F.lit("]\n"), x["t"])
    return hits.groupBy("qid").agg(F.array_join(F.transform(listed, label), "\n\n").alias("context"))


def prompt(query: Column, context: Column, kind: str = "Passages") -> Column:
    return F.concat(F.lit("Question: "), query, F.lit(f"\n\n{kind}:\n"), F.coalesce(context, F.lit("")))


def refusal(query: Column) -> Column:
    """What is said where nothing was found, in the question's language."""
    return F.when(query.rlike("[가-힣]"), REFUSAL_KOREAN).otherwise(REFUSAL_ENGLISH)


def sentences(text: Column) -> Column:
    """Lines and what full stops, question and exclamation marks before a space end."""
    return F.split(F.coalesce(text, F.lit("")), r"\n|[.!?] ")


def extractive_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """A stand-in for a model: the whole sentence that covers most of the question, the first by rank and place, or a refusal.

    qid, query, answer, stop_reason and usage counts (tokens as the engine splits them).
    """
    told = F.transform(sentences(F.col("text")), lambda s, i: F.struct((-F.round(coverage(F.col("_query"), s), 6)).alias("c"), F.col("rank").alias("rank"), i.alias("i"), s.alias("s")))
    scored = hits.join(queries.select("qid", F.col("query").alias("_query")), "qid").withColumn("_s", F.array_min(told))
    best = scored.groupBy("qid").agg(F.min("_s").alias("best"), F.sum(F.size(tokens(F.col("text")))).alias("_in"))
    joined = queries.select("qid", "query").join(best, "qid", "left")
    found = F.coalesce(F.col("best.c") < 0, F.lit(False))
    answer = F.when(found, F.col("best.s")).otherwise(refusal(F.col("query")))
    return joined.select("qid", "query", answer.alias("answer"), F.when(found, "end_turn").otherwise("refusal").alias("stop_reason"), (F.coalesce("_in", F.lit(0)) + F.size(tokens(F.col("query")))).cast("long").alias("input_tokens"), F.size(tokens(answer)).cast("long").alias("output_tokens"))


def short_completion(text: Column, max_tokens: int | None = None) -> Column:
    """A stripped completion of at most max_tokens words; none or zero means the default of 256."""
    return F.array_join(F.slice(F.split(F.trim(text), " "), 1, max_tokens or 256), " ")


def _mark() -> Column:
    return F.struct(F.lit("ephemeral").alias("type"))


def _image_block() -> Column:
    source = F.struct(F.lit("base64").alias("type"), F.col("media_type"), F.col("data"))
    return F.struct(F.lit("image").alias("type"), source.alias("source"), F.lit(None).cast("string").alias("text"), F.when(F.col("cached"), _mark()).alias("cache_control"))


def _text_block() -> Column:
    none = F.lit(None).cast("struct<type: string, media_type: string, data: string>")
    return F.struct(F.lit("text").alias("type"), none.alias("source"), F.concat(F.lit("Question: "), F.coalesce("query", F.lit(""))).alias("text"), F.lit(None).cast("struct<type: string>").alias("cache_control"))


def _system_block() -> Column:
    return F.struct(F.lit("text").alias("type"), F.lit(SYSTEM_PROMPT).alias("text"), _mark().alias("cache_control"))


def request_blocks(queries: DataFrame, images: DataFrame) -> DataFrame:
    """(qid, part, place, block): the blocks of the requests of vision_requests() as JSON, a row each: part 0 the system prompt, 1 the images by place, 2 the question.

    For requests of any number of images: no row holds a whole one, and a client can send the blocks of one as they come.
    """
    asked = queries.select("qid", F.inline(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("place"), F.to_json(block).alias("block")) for part, block in ((0, _system_block()), (2, _text_block()))))))
    return asked.unionByName(images.select("qid", F.lit(1).alias("part"), F.col("rank").cast("long").alias("place"), F.to_json(_image_block()).alias("block")))


def vision_requests(queries: DataFrame, images: DataFrame, model: str = "standin", max_tokens: int = 1024) -> DataFrame:
    """qid and body, a request as JSON: the system prompt, then the images in rank order, then the question; what is worth caching is marked.

    images: qid, rank, media_type, data, cached, as image_messages() gives them. A body is one row: request_blocks() is for more images than a row should hold.
    """
    listed = images.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", _image_block().alias("block")))), lambda x: x["block"]).alias("images"))
    joined = queries.select("qid", "query").join(listed, "qid", "left")
    kind = dict(listed.dtypes)["images"]
    content = F.concat(F.coalesce("images", F.array().cast(kind)), F.array(_text_block()))
    body = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(_system_block()).alias("system"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"))
    return joined.select("qid", F.to_json(body).alias("body"))


_RESPONSE = "content array<struct<type: string, text: string>>, stop_reason string, usage struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>"


def parsed_responses(responses: DataFrame) -> DataFrame:
    """qid, answer (the first text block, or nothing), stop_reason, usage and raw of responses (qid, response)."""
    r = F.from_json("response", _RESPONSE)
    texts = F.filter(r["content"], lambda c: c["type"] == "text")
    answer = F.coalesce(F.try_element_at(texts, F.lit(1))["text"], F.lit(""))
    use = usage(*(r["usage"][f"{k}_tokens"] for k in ("input", "output", "cache_creation_input", "cache_read_input")))
    return responses.select("qid", answer.alias("answer"), r["stop_reason"].alias("stop_reason"), use.alias("usage"), F.col("response").alias("raw"))


def vision_generate(queries: DataFrame, images: DataFrame, generator: Generator, model: str = "standin", max_tokens: int = 1024) -> DataFrame:
    """Answers of a generator to questions about page images."""
    return parsed_responses(generator(vision_requests(queries, images, model, max_tokens)))


def echoing_generator(requests: DataFrame) -> DataFrame:
    """A stand-in for a model's client: repeats the question and counts its words; the marked parts count as written to the cache."""
    content = F.from_json(F.get_json_object("body", "$.messages[0].content"), "array<struct<type: string, text: string>>")
    asked = F.element_at(content, -1)["text"]
    words = F.size(tokens(asked)).cast("long")
    marks = (F.size(F.split("body", '"cache_control"')) - 1).cast("long")
    body = F.struct(F.array(F.struct(F.lit("text").alias("type"), asked.alias("text"))).alias("content"), F.lit("end_turn").alias("stop_reason"), F.struct(words.alias("input_tokens"), words.alias("output_tokens"), marks.alias("cache_creation_input_tokens")).alias("usage"))
    return requests.select("qid", F.to_json(body).alias("response"))


def usage(input_tokens: Column, output_tokens: Column, created: Column | None = None, read: Column | None = None) -> Column:
    zero = F.lit(0).cast("long")
    parts = {"input_tokens": input_tokens, "output_tokens": output_tokens, "cache_creation_input_tokens": created, "cache_read_input_tokens": read}
    return F.struct(*(F.coalesce(zero if v is None else v.cast("long"), zero).alias(k) for k, v in parts.items()))


def image_messages(images: DataFrame) -> DataFrame:
    """Image blocks in rank order: media_type, base64 data, and whether the block is flagged for caching."""
    kind = media_type(F.col("path")) if "path" in images.columns else F.lit("image/png")
    return images.select("qid", "rank", kind.alias("media_type"), F.translate(F.base64("content"), "\r\n", "").alias("data"), (F.col("rank") <= MAX_CACHED_IMAGES).alias("cached"))


def captions(pages: DataFrame, most_words: int = 512) -> DataFrame:
    """A stand-in for a captioning model: a page's first line and all its numbers, with token counts."""
    first = F.element_at(F.split("page_text", "\n"), 1)
    numbers = F.array_join(F.regexp_extract_all("page_text", F.lit("[0-9]+"), F.lit(0)), " ")
    caption = F.array_join(F.slice(F.split(F.concat_ws(" ", first, numbers), " "), 1, most_words), " ")
    return pages.select("doc_id", "source", "page", caption.alias("caption"), F.size(tokens(F.col("page_text"))).cast("long").alias("input_tokens"), F.size(tokens(caption)).cast("long").alias("output_tokens"))
