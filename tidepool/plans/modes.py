"""The modes of answering as plans over a table of questions: each stage is a DataFrame of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import ids
from tidepool.operators import fuse, generate, rerank, rewrite, route, search
from tidepool.operators.index import Collection
from tidepool.schema import CANDIDATE_POOL, K_CAPTION_MODE, K_HYBRID_MODE, K_TEXT_MODE, K_VISION_MODE, PER_RETRIEVER


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass
class TextRetriever:
    """Blocks (id, source, page, block_type, text) by an embedder of texts: their terms, hashed, unless another is given."""

    blocks: DataFrame
    embed: Callable[[Column], Column] = search.hashed_terms

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search.text_topk(self.blocks, queries, k, embed=self.embed)


@dataclass
class IndexRetriever:
    """Points that keep their terms, as a collection or a table; nothing is embedded anew."""

    index: Collection | DataFrame

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search.terms_topk(self.index.scan() if isinstance(self.index, Collection) else self.index, queries, k)


@dataclass
class RewritingRetriever:
    """Searches with rewritten queries and notes what they were."""

    inner: Retriever
    variant: str
    glossary: DataFrame | None = None
    drafts: DataFrame | None = None
    writer: Callable[[Column], Column] | None = None
    max_tokens: int | None = None
    phrases: DataFrame | None = None

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if self.glossary is not None:
            new = rewrite.translate(queries, self.glossary)
        elif self.phrases is not None:
            new = rewrite.translate_phrases(queries, self.phrases)
        elif self.drafts is not None:
            new = rewrite.hypothetical(queries, self.drafts)
        elif self.writer is not None:
            new = rewrite.written(queries, self.writer, self.max_tokens)
        else:
            new = rewrite.baseline(queries)
        hits = self.inner.search(new.select("qid", F.col("rewritten_query").alias("query")), k)
        return rewrite.annotated(hits, new, self.variant)


@dataclass
class SharedRetriever:
    """Hits of several tables of questions, whose texts are searched once, the best `most` of each; a text that wasn't searched or more hits are an error."""

    hits: DataFrame
    most: int

    @classmethod
    def of(cls, inner: Retriever, asked: list[DataFrame], most: int, write: Callable[[DataFrame], DataFrame]) -> SharedRetriever:
        """asked: tables of questions (query), which may share texts; the hits are written, with a row of no hit for each text."""
        texts = None
        for a in asked:
            one = a.where("query is not null").select("query")
            texts = one if texts is None else texts.unionByName(one)
        texts = texts.distinct().select(F.col("query").alias("qid"), "query")
        found = inner.search(texts, most)
        return cls(write(texts.select("qid").join(found, "qid", "left").withColumnRenamed("qid", "_text")), most)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if k > self.most:
            raise ValueError(f"{self.most} hits of each question were searched, not {k}")
        own = queries.where("query is not null").select("qid", F.col("query").alias("_text"))
        met = own.join(self.hits.withColumn("_there", F.lit(True)), "_text", "left")
        unknown = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a question that wasn't searched")).cast("int")).otherwise(F.col("rank"))
        return met.withColumn("rank", unknown).where(F.col("rank") <= k).drop("_text", "_there")


@dataclass
class RerankedRetriever:
    """Fetches a pool and keeps the best by the scorer, which sees the original query."""

    inner: Retriever
    pool: int = CANDIDATE_POOL
    scorer: rerank.Scorer = rerank.term_coverage

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return rerank.rerank(self.inner.search(queries, max(k, self.pool)), queries, k, self.scorer)


@dataclass
class VisionRetriever:
    """Pages (id, source, page, vectors) by late interaction; tokens: qid, vectors."""

    pages: DataFrame
    tokens: DataFrame

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search.maxsim_topk(self.pages, self.tokens.join(queries.select("qid"), "qid", "left_semi"), k)


@dataclass
class WrittenRetriever:
    """Writes its hits, so that the answer, the context and the trace of a question rest on one search."""

    inner: Retriever
    write: Callable[[DataFrame], DataFrame]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.write(self.inner.search(queries, k))


@dataclass
class OnceRetriever:
    """Searches a table of questions (qid, query) when it is first asked, and writes the best `most` hits, which serve every mode and smaller k."""

    inner: Retriever
    questions: DataFrame
    most: int
    write: Callable[[DataFrame], DataFrame]
    hits: DataFrame | None = None

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if k > self.most:
            raise ValueError(f"{self.most} hits of each question are searched, not {k}")
        if self.hits is None:
            self.hits = self.write(self.inner.search(self.questions, self.most))
        return self.hits.where(F.col("rank") <= k).join(queries.select("qid"), "qid", "left_semi")


SENT = 200_000  # pages that hits may name for their names to be sent to all tasks


def hydrate(hits: DataFrame, pages: DataFrame, write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Hits with their page's text, joined after the rank filter; what has no page keeps a null.

    With write, hits are written first and only the pages that they name are joined: these are looked for where the pages are, so that no other page moves.
    """
    if write is not None:
        hits = write(hits)
        named = hits.select("source", "page").distinct()
        if named.count() <= SENT:
            own = pages.join(F.broadcast(named), ["source", "page"], "left_semi")
            return write(hits.join(own.select("source", "page", "page_text"), ["source", "page"], "left"))
    return hits.join(pages.select("source", "page", "page_text"), ["source", "page"], "left")


def _answers(queries: DataFrame, hits: DataFrame, mode: str) -> DataFrame:
    return generate.extractive_answers(queries, hits).withColumn("mode", F.lit(mode))


def text_only(queries: DataFrame, retriever: Retriever, k: int = K_TEXT_MODE) -> dict[str, DataFrame]:
    hits = retriever.search(queries, k)
    return {"hits": hits, "context": generate.passages(hits), "answers": _answers(queries, hits, "text_only")}


def caption_only(queries: DataFrame, captions: DataFrame, k: int = K_CAPTION_MODE, write: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """captions: id, source, page, text; write, if given, writes the hits before they are used."""
    hits = search.text_topk(captions.withColumn("block_type", F.lit("caption")), queries, k)
    hits = hits if write is None else write(hits)
    return {"hits": hits, "context": generate.passages(hits), "answers": _answers(queries, hits, "caption")}


def vision_only(queries: DataFrame, retriever: Retriever, pages: DataFrame, k: int = K_VISION_MODE, write: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    hits = hydrate(retriever.search(queries, k), pages, write)
    return {"hits": hits, "answers": _answers(queries, hits.withColumn("text", F.coalesce("page_text", F.lit(""))), "vision_only")}


def hybrid(queries: DataFrame, text: Retriever, vision: Retriever, pages: DataFrame, k: int = K_HYBRID_MODE, per_retriever: int = PER_RETRIEVER, write: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """route -> {text, vision} -> merge -> render -> answer as one plan; questions are read when it is set up, all else when it runs."""
    routed = route.route(queries)
    text_hits, vision_hits = text.search(queries, per_retriever), vision.search(queries, per_retriever)
    fused = fuse.rrf(text_hits, vision_hits, routed.select("qid", "w_text", "w_vision"))
    top = hydrate(fuse.fused_topk(fused, k), pages, write)
    answers = _answers(queries, top.withColumn("text", F.coalesce("page_text", F.lit(""))), "hybrid")
    return {"route": routed, "retrieve_text": text_hits, "retrieve_vision": vision_hits, "merge": fused, "render": top, "answers": answers}


def hybrid_graph(queries: DataFrame, text: Retriever, vision: Retriever, pages: DataFrame, write: Callable[[DataFrame], DataFrame], k: int = K_HYBRID_MODE, per_retriever: int = PER_RETRIEVER) -> dict[str, DataFrame]:
    """The same stages as a graph of written tables, so that a stage runs once, can be looked at, and isn't run again when a later one fails."""
    done = {"route": write(route.route(queries))}
    done["retrieve_text"] = write(text.search(queries, per_retriever))
    done["retrieve_vision"] = write(vision.search(queries, per_retriever))
    done["merge"] = write(fuse.rrf(done["retrieve_text"], done["retrieve_vision"], done["route"].select("qid", "w_text", "w_vision")))
    done["render"] = hydrate(fuse.fused_topk(done["merge"], k), pages, write)
    done["answers"] = write(_answers(queries, done["render"].withColumn("text", F.coalesce("page_text", F.lit(""))), "hybrid_graph"))
    return done


def caption_points(captions: DataFrame) -> DataFrame:
    """The points of a caption index: id, source, page, caption and text, which repeats it; empty captions are none."""
    kept = captions.where(F.char_length("caption") > 0)
    return kept.select(ids.caption_id(F.col("source"), F.col("page")).alias("id"), "source", "page", "caption", F.col("caption").alias("text"))
