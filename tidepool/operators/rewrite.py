"""Query rewriting: as it is, by a glossary, or by a hypothetical passage; used for retrieval only."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators.generate import short_completion


def baseline(queries: DataFrame) -> DataFrame:
    return queries.withColumn("rewritten_query", F.col("query"))


def translate(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """Words that glossary (term, target) has are replaced; case doesn't matter for the lookup.

    The glossary joins by word, so it may be of any size; Spark broadcasts a small one by itself.
    """
    words = queries.select("qid", F.posexplode(F.split(F.coalesce("query", F.lit("")), " ")).alias("pos", "word"))
    found = words.join(glossary, F.lower("word") == F.col("term"), "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("target", "word").alias("w"))))
    texts = found.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["w"]), " ").alias("rewritten_query"))
    return queries.join(texts, "qid", "left")


#: Units that belong to the number before them.
UNITS = frozenset(("%", "percent", "million", "billion", "thousand", "kg", "g", "mg", "ml", "l", "km", "m", "cm", "mm", "usd", "eur", "krw", "won", "years", "months", "days", "hours"))
MOST_PHRASES = 1_000_000


def phrase_rewriter(glossary: list[tuple[str, str]]) -> Callable[[str | None], str]:
    """A function that replaces glossary phrases in a text, by one pass of an automaton of all of them.

    Texts and phrases are words between single spaces, compared in lower case. From left to right the longest phrase that begins at a word is
    taken; words with a digit (numbers, periods) and units that follow one are protected: no phrase reaches into them.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, target in glossary:
        words = phrase.lower().split(" ")
        automaton.add_word("\x1f" + "\x1f".join(words) + "\x1f", (len(words), target))
    if glossary:
        automaton.make_automaton()

    def rewritten(text: str | None) -> str:
        words = (text or "").split(" ")
        low = [w.lower() for w in words]
        numbers = [any(c.isdigit() for c in w) for w in low]
        kept = [n or i > 0 and numbers[i - 1] and w in UNITS for i, (w, n) in enumerate(zip(low, numbers, strict=True))]
        joined, place, at = "\x1f" + "\x1f".join(low) + "\x1f", {}, 0
        for i, w in enumerate(low):
            at += len(w) + 1
            place[at] = i + 1  # the word after the separator there
        found: dict[int, tuple[int, str]] = {}
        for end, (n, target) in automaton.iter(joined) if glossary else ():
            start = place[end] - n
            if not any(kept[start : start + n]) and n > found.get(start, (0, ""))[0]:
                found[start] = (n, target)
        out, i = [], 0
        while i < len(words):
            n, target = found.get(i, (1, words[i]))
            out.append(target)
            i += n
        return " ".join(out)

    return rewritten


def translate_phrases(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """queries with the glossary's phrases (term, target) replaced; the glossary is sent to every task, so it may hold MOST_PHRASES at most."""
    rows = [(r["term"], r["target"]) for r in glossary.where("term is not null and target is not null").orderBy("term", F.desc("target")).limit(MOST_PHRASES + 1).collect()]
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"a glossary of more than {MOST_PHRASES} phrases is too large to send; translate() joins one of any size by words")
    sent = queries.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series) -> pd.Series:
        return texts.map(phrase_rewriter(sent.value))

    return queries.withColumn("rewritten_query", rewritten("query"))


def hypothetical(queries: DataFrame, drafts: DataFrame) -> DataFrame:
    """The drafted passage (qid, passage) alone is searched with; a query without one stands for itself."""
    return queries.join(drafts.select("qid", "passage"), "qid", "left").withColumn("rewritten_query", F.coalesce("passage", "query")).drop("passage")


def written(queries: DataFrame, writer: Callable[[Column], Column], max_tokens: int | None = None) -> DataFrame:
    """Queries rewritten by a pluggable writer, whose completion is stripped and cut; an empty one leaves the query as it is."""
    text = short_completion(writer(F.col("query")), max_tokens)
    return queries.withColumn("rewritten_query", F.when(F.coalesce(text, F.lit("")) == "", F.col("query")).otherwise(text))


def drafts_from_conversations(conversations: DataFrame) -> DataFrame:
    """User turns as queries with the assistant's next turn as their draft (a stand-in for a drafting model).

    A conversation's turns are put in order in one task, as its turns are few; qid is conversation:turn.
    """
    order = W.partitionBy("conv_id").orderBy("turn")
    seen = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("next_text"))
    passage = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    return seen.where(F.col("role") == "user").select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("query"), passage.alias("passage"))


def annotated(hits: DataFrame, rewritten: DataFrame, variant: str) -> DataFrame:
    """hits with variant, original_query and rewritten_query."""
    names = rewritten.select("qid", F.col("query").alias("original_query"), "rewritten_query")
    return hits.join(names, "qid").withColumn("variant", F.lit(variant))
