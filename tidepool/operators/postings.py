"""Exact term search over an inverted index: postings in impact order, block maxima, a max-score cut.

A text's score is BM25: each of a question's terms gives its count, times how rare the term is, times the posting's impact, which
follows from the term's count and the text's length alone. An index keeps its texts, so that they are cut once, and is built of them without a shuffle:
each task gathers texts of SEGMENT tokens, TEXTS of them at most, to a segment and writes its postings by term, in blocks of at most BLOCK, highest impacts first, with
the block's highest. A posting is a place in its segment and an impact; a segment's ids are a row of their own. Terms are in order within a segment, so
row groups are skipped by term; a term that a third of all texts have is blocks of many segments, never one list.
A second table has each term's number of texts and its highest impact.

Searching: a question's rare terms and one best block of the others give some texts part of their score; the best of these are
scored exactly, and the k-th of their scores is a floor that the k-th best text reaches. Terms whose highest scores together stay below it can't make a hit by
themselves, so only blocks of the others are read, and of these only the blocks that can reach the floor with all else at its highest. Where the others
are in many texts all the same, the rest is read too, which leaves no term to guess. A block meets the questions that ask for it once, as a list; the blocks
of a segment and a share of questions meet in one task, which adds up its texts' scores and keeps those that may be among the best k of all and of the segment.
These are scored exactly by their texts. All other steps are joins and aggregates; a question's own rows are its terms.

Defined cases: null and empty texts and questions, and questions of unknown terms, have no hits; equal scores (at six places) go to the smaller id; a term that a
question repeats counts as often. Ids are unique. A text of more tokens than a segment is a segment of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.text import tokens
from tidepool.operators.search import ranked
from tidepool.schema import K_RETRIEVER

BLOCK, SEGMENT, TEXTS, RARE, FIRST_FOR_EACH, MOST_TERMS = 128, 2_000_000, 50_000, 1_000, 8, 10_000
SHARE = 128  # questions that meet a segment at once
DENSE = 1 / 16  # of all texts: as many postings of a question's essential terms make it read all of its terms
SENT = 200_000  # rows that are sent to all tasks at most
K1, B = 1.2, 0.75
_SLACK = 1e-5  # scores are told apart at six places, impacts of postings are of single precision
_POSTINGS = "segment long, term string, block int, top float, n int, places array<int>, impacts array<float>, ids array<string>"


def impact(tf, length, mean):
    """What a term gives that is in a text of some length so many times, of numbers or columns."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def rarity(texts: Column, n: Column) -> Column:
    """How much a term counts that is in n of all texts."""
    return F.log(1 + (texts - n + 0.5) / (n + 0.5))


class _Segment:
    """Texts gathered until there are enough, then written as postings."""

    def __init__(self, mean: float, block: int) -> None:
        self.mean, self.block = mean, block
        self.clear()

    def clear(self) -> None:
        self.ids: list[pa.Array] = []
        self.words: list[pa.Array] = []
        self.lens: list[np.ndarray] = []  # tokens of each text
        self.size = self.texts = 0

    def add(self, ids: pa.Array, words: pa.Array) -> None:
        flat = words.flatten()
        self.words.append(flat)
        self.lens.append(np.asarray(words.value_lengths().fill_null(0)).astype(np.int64))
        self.ids.append(ids.cast(pa.string()))
        self.size += len(flat)
        self.texts += len(ids)

    def rows(self, number: int):
        """Batches of blocks, by term, then impact; the ids come last."""
        if not self.ids:
            return
        every = pa.concat_arrays(self.ids)
        lens = np.concatenate(self.lens)
        text = np.repeat(np.arange(len(lens)), lens)
        coded = pa.concat_arrays(self.words).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        key, tf = np.unique(rank[np.asarray(coded.indices)] * len(lens) + text, return_counts=True)
        term, text = key // len(lens), key % len(lens)
        value = impact(tf, lens[text], self.mean)
        order = np.lexsort((text, -value, term))
        term, text, value = term[order], text[order], value[order].astype(np.float32)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        within = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
        start = np.flatnonzero(within % self.block == 0)
        ends = np.append(start[1:], len(term))
        for a in range(0, len(start), 4_096):
            s, e = start[a : a + 4_096], ends[a : a + 4_096]
            cuts = pa.array(np.append(s, e[-1]) - s[0], pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[s[0] : e[-1]], kind)) for x, kind in ((text, pa.int32()), (value, pa.float32()))]
            columns = [pa.array(np.full(len(s), number)), names.take(pa.array(term[s])).cast(pa.string()), pa.array((within[s] // self.block).astype(np.int32)), pa.array(value[s]), pa.array((e - s).astype(np.int32)), *lists, pa.nulls(len(s), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)
        kinds = [pa.string(), pa.int32(), pa.float32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
        yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.nulls(1, k) for k in kinds), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)], names=_COLUMNS)


_COLUMNS = [c.split()[0] for c in _POSTINGS.split(", ")]


class PostingsIndex:
    """An index at a path of points (id, text), which it scores exactly; open one that is there, or build() it."""

    def __init__(self, spark: SparkSession, path: str, points: DataFrame) -> None:
        self.spark, self.path, self.points = spark, path.rstrip("/"), points.select("id", "text")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def build(self, segment: int = SEGMENT, block: int = BLOCK) -> PostingsIndex:
        self.points.withColumn("n", F.size(tokens(F.col("text")))).write.parquet(f"{self.path}/texts")
        self._table("texts").agg(F.count("*").alias("texts"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean")).write.parquet(f"{self.path}/stats")
        mean = self._table("stats").first()["mean"] or 1.0

        def run(batches):
            own, number = _Segment(mean, block), TaskContext.get().partitionId() << 32
            for b in batches:
                for a in range(0, len(b), 512):
                    part = b.slice(a, 512)
                    own.add(part.column("id"), part.column("t"))
                    if own.size >= segment or own.texts >= TEXTS:
                        yield from own.rows(number)
                        own.clear()
                        number += 1
            yield from own.rows(number)

        split = self._table("texts").where("n > 0").select("id", tokens(F.col("text")).alias("t"))
        written = split.mapInArrow(run, _POSTINGS).write
        written.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/postings")
        terms = self._table("postings").where("term is not null").groupBy("term").agg(F.sum("n").alias("texts"), F.max("top").alias("most"), F.min("segment").alias("first"))
        terms.write.option("compression", "zstd").parquet(f"{self.path}/terms")
        return self

    def _asked(self, questions: DataFrame) -> DataFrame:
        """(qid, term, weight, texts, most, first): a question's terms, what they count, their highest scores and first segment."""
        stats = self._table("stats")  # one row
        words = questions.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
        known = words.join(self._table("terms"), "term").join(F.broadcast(stats.select(F.col("texts").alias("all"))), F.lit(True))
        weight = F.col("times") * rarity(F.col("all"), F.col("texts"))
        return known.select("qid", "term", weight.alias("weight"), "texts", (weight * F.col("most")).alias("most"), "first")

    def _postings(self, asked: DataFrame) -> DataFrame:
        """The postings of the terms that are asked for; few enough of them are a filter that skips row groups."""
        terms = [r[0] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        found = self._table("postings").where("term is not null").drop("ids")
        return found.where(F.col("term").isin(terms)) if len(terms) <= MOST_TERMS else found

    def plan(self, questions: DataFrame, k: int, write) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(terms of questions with floors, blocks read first, blocks read then), the blocks with qid and weight."""
        asked = write(self._asked(questions), "asked")
        postings = self._postings(asked)
        upto = F.sum("texts").over(W.partitionBy("qid").orderBy("texts", "term"))
        first = asked.withColumn("upto", upto).join(postings, "term").where((F.col("upto") <= RARE) | (F.col("segment") == F.col("first")) & (F.col("block") == 0))
        first = first.select("qid", "term", "segment", "block", "weight", "n", "places", "impacts")
        sums = first.select("qid", "segment", "weight", F.inline(F.arrays_zip("places", "impacts"))).groupBy("qid", "segment", "places").agg(F.sum(F.col("weight") * F.col("impacts")).alias("score"))
        promising = ranked(sums.withColumn("id", F.struct("segment", "places")), FIRST_FOR_EACH * k).select("qid", "segment", "places")
        scored = self._exact(write(self._named(promising), "promising"), asked)
        floor = ranked(scored, k).where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        below = F.sum("most").over(W.partitionBy("qid").orderBy("most", "term"))  # of a term and all that give less
        told = asked.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - _SLACK)
        told = told.withColumn("essential", below >= F.col("floor")).withColumn("all", F.sum("most").over(W.partitionBy("qid")))
        many = F.sum(F.when(F.col("essential"), F.col("texts"))).over(W.partitionBy("qid")) > DENSE * self._table("stats").first()["texts"]
        told = write(told.withColumn("essential", F.col("essential") | many), "floors")
        can = F.col("weight") * F.col("top") + F.col("all") - F.col("most") >= F.col("floor")
        second = told.where("essential").join(postings, "term").where(can)
        return told, first, second.select("qid", "term", "segment", "block", "weight", "most", "all", "floor", "n", "places", "impacts")

    def search(self, questions: DataFrame, k: int = K_RETRIEVER, write=None) -> DataFrame:
        """qid, rank, id and score of the k best texts of each of questions (qid, query)."""
        from tidepool.sources.storage import written

        write = write or written
        told, _, _ = self.plan(questions, k, write)
        return ranked(self._exact(write(self._open(told, k), "candidates"), told), k).select("qid", "rank", "id", "score")

    def _open(self, told: DataFrame, k: int) -> DataFrame:
        """(qid, _id) of the texts that may be among a question's best k by what is read of them, at most about k and ties of each segment where all is read."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shares = max(1, -(-told.select("qid").distinct().count() // SHARE))
        own = told.withColumn("_s", F.pmod(F.xxhash64("qid"), F.lit(shares)).cast("int"))
        own = own.withColumn("_q", F.dense_rank().over(W.partitionBy("_s").orderBy("qid")) - 1)
        rest = F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0))
        each = own.groupBy("_s", "_q", "qid").agg(F.first("floor").alias("floor"), rest.alias("rest"))
        each = each.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("_q", "qid", "floor", "rest"))).alias("questions"))
        asks = own.where("essential").groupBy("term", "_s").agg(F.collect_list(F.struct("_q", "weight", "most", "all", "floor")).alias("asks"))
        asks = F.broadcast(asks) if told.count() <= SENT else asks
        can = F.filter("asks", lambda a: a["weight"] * F.col("top") + a["all"] - a["most"] >= a["floor"])
        blocks = self._postings(told.where("essential")).join(asks, "term").withColumn("asks", can).where(F.size("asks") > 0)
        blocks = blocks.select("segment", "_s", "term", F.col("asks._q").alias("who"), F.col("asks.weight").alias("weights"), "places", "impacts")
        heads = self._table("postings").where("ids is not null").select("segment", "ids").crossJoin(F.broadcast(each))
        met = blocks.unionByName(heads, allowMissingColumns=True).repartition(n, "segment", "_s").sortWithinPartitions("segment", "_s", F.col("term").asc_nulls_first())

        def run(batches):
            scores = head = None

            def best():
                ids, who = head.column("ids").flatten(), head.column("questions").flatten()
                qids, floor, rest = who.field("qid"), np.asarray(who.field("floor")), np.asarray(who.field("rest"))
                for q in np.flatnonzero(scores.any(axis=1)):
                    least = max(floor[q], np.partition(scores[q], len(ids) - k)[len(ids) - k] - 2 * _SLACK if len(ids) >= k else 0.0)
                    place = pa.array(np.flatnonzero((scores[q] > 0) & (scores[q] + rest[q] >= least)))
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.full(len(place), q))), ids.take(place)], names=["qid", "_id"])

            for b in batches:
                heads = ~np.asarray(b.column("questions").is_null())
                lists = []
                for name in ("who", "weights", "places", "impacts"):
                    column = b.column(name)
                    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                    lists.append((np.asarray(column.flatten()), np.append(0, np.cumsum(size))))
                for i, first in enumerate(heads):
                    if first:
                        if head is not None:
                            yield from best()
                        head = b.slice(i, 1)
                        scores = np.zeros((len(head.column("questions").flatten()), len(head.column("ids").flatten())))
                        continue
                    who, weights, places, impacts = (v[cut[i] : cut[i + 1]] for v, cut in lists)
                    scores[who[:, None], places] += weights[:, None] * impacts
            if head is not None:
                yield from best()

        return met.select("who", "weights", "places", "impacts", "ids", "questions").mapInArrow(run, T.StructType([told.schema["qid"], T.StructField("_id", T.StringType())]))

    def _named(self, places: DataFrame) -> DataFrame:
        """(qid, id) of (qid, segment, places)."""
        ids = self._table("postings").where("ids is not null").select("segment", F.posexplode("ids").alias("places", "id"))
        return places.join(ids, ["segment", "places"]).select("qid", F.col("id").alias("_id"))

    def _exact(self, found: DataFrame, asked: DataFrame) -> DataFrame:
        """(qid, id, score) of found (qid, _id), a written table, by the texts and all terms of the questions (qid, term, weight)."""
        listed = F.array_sort(F.collect_list(F.struct("term", "weight")))
        terms = asked.groupBy("qid").agg(listed.alias("asked")).select("qid", F.col("asked.term").alias("terms"), F.col("asked.weight").alias("weights"))  # a question's terms
        found = F.broadcast(found) if found.count() <= SENT else found
        both = self._table("texts").join(found, F.col("_id") == F.col("id").cast("string")).select("qid", "id", tokens(F.col("text")).alias("own")).join(terms, "qid")
        mean = self._table("stats").first()["mean"] or 1.0

        def run(batches):
            for b in batches:
                for a in range(0, len(b), 1_024):
                    part = b.slice(a, 1_024)
                    own, terms = part.column("own"), part.column("terms")
                    sizes, wanted = (np.asarray(x.value_lengths()).astype(np.int64) for x in (own, terms))
                    both = pa.concat_arrays([own.flatten(), terms.flatten()]).dictionary_encode()
                    code = np.asarray(both.indices).astype(np.int64)
                    words = max(1, len(both.dictionary))
                    n = int(sizes.sum())
                    held, tf = np.unique(np.repeat(np.arange(len(part)), sizes) * words + code[:n], return_counts=True)
                    row = np.repeat(np.arange(len(part)), wanted)
                    key = row * words + code[n:]
                    at = np.minimum(np.searchsorted(held, key), max(0, len(held) - 1))
                    there = held[at] == key if len(held) else np.zeros(len(key), bool)
                    value = np.asarray(part.column("weights").flatten())[there] * impact(tf[at[there]], sizes[row[there]], mean)
                    yield pa.RecordBatch.from_arrays([part.column("qid"), part.column("id"), pa.array(np.round(np.bincount(row[there], value, len(part)), 6))], names=["qid", "id", "score"])

        schema = T.StructType([both.schema["qid"], both.schema["id"], T.StructField("score", T.DoubleType())])
        return both.mapInArrow(run, schema)

    def reads(self, questions: DataFrame, k: int = K_RETRIEVER, write=None) -> DataFrame:
        """qid, n_read and n_all: how many of its terms' postings a question's search reads, and how many these have."""
        from tidepool.sources.storage import written

        told, first, second = self.plan(questions, k, write or written)
        names = ["qid", "term", "segment", "block", "n"]
        read = first.select(*names).unionByName(second.select(*names)).distinct().groupBy("qid").agg(F.sum("n").alias("n_read"))
        return told.groupBy("qid").agg(F.sum("texts").alias("n_all")).join(read, "qid")
