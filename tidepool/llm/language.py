"""Language ID by rank-order profiles: the most frequent n-grams of a text against those of each language.

N-grams of one to three letters, with one mark for whatever parts words, are ranked by frequency;
the out-of-place distance sums, over the text's `size` first, how far each stands from its place in
the language's list (`size`, where it isn't in it). The nearest language wins, and the score is one
minus the distance's share of the largest possible.

Profiles are learnt from a sample bounded by `per_language` documents (expected number) of each
value of lang, picked by a hash of doc_id among the documents that are not held out; every document is
predicted from its whole text and nothing else. All values of lang are learnt; their profiles, `size` numbers
each, are sent to every task, and more than MOST_NUMBERS of these are an error instead.

Defined cases: null text or text without a letter is `und` with score 0, as is everything if nothing
could be learnt; null lang is not learnt from; equal distances go to the first language by name;
repeated rows count as often as they occur; long texts are counted in pieces. Input columns named
lang_pred or score give way to the results of predict(); keep_known() keeps every column. Empty
tables give empty results.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, held_out, plus, sampled, shielded, strings

SIZE, PER_LANGUAGE = 300, 1_000
MOST_NUMBERS = 20_000_000  # of all profiles: some 65,000 languages
UNKNOWN = "und"
_PIECE = 1 << 20
_BAR = np.uint64(1)  # parts words; no letter has this code point
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if a mark (part of words too), else 0."""
    if not _tables:
        kinds = {"L": 2, "M": 1}
        _tables.append(np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000))
    return _tables[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts), n-grams ascending; none for a text without a letter."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    any_letter = False
    text = text or ""
    for a in range(0, len(text), _PIECE):
        points = np.frombuffer(text[a : a + _PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        kind = _letters()[points]
        any_letter = any_letter or bool((kind == 2).any())
        x = np.concatenate([[_BAR], np.where(kind > 0, points, 1).astype(np.uint64), [_BAR]])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != _BAR) | (x[:-1] != _BAR)
        x = x[keep]
        two = x[:-1] << np.uint64(21) | x[1:]
        three = (x[:-2] << np.uint64(42) | two[1:])[x[1:-1] != _BAR]
        every = np.sort(np.concatenate([x[x != _BAR], two, three]))
        if len(every):
            new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            found.append((every[new], np.diff(np.append(new, len(every)))))
    if not any_letter:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(found) == 1:
        return found[0]
    names, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return names, np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)


def ranked(names: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    return names[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Every n-gram of a profile with the languages that have it and its rank there."""

    def __init__(self, lists: dict[str, list[int]], size: int = SIZE) -> None:
        self.languages, self.size = sorted(lists), size
        own = [np.array(lists[lang], np.int64).view(np.uint64) for lang in self.languages]
        every = np.concatenate([*own, np.empty(0, np.uint64)])
        language, rank = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int32) for x in ([np.full(len(v), j) for j, v in enumerate(own)], [np.arange(len(v)) for v in own]))
        order = np.argsort(every, kind="stable")
        self.names, first = np.unique(every[order], return_index=True)
        self.language, self.rank, self.cuts = language[order], rank[order], np.append(first, len(every))

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(*grams(text), self.size)
        if not len(top) or not len(self.names):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.names, top), len(self.names) - 1)
        place = np.flatnonzero(self.names[at] == top)
        starts, n = self.cuts[at[place]], self.cuts[at[place] + 1] - self.cuts[at[place]]
        entry = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # What a language's list has is nearer than `size` by so much.
        gain = np.bincount(self.language[entry], self.size - np.abs(self.rank[entry] - np.repeat(place, n)), len(self.languages))
        best = int(np.argmax(gain))
        return self.languages[best], float(gain[best]) / (len(top) * self.size)


def _count(batches):
    for b in batches:
        total: dict[str, dict[int, int]] = {}
        for lang, text in zip(strings(b.column("lang")), strings(b.column("text")), strict=True):
            own = total.setdefault(lang, {})
            names, counts = grams(text)
            for g, n in zip(names.tolist(), counts.tolist(), strict=True):
                own[g] = own.get(g, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])


def sample_of(sizes: dict[str, int], per_language: int) -> Column:
    """Whether a document is among the expected per_language of its language's number, by a 64-bit hash of doc_id."""
    place = F.xxhash64("doc_id", F.lit("language"))
    whole = [lang for lang, n in sizes.items() if n <= per_language]
    chosen = F.col("lang").isin(whole)
    for n in sorted({n for n in sizes.values() if n > per_language}):
        chosen |= F.col("lang").isin([lang for lang, m in sizes.items() if m == n]) & sampled(place, per_language, n)
    return chosen


def learn(docs: DataFrame, size: int = SIZE, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of all values of lang; what comes to the driver is `size` n-grams for each of them."""
    bounded_batches(docs.sparkSession)
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MOST_NUMBERS // size + 1).collect()}
    if len(sizes) * size > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS // size} values of lang: their profiles would be too large to send")
    sample = known.where(sample_of(sizes, per_language)) if sizes else known.limit(0)
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    lists: dict[str, list[int]] = {}
    for r in first.orderBy("lang", "r").collect():
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists, size)


def predict(docs: DataFrame, profiles: Profiles, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default) with lang_pred and score."""
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("lang_pred", "score")]
    source = docs.select(*names, *([] if "text" in names else ["text"]))
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        model = sent.value
        for b in batches:
            got = [model.predict(t) for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, plus(source.select(*names).schema, "lang_pred string, score double"))


def keep_known(docs: DataFrame, profiles: Profiles, min_score: float = 0.0) -> DataFrame:
    """docs whose language could be told with a score of at least min_score; the rest is rejected."""
    docs, restored = shielded(docs, {"text"})
    found = predict(docs, profiles)
    return restored(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)))
