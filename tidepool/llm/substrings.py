"""Exact substring dedup by seed and extend: remove words of repeated passages of `length` words or more.

Seeds: every `length`-word window holds length - seed + 1 seeds of `seed` words, and winnowing keeps
those with the least hash (all of them, where they tie), so two equal windows keep equal seeds.
Seeds that occur once in the corpus are done with. Around each of the others the match is extended
both ways, a word at a time, to all windows that chose it: windows are equal where hashes of all their
words agree, so thousands of copies extend together and no pair of them is formed. The repeats found
are merged into maximal runs of words. Seeds with more than `hot` occurrences have their windows dealt
out one by one and only counted, by partial aggregates, and what occurs twice is joined back; windows that
one task meets twice are settled there. So a passage that a third of the documents share does not meet in one task.

Words are hashed twice, independently: seeds by one, windows by the other, both 64 bits wide and mixed at
every level, so no arrangement of words makes two windows meet. Two different windows pass for equal only
where 64 bits agree among windows of one seed, whose 64 bits are independent of those.

Defined cases: null text has no words and stays null; texts of fewer than `length` words stay as they
are; a passage that repeats within one document goes in all its places, as do exact copies of whole
documents; rows count by position, so null or repeated doc_ids do no harm. Empty tables give empty results.
Input columns named like a result (n_words, n_removed, kept_sha256, kept) or _row or runs give way to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import IS_DARK, bounded_batches, materialise, numbered, partitions, plus, runs_hash, slices, slide, strings, word_spans, words_hash

LENGTH, SEED, HOT = 35, 12, 1_000
COLD, SETTLED, DEALT = 0, 1, 2


def seeds(words: np.ndarray, row: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash at each place, least seed hash of each window, is that window within one row)."""
    own = runs_hash(words, seed) | np.uint64(1)
    least = slide(own, length - seed + 1, np.minimum)
    return own, least, row[length - 1 :] == row[: len(least)]


def chosen(own: np.ndarray, least: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places whose seed is the least of some window that lies within one row."""
    width = len(own) - len(least) + 1
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(whole, least, np.uint64(0))
    return np.flatnonzero(slide(padded, width, np.maximum) == own)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of a slice."""
    starts, ends, row = word_spans(IS_DARK[data], offsets)
    return words_hash(data, starts, ends), row, starts, ends


def _emit_seeds(length: int, seed: int):
    def run(batches):
        for b in batches:
            for a, _, data, offsets in slices(b.column("text")):
                words, row, _, _ = _words(data, offsets)
                if len(words) < length:
                    continue
                own, least, whole = seeds(words, row, length, seed)
                at = chosen(own, least, whole)
                ids = np.asarray(b.column("_row"))[a + row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own[at].view(np.int64))], names=["_row", "seed"])

    return run


def _emit_windows(length: int, seed: int):
    """Rows (key, _row, first, n, windows, kind): SETTLED windows repeat for sure, a row of _row -1 tells other tasks so; DEALT ones, of hot seeds, come one by one."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column("_row"))
            wanted, hot = b.column("seeds"), b.column("hot")
            for a, e, data, offsets in slices(b.column("text")):
                words, row, starts, ends = _words(data, offsets)
                if len(words) < length:
                    continue
                _, least, whole = seeds(words, row, length, seed)
                want = np.zeros(len(least), bool)
                is_hot = np.zeros(len(least), bool)
                cuts = np.searchsorted(row[: len(least)], np.arange(e - a + 1))
                for r in range(e - a):
                    lo, hi = cuts[r], cuts[r + 1]
                    if hi > lo:
                        some = np.sort(np.asarray(wanted[a + r].values).view(np.uint64))
                        at = np.minimum(np.searchsorted(some, least[lo:hi]), len(some) - 1)
                        want[lo:hi] = some[at] == least[lo:hi]
                        if len(hot[a + r].values):
                            is_hot[lo:hi] = np.isin(least[lo:hi], np.asarray(hot[a + r].values).view(np.uint64))
                at = np.flatnonzero(want & whole)
                if not len(at):
                    continue
                full = runs_hash(words_hash(data, starts, ends, 1), length)[at]
                first = np.searchsorted(row, row[at])
                _, back, times = np.unique(full, return_inverse=True, return_counts=True)
                twice = times[back] > 1
                # Settled windows: one row for each distinct one goes on to tell other tasks.
                lead = np.zeros(len(at), bool)
                lead[np.unique(full, return_index=True)[1]] = True
                p = np.flatnonzero(twice)
                if len(p):
                    yield _rows(np.zeros(len(p), np.int64), ids[a + row[at[p]]], at[p] - first[p], None, SETTLED, at[p], row[at[p]])
                for told, pick in ((False, ~twice), (True, twice & lead)):
                    for kind, some in ((COLD, pick & ~is_hot[at]), (DEALT, pick & is_hot[at])):
                        p = np.flatnonzero(some)
                        if len(p):
                            owner = np.full(len(p), -1, np.int64) if told else ids[a + row[at[p]]]
                            group = row[at[p]] if kind == COLD else np.arange(len(p))
                            yield _rows(least[at[p]].view(np.int64), owner, at[p] - first[p], full[p], kind, at[p], group)

    return run


def _rows(key, ids, first, full, kind: int, at, group) -> pa.RecordBatch:
    """A row for each run of neighbouring windows with one key (and one group)."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(key) != 0) | (np.diff(group) != 0)
    start = np.flatnonzero(new)
    bounds = np.append(start, len(at)).astype(np.int32)
    n = np.diff(bounds)
    windows = pa.ListArray.from_arrays(bounds, pa.array(full.view(np.int64))) if full is not None else pa.ListArray.from_arrays(np.zeros(len(start) + 1, np.int32), pa.array([], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(ids[start]), pa.array(first[start].astype(np.int32)), pa.array(n, pa.int32()), windows, pa.array(np.full(len(start), kind, np.int32))], names=["key", "_row", "first", "n", "windows", "kind"])


def _meet(batches):
    """Of the windows of each key (rows come sorted by it), those that occur twice: (_row, first, n)."""
    held: list[tuple] = []
    last = None

    def settle():
        ids = np.concatenate([h[0] for h in held])
        first = np.concatenate([h[1] for h in held])
        sizes = np.concatenate([h[2] for h in held])
        full = np.concatenate([h[3] for h in held])
        if len(full) < 2:
            return None
        told = np.repeat(ids < 0, sizes)
        _, back, times = np.unique(full, return_inverse=True, return_counts=True)
        sure = np.zeros(len(times), bool)
        sure[back[told]] = True
        dup = ((times > 1) | sure)[back] & ~told
        if not dup.any():
            return None
        place = np.arange(len(full)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
        owner = np.repeat(ids, sizes)
        at = np.flatnonzero(dup)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(owner[at]) != 0) | (np.diff(place[at]) != 1)
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(at)))
        return pa.RecordBatch.from_arrays([pa.array(owner[at[start]]), pa.array(place[at[start]].astype(np.int32)), pa.array(n.astype(np.int32))], names=["_row", "first", "n"])

    for b in batches:
        key = np.asarray(b.column("key"))
        if not len(key):
            continue
        windows = b.column("windows")
        flat, offsets = np.asarray(windows.values), np.asarray(windows.offsets)
        ids, first = np.asarray(b.column("_row")), np.asarray(b.column("first"))
        # Whole keys of a batch settle together; only the last may go on in the next batch.
        tail = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if held and key[0] != last:
            if (done := settle()) is not None:
                yield done
            held = []
        for lo, hi in ((0, tail), (tail, len(key))):
            if hi > lo:
                held.append((ids[lo:hi], first[lo:hi], np.diff(offsets[lo : hi + 1]), flat[offsets[lo] : offsets[hi]]))
                if hi == tail and tail:
                    if (done := settle()) is not None:
                        yield done
                    held = []
        last = key[-1]
    if held and (done := settle()) is not None:
        yield done


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(docs with _row, spans): spans has _row and runs, an array of (first, n) of repeated windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = numbered(docs, "documents")
    slim = base.select("_row", F.coalesce("text", F.lit("")).alias("text"))
    found = materialise(slim.mapInArrow(_emit_seeds(length, seed), "_row long, seed long"), "seeds")
    again = found.groupBy("seed").agg(F.count("*").alias("times")).where("times > 1")
    again = materialise(again, "seeds-again")  # a table, so that the join below can split a seed of very many places
    wanted = found.join(again, "seed").groupBy("_row").agg(F.collect_set("seed").alias("seeds"), F.collect_set(F.when(F.col("times") > hot, F.col("seed"))).alias("hot"))
    wanted = materialise(wanted, "repeated-seeds")
    some = slim.join(wanted, "_row")
    windows = some.mapInArrow(_emit_windows(length, seed), "key long, _row long, first int, n int, windows array<long>, kind int")
    windows = materialise(windows, "windows")
    open_ = windows.where(F.col("kind") == COLD).select("key", "_row", "first", "windows").repartition(partitions(spark), "key").sortWithinPartitions("key")
    met = open_.mapInArrow(_meet, "_row long, first int, n int")
    dealt = windows.where(F.col("kind") == DEALT).select("key", F.element_at("windows", 1).alias("window"), "_row", "first")
    twice = dealt.groupBy("key", "window").agg(F.sum(F.when(F.col("_row") < 0, 2).otherwise(1)).alias("times")).where("times > 1").select("key", "window")
    twice = materialise(twice, "windows-again")  # a table, so that the join below can split a window of very many places
    again = dealt.where("_row >= 0").join(twice, ["key", "window"], "left_semi").select("_row", "first", F.lit(1).alias("n"))
    all_ = met.unionByName(again).unionByName(windows.where(F.col("kind") == SETTLED).select("_row", "first", "n"))
    return base, all_.groupBy("_row").agg(F.collect_list(F.struct("first", "n")).alias("runs"))


def _covered(runs, length: int) -> list[tuple[int, int]]:
    """Merged (start, end) in words of runs of windows."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["first"], r["first"] + r["n"] + length - 1) for r in runs or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _kept(length: int, names: list[str], texts: bool):
    def run(batches):
        for b in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for text, runs in zip(strings(b.column("text")), strings(b.column("runs")), strict=True):
                words = (text or "").encode().split()
                spans = _covered(runs, length)
                left, last = [], 0
                for s, e in spans:
                    left += words[last:s]
                    last = e
                left += words[last:]
                joined = b" ".join(left)
                n_words.append(len(words)), n_removed.append(len(words) - len(left)), digest.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    kept.append(text if not spans else joined.decode())
            columns = [*(b.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if texts else [])], names=[*names, "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT, columns: list[str] | None = None, texts: bool = True) -> DataFrame:
    """columns of docs (all but text) with n_words, n_removed, kept_sha256 and, with texts, kept (the words kept)."""
    own = {"n_words", "n_removed", "kept_sha256", "kept", "text", "_row", "runs"}
    names = [c for c in (docs.columns if columns is None else columns) if c not in own]
    base, spans = repeats(docs.select(*names, "text"), length, seed, hot)
    joined = base.join(spans, "_row", "left").select(*names, "text", "runs")
    schema = plus(joined.select(*names).schema, "n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return joined.mapInArrow(_kept(length, names, texts), schema)
