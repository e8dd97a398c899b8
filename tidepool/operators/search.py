"""Exact top-k search of a table of queries: cosine, term-vector cosine and MaxSim; an approximate one by clusters.

A block of queries goes to the rows by a broadcast join, beside the first row of each part, and no row is moved. More queries and the rows
meet by one shuffle: ids and vectors are dealt to parts, queries to shares of about `block`, and each pair of a part and a share is a cell, in which
the queries come first and the rows stream by. One product scores a batch and only the best k rows of each query leave a part or cell; what a cell
doesn't hold of a row is joined to these. Work grows with queries times rows, as exact search must; what is moved grows with rows times shares, so
term vectors, which are small, have wide shares.

Of cells of term vectors most pairs are passed over by a bound of their cosine (_BestTerms), without a product of all places; the hits are those of all pairs.

Term vectors that an index holds (`with_terms`) are searched as they are. All order by (score at six places, then id).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.text import tokens
from tidepool.functions.vector import norm
from tidepool.schema import K_RETRIEVER, TF_BUCKETS

BLOCK = 2_048
WIDE = 32_768  # questions of a share whose term vectors rows are moved to; rows are moved once for each share
PART = 256 << 10  # bytes of a table that are worth a part
_ROWS = 1_024
_CELLS = 1 << 21  # scores that are looked at at once
_FIRST, _TILE = 256, 1_024  # rows of a cell's first step, questions of a product of term vectors
_HEAD, _SHARES = 192, 128  # places of a term vector that its bounds keep alone, shares of the others
_PAIRS = 2_048  # pairs that are scored exactly at once
_MANY, _SLACK = 0.02, 1e-4  # a part of a row's pairs that is too many to be scored one by one; more than what products of single precision are off by


def ranked(hits: DataFrame, k: int, by: str = "score", tie: str = "id", group: str = "qid") -> DataFrame:
    """The k best rows of each query with their rank from 1."""
    order = W.partitionBy(group).orderBy(F.desc(by), tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cut(parts: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The best k rows of each query (_q) by score at six places, then id."""
    table = pa.Table.from_batches(parts).combine_chunks()
    best = _places(np.asarray(table["_q"]), np.asarray(table["score"]), np.arange(len(table)), table["id"], k)
    return table.take(pa.array(best)).to_batches()


def _places(q: np.ndarray, score: np.ndarray, ref: np.ndarray, ids: pa.ChunkedArray, k: int) -> np.ndarray:
    """Where the best k of each query q are, in order; ids[ref] is the id of each."""
    rank = np.argsort(np.argsort(np.asarray(ids.to_pylist(), dtype=object), kind="stable"))
    order = np.lexsort((rank[ref], -np.round(score, 6), q))
    q = q[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


class _Best:
    """The best k rows of each of some questions, of rows that stream by.

    A row is held once, whatever the number of questions it is good for; a question's k-th score so far is the floor of what is held then.
    """

    def __init__(self, k: int, qids: pa.Array, model, score: Callable, own: list[str], kept: list[str]) -> None:
        self.k, self.qids, self.model, self.score, self.own, self.kept = k, qids, model, score, own, kept
        self.step = max(32, min(_ROWS, _CELLS // max(1, len(qids))))
        self.floor = np.full(len(qids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # question, score, place in rows
        self.rows: list[pa.RecordBatch] = []
        self.n_found = self.n_rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        for a in range(0, len(batch) if len(self.qids) else 0, self.step):
            some = batch.slice(a, self.step)
            got = self.score(self.model, *(some.column(c) for c in self.own))
            good = got >= np.maximum(self.floor - 1e-6, -1e300)
            if len(some) > self.k and np.count_nonzero(good) > 4 * self.k * len(self.qids):  # ties with the k-th are cut further down
                rounded = np.where(good, np.round(got, 6), -np.inf)
                good &= rounded >= np.partition(rounded, len(some) - self.k, axis=0)[len(some) - self.k]
            row, which = np.nonzero(good)
            value = got[row, which]
            true = np.isfinite(value) & (np.round(value, 6) >= self.floor[which])
            row, which, value = row[true], which[true], value[true]
            if not len(row):
                continue
            own, ref = np.unique(row, return_inverse=True)
            self.rows.append(some.select(["id", *self.kept]).take(pa.array(own)))
            self.found.append((which, value, ref + self.n_rows))
            self.n_rows, self.n_found = self.n_rows + len(own), self.n_found + len(row)
            if self.n_found > 4 * self.k * len(self.qids) + self.step:
                self.cut()

    def cut(self) -> pa.Table:
        q, score, ref = (np.concatenate(x) for x in zip(*self.found, strict=True))
        rows = pa.Table.from_batches(self.rows)
        best = _places(q, score, ref, rows["id"], self.k)
        q, score, ref = q[best], score[best], ref[best]
        used, ref = np.unique(ref, return_inverse=True)
        rows = rows.take(pa.array(used)).combine_chunks()
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
        full = last[np.diff(np.append(-1, last)) >= self.k]
        self.floor[q[full]] = np.round(score[full], 6)
        self.found, self.rows, self.n_found, self.n_rows = [(q, score, ref)], rows.to_batches(), len(q), len(used)
        return rows

    def told(self):
        """Batches of qid, id, score and the columns that are kept."""
        if not self.found:
            return
        rows, (q, score, ref) = self.cut(), self.found[0]
        for a in range(0, len(q), _ROWS):
            own = rows.take(pa.array(ref[a : a + _ROWS])).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(q[a : a + _ROWS])), columns[0], pa.array(score[a : a + _ROWS]), *columns[1:]], names=["qid", "id", "score", *self.kept])


class _BestTerms(_Best):
    """The same of term vectors (terms and tf), without the product of all places for most pairs.

    Places that count most in both sides are kept alone, the others are dealt to shares, and a vector's length within a share stands for its
    places there: by Cauchy and Schwarz the product of two such short vectors is no less than their cosine. Pairs whose bound reaches the question's k-th
    score so far are scored exactly, by whole numbers. Of rows that reach too many, as the first ones do, the product of all places is looked at before.
    """

    def __init__(self, k: int, qids: pa.Array, terms: pa.Array, tf: pa.Array, width: int) -> None:
        super().__init__(k, qids, None, None, ["terms", "tf"], [])
        self.width, self.asked = width, _Sparse(terms, tf)
        self.counts = np.zeros((len(qids), width), np.float32 if self.asked.tf.max(initial=0) < 1 << 24 else np.float64)
        self.counts[self.asked.row, self.asked.terms] = self.asked.tf
        self.sent = [(a, min(a + _TILE, len(qids))) for a in range(0, len(qids), _TILE)]
        self.tops = np.full((len(qids), k), -np.inf)
        self.room = np.empty(_ROWS * _TILE, np.float32), np.empty(_ROWS * _TILE, bool)  # products of a tile and what is marked of them, used again and again
        self.place: np.ndarray | None = None
        self.step = _FIRST

    def _begin(self, rows: _Sparse) -> None:
        """Learn from the first rows, and the questions, which places to keep alone; any choice gives right bounds."""
        weight = [np.bincount(s.terms, s.tf / s.length[s.row], self.width) for s in (self.asked, rows)]
        order = np.argsort(-(weight[0] + 1e-9) * (weight[1] + 1e-9), kind="stable")
        self.place = np.empty(self.width, np.int64)
        self.place[order] = np.where(np.arange(self.width) < _HEAD, np.arange(self.width), _HEAD + np.arange(self.width) % _SHARES)
        self.bounds = [np.ascontiguousarray(self._short(self.asked, lo, hi).T) for lo, hi in self.sent]
        self.asked.forget()

    def _short(self, s: _Sparse, lo: int = 0, hi: int | None = None) -> np.ndarray:
        n, hi = _HEAD + _SHARES, s.n if hi is None else hi
        own = slice(s.cuts[lo], s.cuts[hi])
        squares = np.bincount((s.row[own] - lo) * n + self.place[s.terms[own]], s.tf[own] * s.tf[own], (hi - lo) * n).reshape(hi - lo, n)
        return (np.sqrt(squares) / s.length[lo:hi, None]).astype(np.float32)

    def _whole(self, s: _Sparse) -> np.ndarray:
        m = np.zeros((s.n, self.width), self.counts.dtype)
        m[s.row, s.terms] = s.tf / s.length[s.row]
        return m

    def add(self, batch: pa.RecordBatch) -> None:
        a = 0
        while a < len(batch) and len(self.qids):
            some = batch.slice(a, self.step)
            a, self.step = a + self.step, min(_ROWS, 2 * self.step)
            rows = _Sparse(some.column("terms"), some.column("tf"))
            if self.place is None:
                self._begin(rows)
            bounds, whole, held = self._short(rows), self._whole(rows), []
            for (lo, hi), own in zip(self.sent, self.bounds, strict=True):
                least = np.maximum(self.floor[lo:hi] - _SLACK, 1e-30)
                got, flags = (x[: rows.n * (hi - lo)].reshape(rows.n, -1) for x in self.room)
                row, which = np.divmod(_marked(np.greater_equal(np.matmul(bounds, own, out=got), least.astype(np.float32), out=flags)), hi - lo)
                many = np.bincount(row, minlength=rows.n) > (hi - lo) * _MANY
                if many.any():
                    most, few = np.flatnonzero(many), ~many[row]
                    true = whole[most] @ self.counts[lo:hi].T
                    if len(most) > max(self.k, rows.n // 2):
                        least = np.maximum(least, np.partition(true, len(most) - self.k, axis=0)[len(most) - self.k] / self.asked.length[lo:hi] - _SLACK)
                    there, these = np.divmod(_marked(true >= np.where(least > 0, least * self.asked.length[lo:hi], np.inf).astype(true.dtype)), hi - lo)
                    row, which = np.append(row[few], most[there]), np.append(which[few], these)
                held += [self._exact(rows, row[b : b + _PAIRS], lo + which[b : b + _PAIRS]) for b in range(0, len(row), _PAIRS)]
            self._keep(some, *(np.concatenate(x) for x in zip(*held, strict=True))) if held else None

    def _exact(self, rows: _Sparse, row: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs and their scores, those below the floors left out."""
        size = rows.cuts[row + 1] - rows.cuts[row]
        start = np.cumsum(size) - size
        at = np.repeat(rows.cuts[row] - start, size)
        at += np.arange(len(at))
        there = np.repeat(which * self.width, size)
        there += rows.terms.take(at)
        dots = np.add.reduceat(self.counts.reshape(-1).take(there) * rows.tf.take(at).astype(np.float64), start)
        score = dots / (rows.length[row] * self.asked.length[which])
        good = (dots > 0) & (np.round(score, 6) >= self.floor[which])
        return row[good], which[good], score[good]

    def _keep(self, some: pa.RecordBatch, row: np.ndarray, which: np.ndarray, value: np.ndarray) -> None:
        if not len(row):
            return
        own, ref = np.unique(row, return_inverse=True)
        self.rows.append(some.select(["id"]).take(pa.array(own)))
        self.found.append((which, value, ref + self.n_rows))
        self.n_rows, self.n_found = self.n_rows + len(own), self.n_found + len(row)
        order = np.lexsort((-value, which))
        q, score = which[order], np.round(value[order], 6)
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        nth = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        new = np.full((len(start), self.k), -np.inf)
        best = nth < self.k
        new[np.repeat(np.arange(len(start)), np.diff(np.append(start, len(q))))[best], nth[best]] = score[best]
        self.tops[q[start]] = np.sort(np.concatenate([self.tops[q[start]], new], axis=1), axis=1)[:, -self.k :]
        self.floor[q[start]] = self.tops[q[start], 0]
        if self.n_found > 4 * self.k * len(self.qids) + _ROWS:
            self.cut()


def _beside(corpus: DataFrame, queries: DataFrame, k: int, own: list[str], prepare: Callable, score: Callable, asked: list[str], kept: list[str], parts: int) -> DataFrame:
    """The best k rows of each query in each part of corpus, for one share of queries: these come with a part's first row, by a broadcast join, so no row is moved."""
    share = queries.agg(F.collect_list(F.struct("qid", *asked)).alias("_asks")).select(F.lit(True).alias("_first"), "_asks")
    rows = corpus.select("id", *own, *kept).coalesce(parts)
    rows = rows.withColumn("_first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0).join(F.broadcast(share), "_first", "left")

    def run(batches):
        best = None
        for b in batches:
            if not len(b):
                continue
            if best is None:
                asks = b.column("_asks").slice(0, 1).flatten()
                columns = dict(zip([f.name for f in asks.type], asks.flatten(), strict=True))
                best = _Best(k, columns["qid"], prepare(*(columns[c] for c in asked)) if len(asks) else None, score, own, kept)
            best.add(b)
        if best is not None:
            yield from best.told()

    schema = T.StructType([queries.schema["qid"], corpus.schema["id"], T.StructField("score", T.DoubleType()), *(corpus.schema[c] for c in kept)])
    return rows.select("id", *own, *kept, "_asks").mapInArrow(run, schema)


def _scored(corpus: DataFrame, queries: DataFrame, k: int, own: list[str], prepare: Callable, score: Callable, block: int, payload: DataFrame | None = None, asked: list[str] | None = None, size: int | None = None, hold: Callable | None = None) -> DataFrame:
    """The k best rows of each query: qid, score, rank and corpus' columns but own, which both sides have and are compared by.

    payload: where the other columns are joined from, if not from corpus; ids are unique in it.
    asked: the columns of queries that one share is compared by, if they aren't own; size: the number of queries, if it is known.
    hold: what finds the best rows of a cell of k, qids and own, if not _Best; rows that are equal in own then meet in one cell, and all but the first k of them are left out.
    """
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = queries.count() if size is None else size
    shares = max(1, -(-size // block))
    told = int(str(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    types = {c: dict(corpus.dtypes)[c] for c in ("id", *own)} | {"qid": dict(queries.dtypes)["qid"]}
    others = [c for c in (corpus if payload is None else payload).columns if c not in (*own, "id")]
    if size <= min(block, BLOCK):
        asks = queries if asked else queries.select("qid", *(F.col(c).cast(types[c]).alias(c) for c in own))
        kept = [c for c in others if c in corpus.columns]
        found = _beside(corpus, asks, k, own, prepare, score, asked or own, kept, max(1, min(1 << 20, -(-told // PART))))
        return ranked(found.withColumn("score", F.round("score", 6)), k).select("qid", "score", "id", *kept, "rank")
    most = 4 * n if hold is None else max(n, min(2 * n, 32))  # a cell of hold has its questions to make ready and its floors to find
    parts = max(1, min(most // shares if hold is None else -(-most // shares), -(-told // PART)))  # each part gives k rows of each query, so a small table is few
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda c, m: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    like = F.lit(None).cast("long") if hold is None else F.xxhash64(*own)
    rows = corpus.select(dealt(["id"] if hold is None else own, parts).alias("_p"), each(shares).alias("_s"), F.lit(1).alias("_kind"), like.alias("_like"), "id", null("qid", types["qid"]), *own)
    asks = queries.select(each(parts).alias("_p"), dealt(["qid"], shares).alias("_s"), F.lit(0).alias("_kind"), null("_like", "long"), null("id", types["id"]), "qid", *(F.col(c).cast(types[c]).alias(c) for c in own))
    met = rows.unionByName(asks)
    if hold is None:
        met = met.repartition(n, "_p", "_s").sortWithinPartitions("_p", "_s", "_kind")
    else:
        met = met.repartitionById(parts * shares, F.col("_p") * shares + F.col("_s")).sortWithinPartitions("_p", "_s", "_kind", "_like", "id")

    def run(batches):
        last, asked, best, copies = None, [], None, None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in ("_p", "_s", "_kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if last != (cell := tuple(keys[lo, :2].tolist())):
                    if best is not None:
                        yield from best.told()
                    last, asked, best, copies = cell, [], None, _Copies(k, own)
                part = b.slice(lo, hi - lo)
                if not keys[lo, 2]:
                    asked.append(part)
                    continue
                if best is None and asked:
                    every = pa.Table.from_batches(asked).combine_chunks()
                    qids, columns = every["qid"].combine_chunks(), [every[c].combine_chunks() for c in own]
                    best, asked = _Best(k, qids, prepare(*columns), score, own, []) if hold is None else hold(k, qids, *columns), []
                if best is not None:
                    best.add(part if hold is None else copies.left_out(part))
        if best is not None:
            yield from best.told()

    schema = T.StructType([queries.schema["qid"], corpus.schema["id"], T.StructField("score", T.DoubleType())])
    best = ranked(met.mapInArrow(run, schema).withColumn("score", F.round("score", 6)), k)
    source = corpus if payload is None else payload
    return best.join(source.select("id", *others), "id").select("qid", "score", "id", *others, "rank") if others else best


class _Copies:
    """Leaves out rows that k rows before them are equal to; equal rows follow one another, by _like, a hash of theirs, then by id."""

    def __init__(self, k: int, own: list[str]) -> None:
        self.k, self.own, self.seen, self.last = k, own, 0, None

    def left_out(self, part: pa.RecordBatch) -> pa.RecordBatch:
        like, keep = np.asarray(part.column("_like")), np.ones(len(part), bool)
        same = np.append(self.last is not None and self.last[0] == like[0], like[1:] == like[:-1])
        columns = [part.column(c) for c in self.own]
        for i in np.flatnonzero(np.append(same[1:], False) | same).tolist():
            if same[i] and (self.last[1] if i == 0 else [c[i - 1] for c in columns]) == [c[i] for c in columns]:
                self.seen += 1
            else:
                self.seen = 0
            keep[i] = self.seen < self.k
        if not same[-1]:
            self.seen = 0
        self.last = like[-1], [c[-1] for c in columns]
        return part.filter(pa.array(keep))


def _dense(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / n  # a zero vector is similar to nothing: its scores are not finite


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = K_RETRIEVER, block: int = BLOCK) -> DataFrame:
    """The k rows of corpus (id, vector, ...) nearest to each of queries (qid, vector)."""
    return _scored(corpus, queries, k, ["vector"], lambda v: _unit(_dense(v)).T, lambda q, v: _unit(_dense(v)) @ q, block)


def others_topk(corpus: DataFrame, queries: DataFrame, k: int = K_RETRIEVER, block: int = BLOCK, search: Callable | None = None) -> DataFrame:
    """The k nearest rows of each query that is a row of the corpus itself (qid is its id): all rows but its own."""
    hits = (search or cosine_topk)(corpus, queries, k + 1, block=block).where("id <> qid").drop("rank")
    return ranked(hits, k)


class _Hashes(dict):
    """The hash of each token that a process has met lately."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        self[token] = found = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")
        return found


_HASHES = _Hashes()  # of the few tokens too long for _heads()
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32), 4, axis=0).ravel()


def _heads(tokens: pa.Array) -> np.ndarray:
    """The first four bytes of each token's MD5 as a number; of tokens of up to 55 bytes, one block of the digest, for thousands at once."""
    tokens = tokens.cast(pa.binary())
    cuts = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64) if len(tokens) else np.zeros(1, np.int64)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    out = np.empty(len(tokens), np.uint32)
    for a in range(0, len(tokens), 4_096):
        start, size = cuts[a : a + 4_096][: len(tokens) - a], np.diff(cuts[a : a + 4_097])
        long_ = size > 55
        n = np.where(long_, 0, size)
        own, row = np.zeros((len(n), 64), np.uint8), np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own[row, at] = data[start[row] + at]
        own[np.arange(len(n)), n] = 0x80
        words = np.ascontiguousarray(own.view("<u4").T).astype(np.uint32)
        words[14] = n * 8
        w, x, y, z = (np.full(len(n), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            if i < 16:
                mixed, g = z ^ (x & (y ^ z)), i
            elif i < 32:
                mixed, g = y ^ (z & (x ^ y)), 5 * i + 1
            elif i < 48:
                mixed, g = x ^ y ^ z, 3 * i + 5
            else:
                mixed, g = y ^ (x | ~z), 7 * i
            mixed = mixed + w + _SINES[i] + words[g % 16]
            w, z, y, x = z, y, x, x + ((mixed << _TURNS[i]) | (mixed >> (np.uint32(32) - _TURNS[i])))
        out[a : a + 4_096] = (w + np.uint32(0x67452301)).byteswap()
        for i in np.flatnonzero(long_):
            out[a + i] = _HASHES[tokens[a + int(i)].as_py().decode()]
    return out


def _term_counts(column: pa.Array, width: int) -> np.ndarray:
    """Counts of hashed terms, a row for each list of tokens; each distinct token is hashed once."""
    flat = column.flatten().dictionary_encode()
    place = _heads(flat.dictionary).astype(np.int64) % width
    sizes = np.asarray(column.value_lengths().fill_null(0))
    key = np.repeat(np.arange(len(column)) * width, sizes)
    if len(key):
        key += place[np.asarray(flat.indices)]
    return np.bincount(key, minlength=len(column) * width).reshape(len(column), width).astype(np.float32)


def _dense_terms(terms: pa.Array, tf: pa.Array, width: int) -> np.ndarray:
    """The same of places and counts as with_terms() gives them."""
    sizes = np.asarray(terms.value_lengths().fill_null(0))
    m = np.zeros((len(terms), width), np.float32)
    m[np.repeat(np.arange(len(terms)), sizes), np.asarray(terms.flatten())] = np.asarray(tf.flatten())
    return m


def _sizes(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))


def _asked_terms(terms: pa.Array, tf: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = _dense_terms(terms, tf, width)
    return m.T, _sizes(m)


class _Sparse:
    """Lists of places and counts as flat arrays, with the length of each vector, that of zero vectors as infinite."""

    def __init__(self, terms: pa.Array, tf: pa.Array) -> None:
        sizes = np.asarray(terms.value_lengths().fill_null(0)).astype(np.int64)
        self.n, self.cuts = len(sizes), np.append(0, np.cumsum(sizes))
        self.row = np.repeat(np.arange(self.n), sizes)
        self.terms, self.tf = np.asarray(terms.flatten()).astype(np.int64), np.asarray(tf.flatten()).astype(np.int64)
        squares = np.bincount(self.row, self.tf * self.tf, self.n)
        self.length = np.where(squares > 0, np.sqrt(squares), np.inf)

    def forget(self) -> None:
        """All but the lengths."""
        self.row = self.terms = self.tf = self.cuts = None


def _marked(flags: np.ndarray) -> np.ndarray:
    """Where flags, few of which are set, are true, as places in all of them; eight are looked at at once."""
    flat = flags.reshape(-1)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    at, bit = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[at] * 8 + bit, np.flatnonzero(flat[whole:]) + whole])


def _term_cosines(model: tuple[np.ndarray, np.ndarray], m: np.ndarray) -> np.ndarray:
    """Cosines of rows of counts with the asked ones, those of 0 and of zero vectors as no score.

    Products of counts are whole numbers, which single precision holds exactly below 2 ** 24; no sum is beyond the product of both lengths.
    """
    (q, long_), own = model, _sizes(m)
    exact = len(own) == 0 or own.max() * long_.max(initial=0) < 1 << 24
    dots = m @ q if exact else m.astype(np.float64) @ q.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(dots > 0, dots / (own[:, None] * long_), -np.inf)


def hashed_terms(text: Column) -> Column:
    """The default embedder of texts: their tokens, which searches hash and count."""
    return tokens(text)


def text_topk(corpus: DataFrame, queries: DataFrame, k: int = K_RETRIEVER, width: int = TF_BUCKETS, block: int = BLOCK, embed: Callable[[Column], Column] = hashed_terms) -> DataFrame:
    """The k rows of corpus (id, text, ...) whose hashed term vectors are nearest to those of queries (qid, query).

    Rows that share no term with a query are no hits of it. embed gives the terms of a text, or its vector (array<double>).
    """
    index, asked = corpus.withColumn("_t", embed(F.col("text"))), queries.select("qid", embed(F.col("query")).alias("_t"))
    if dict(index.dtypes)["_t"] != "array<string>":
        return cosine_topk(index.withColumnRenamed("_t", "vector"), asked.withColumnRenamed("_t", "vector"), k, block)
    n = queries.count()
    if n > block:
        return _terms_topk(counted(index.select("id", "_t"), width), counted(asked, width), k, width, n, block, corpus)
    prepare = lambda terms, tf: _asked_terms(terms, tf, width)
    return _scored(index, counted(asked, width), k, ["_t"], prepare, lambda q, t: _term_cosines(q, _term_counts(t, width)), block, corpus, ["terms", "tf"], n)


def counted(rows: DataFrame, width: int = TF_BUCKETS) -> DataFrame:
    """rows with terms and tf in place of their tokens, _t, the last column."""

    def run(batches):
        for b in batches:
            for a in range(0, len(b), _ROWS):
                part = b.slice(a, _ROWS)
                m = _term_counts(part.column("_t"), width)
                row, place = np.nonzero(m)
                cuts = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                terms, tf = (pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (place, m[row, place]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], terms, tf], names=[*part.schema.names[:-1], "terms", "tf"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))]))


def with_terms(points: DataFrame, width: int = TF_BUCKETS) -> DataFrame:
    """points (id, text, ...) with terms, the places and counts of their term vector as an index keeps them; each row's come from its own text."""
    return counted(points.withColumn("_t", tokens(F.col("text"))), width)


def terms_topk(index: DataFrame, queries: DataFrame, k: int = K_RETRIEVER, width: int = TF_BUCKETS, block: int = BLOCK) -> DataFrame:
    """text_topk over an index of with_terms(): nothing is tokenised or hashed again but the queries.

    A product with the queries' matrix, not a join on terms: of 1,024 places nearly every row shares one with nearly
    every query, so a join makes as many rows as there are pairs and shuffles them.
    """
    asked = with_terms(queries.select("qid", F.col("query").alias("text")), width).select("qid", "terms", "tf")
    return _terms_topk(index, asked, k, width, queries.count(), block)


def _terms_topk(index: DataFrame, asked: DataFrame, k: int, width: int, n: int, block: int, payload: DataFrame | None = None) -> DataFrame:
    """Both sides with terms and tf; n queries. More than one block of them are dealt to wide shares, as rows are moved once for each."""
    wide = WIDE if n > block == BLOCK else block
    hold = lambda k, qids, terms, tf: _BestTerms(k, qids, terms, tf, width)
    return _scored(index, asked, k, ["terms", "tf"], lambda terms, tf: _asked_terms(terms, tf, width), lambda q, terms, tf: _term_cosines(q, _dense_terms(terms, tf, width)), wide, payload, size=n, hold=hold)


def maxsim_topk(pages: DataFrame, tokens: DataFrame, k: int = K_RETRIEVER, block: int = 512) -> DataFrame:
    """The k rows of pages (id, vectors, ...) by late interaction with queries (qid, vectors).

    Each query vector counts with its best cosine among the page's vectors; the sum is the score.
    """

    def flat(vectors):
        sizes = np.asarray(vectors.value_lengths())
        return _unit(_dense(vectors.flatten())), np.cumsum(sizes) - sizes

    def score(model, vectors):
        (q, starts), (rows, first) = model, flat(vectors)
        return np.add.reduceat(np.maximum.reduceat(rows @ q.T, first, axis=0), starts, axis=1)

    some = F.size("vectors") > 0
    return _scored(pages.where(some), tokens.where(some).select("qid", "vectors"), k, ["vectors"], flat, score, block)


def centres_of(corpus: DataFrame, clusters: int, most: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by spherical k-means on at most about `most` of corpus' rows, picked by a hash of id."""
    n = corpus.count()
    place = F.xxhash64("id", F.lit(seed))
    some = corpus if n <= most else corpus.where(place < F.lit(-(1 << 63) + (most << 64) // n))
    rows = [r["vector"] for r in some.where(norm(F.col("vector")) > 0).orderBy(place, "id").select("vector").limit(2 * most).collect()]
    if not rows:
        return np.empty((0, 0))
    v = _unit(np.array(rows, np.float64))
    centres = v[np.random.default_rng(seed).permutation(len(v))[:clusters]]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
    return centres


def cluster_topk(corpus: DataFrame, queries: DataFrame, k: int = K_RETRIEVER, clusters: int = 64, probes: int = 44, chunk: int = 4_096, block: int = BLOCK) -> DataFrame:
    """An approximate cosine top-k: rows lie with their nearest centre, queries look at `probes` of them, scores are exact.

    Clusters of more than `chunk` rows are parted by id and queries go to every part. With fewer probes
    than clusters a query may miss rows, never invent any; where its clusters hold fewer than k rows it gets those.
    """
    spark = corpus.sparkSession
    centres = spark.sparkContext.broadcast(centres_of(corpus, clusters))

    def nearest(most: int):
        def run(batches):
            c = centres.value
            for b in batches:
                v = _unit(_dense(b.column("vector")))
                near = np.nan_to_num(v @ c.T) if len(c) else np.zeros((len(v), 1))
                top = np.argsort(-near, axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "_c"])

        return run

    def placed(df: DataFrame, most: int) -> DataFrame:
        got = df.mapInArrow(nearest(most), T.StructType([*df.schema.fields, T.StructField("_c", T.ArrayType(T.IntegerType()))]))
        return got.select(*df.columns, F.explode("_c").alias("_c"))

    rows = placed(corpus.select("id", "vector"), 1)
    sizes = rows.groupBy("_c").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_parts"))  # as many rows as clusters
    here = rows.join(F.broadcast(sizes), "_c").select("_c", F.pmod(F.xxhash64("id"), "_parts").cast("int").alias("_p"), "id", "vector", F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"))
    asks = placed(queries.select("qid", "vector"), probes).join(F.broadcast(sizes), "_c").select("_c", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"), F.lit(None).cast(corpus.schema["id"].dataType).alias("id"), "vector", "qid")

    def meet(batches):
        last, held, index = None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("_c", "_p")], axis=1)
            asked = np.asarray(b.column("id").is_null())
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asked[1:] != asked[:-1])) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if last != (key := tuple(keys[lo].tolist())):
                    last, held, index = key, [], None
                part = b.slice(lo, hi - lo)
                v = _unit(_dense(part.column("vector")))
                if not asked[lo]:
                    held.append((part.column("id"), v))
                    continue
                if index is None and held:
                    index = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
                for a in range(0, len(part) if index else 0, 256):
                    got = np.round(v[a : a + 256] @ index[1].T, 6)
                    good = np.isfinite(got)
                    if got.shape[1] > k:
                        good &= got >= np.partition(np.where(good, got, -np.inf), got.shape[1] - k, axis=1)[:, -k][:, None]
                    q, i = np.nonzero(good)
                    cut = _cut([pa.RecordBatch.from_arrays([pa.array(q), pa.array(got[q, i]), index[0].take(pa.array(i))], names=["_q", "score", "id"])], k) if len(q) else []
                    for c in cut:
                        yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(np.asarray(c.column("_q")) + a)), c.column("id"), c.column("score")], names=["qid", "id", "score"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = here.unionByName(asks).repartition(n, "_c", "_p").sortWithinPartitions("_c", "_p", F.col("id").asc_nulls_last())
    found = met.mapInArrow(meet, T.StructType([queries.schema["qid"], corpus.schema["id"], T.StructField("score", T.DoubleType())]))
    return ranked(found, k)
