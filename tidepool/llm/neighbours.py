"""Approximate nearest neighbours by cross-polytope hashing, candidates reranked exactly.

Each table rotates unit vectors by rounds of random signs and a fast Hadamard transform and assigns
them to the nearest signed axis; `hashes` such axes (one or two) together are a bucket, as many as
leave at least `fill` vectors to a bucket, for each dimension by the number of its vectors.

Probes follow the data, by one rule at every size. Each query first looks where its `first` nearest axes
of each table say. The cosine of its k-th best hit then tells how likely a vector that near is to lie
elsewhere: vectors drawn at that cosine are hashed, and the query goes on to so many more axes that all
tables together miss at most `miss` of them. Only a query that has found fewer than k by then looks at every
vector. So close neighbours cost few probes, spread-out ones many: candidates() gives what each query looks at.

Hashes are worked out once and written. Probes are rows of (bucket, query); they meet vectors by a shuffle on (table, bucket);
buckets of many vectors are parted, and so are the queries of a bucket of many queries, so no task holds a hot bucket, and
a query's vector joins it once for each part, not for each probe. What a part finds for a query is
cut to its best k + 1 there, ties to the smaller id: rows grow with queries times probes, not with pairs.
Scores are cosines of the original vectors in double precision.

Equal vectors are one: the k + 1 smallest ids of each are indexed, which loses nothing since equal
scores go to the smaller id, and equal queries are searched once. No query has a cap on candidates.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null ids,
take no part; only vectors of one dimension are compared; ids that repeat are vectors of their own but
yield one row, with the best score; other columns are left out. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, materialise, partitions

TABLES, FIRST, MISS, FILL, CHUNK, SEED = 8, 2, 0.06, 1_000, 2_000, 20
DRAWN = 256  # vectors drawn for each query to see where its neighbours may lie
WHOLE = -1  # the table whose one bucket holds every vector
_ROWS = 4_096


def hadamard(v: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = v.shape
    h = 1
    while h < d:
        v = v.reshape(n, -1, 2, h)
        v = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2)
        h *= 2
    return v.reshape(n, d) / np.sqrt(d)


def rotated(v: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    """Rows padded to a power of two and put through three rounds of signs and transform."""
    d = 1 << max(0, v.shape[1] - 1).bit_length()
    rng = np.random.default_rng([seed, table, part, d])
    y = np.zeros((len(v), d))
    y[:, : v.shape[1]] = v
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def _padded(d: int) -> int:
    return 1 << max(0, d - 1).bit_length()


def _axes(y: np.ndarray) -> np.ndarray:
    """Each row's signed axes, nearest first; axis a is a, its negative the padded dimension + a."""
    return np.argsort(-np.concatenate([y, -y], axis=1), axis=1, kind="stable")


def _nearest(y: np.ndarray) -> np.ndarray:
    """Each row's nearest signed axis."""
    at = np.abs(y).argmax(axis=-1)
    return at + y.shape[-1] * (np.take_along_axis(y, at[..., None], -1)[..., 0] < 0)


def codes(v: np.ndarray, table: int, hashes: int, seed: int) -> np.ndarray:
    """Each row's bucket of a table."""
    code = np.zeros(len(v), np.int64)
    for p in range(hashes):
        code = code * (2 * _padded(v.shape[1])) + _nearest(rotated(v, table, p, seed))
    return code


def width_for(v: np.ndarray, cosine: np.ndarray, ranks: list[list[np.ndarray]], turned: list[list[np.ndarray]], miss: float, seed: int) -> np.ndarray:
    """How many nearest axes of each hash a query must look at, so that all tables miss at most `miss` of the vectors at a cosine."""
    d = _padded(v.shape[1])
    rng = np.random.default_rng([seed, d, DRAWN])
    noise = [rng.normal(size=(DRAWN, d)) / np.sqrt(d) for _ in ranks[0]]
    near, far = cosine[:, None, None], np.sqrt(np.maximum(0.0, 1.0 - cosine * cosine))[:, None, None]
    missed = np.ones((len(v), 2 * d))
    for table_ranks, table_turned in zip(ranks, turned, strict=True):
        need = np.zeros((len(v), DRAWN), np.int64)
        for rank, y, g in zip(table_ranks, table_turned, noise, strict=True):
            axis = _nearest(near * y[:, None, :] + far * g)
            need = np.maximum(need, np.take_along_axis(rank, axis, 1))
        caught = np.zeros((len(v), 2 * d))
        np.add.at(caught, (np.arange(len(v))[:, None], need), 1.0 / DRAWN)
        missed *= 1.0 - np.cumsum(caught, axis=1)
    return np.argmax(missed <= miss + 1e-9, axis=1) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _groups(b: pa.RecordBatch, rows: int):
    """Slices of at most `rows` rows of one dimension and one number of hashes."""
    dim, hashes = np.asarray(b.column("dim")), np.asarray(b.column("hashes"))
    for d, h in sorted(set(zip(dim.tolist(), hashes.tolist(), strict=True))):
        same = b.filter(pa.array((dim == d) & (hashes == h)))
        for a in range(0, len(same), rows):
            yield d, h, same.slice(a, rows)


_DEALT = ["dim", "tab", "bucket", "id"]
_DEALT_SCHEMA = "dim int, tab int, bucket long, id long"


def _places(b: pa.RecordBatch, row: np.ndarray, tab: np.ndarray, bucket: np.ndarray):
    for a in range(0, len(row), 1 << 16):
        at = pa.array(row[a : a + (1 << 16)])
        yield pa.RecordBatch.from_arrays([b.column("dim").take(at), pa.array(tab[a : a + (1 << 16)].astype(np.int32)), pa.array(bucket[a : a + (1 << 16)].astype(np.int64)), b.column("id").take(at)], names=_DEALT)


def _deal(tables: int, seed: int):
    """A row for each table of each vector: its bucket there."""

    def run(batches):
        for b in batches:
            for _, h, same in _groups(b, _ROWS):
                unit = _unit(_matrix(same.column("vector")))
                for t in range(tables):
                    yield from _places(same, np.arange(len(unit)), np.full(len(unit), t), codes(unit, t, h, seed))

    return run


def _ask(tables: int, first: int, miss: float, seed: int):
    """A row for each bucket that a query looks into: the first ones, or if its cosine is told the others that it takes."""

    def run(batches):
        for b in batches:
            told = "cosine" in b.schema.names
            for d, h, same in _groups(b, 64):
                unit, size = _unit(_matrix(same.column("vector"))), 2 * _padded(d)
                turned = [[rotated(unit, t, p, seed) for p in range(h)] for t in range(tables)]
                axes = [[_axes(y) for y in row] for row in turned]
                least = min(first, size)
                wide = np.full(len(unit), least)
                if told:
                    cosine = np.asarray(same.column("cosine"))
                    some = np.flatnonzero(~np.isnan(cosine))
                    if len(some):
                        ranks = [[np.argsort(a, axis=1)[some] for a in row] for row in axes]
                        wide[some] = np.maximum(least, width_for(unit[some], np.clip(cosine[some], -1.0, 1.0), ranks, [[y[some] for y in row] for row in turned], miss, seed))
                    every = np.flatnonzero(np.isnan(cosine))  # fewer than k found
                    yield from _places(same, every, np.full(len(every), WHOLE), np.zeros(len(every)))
                for i in range(len(unit)):
                    if told and wide[i] <= least:
                        continue
                    steps = np.array(list(product(range(wide[i]), repeat=h)))
                    if told:
                        steps = steps[(steps >= least).any(axis=1)]
                    for t in range(tables):
                        code = np.zeros(len(steps), np.int64)
                        for p in range(h):
                            code = code * size + axes[t][p][i, steps[:, p]]
                        yield from _places(same, np.full(len(steps), i), np.full(len(steps), t), code)

    return run


def _meet(k: int, block: int = 64):
    """Of rows sorted by part, vectors before queries: each query's best k + 1 in each part."""

    def scaled(v: np.ndarray) -> np.ndarray:
        scale = np.abs(v).max(axis=1, keepdims=True)
        return np.where((scale > 1e100) | (scale < 1e-100), v / scale, v)

    def search(ids: np.ndarray, v: np.ndarray, lv: np.ndarray, queries: np.ndarray, q: np.ndarray):
        lq, most = np.sqrt((q * q).sum(axis=1)), min(len(ids), k + 1)
        for a in range(0, len(q), block):
            near = (q[a : a + block] @ v.T) / lv
            # All that rounding can't tell from the best k + 1, however many there are.
            least = np.partition(near, len(ids) - most, axis=1)[:, len(ids) - most] - 1e-12 * lq[a : a + block]
            own, other = np.nonzero(near >= least[:, None])
            own += a
            cuts = np.searchsorted(own, np.arange(a, a + len(near) + 1))
            lo = 0
            while lo < len(near):  # as many queries at once as have a bounded number of these
                hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + 50_000, "right")) - 1)
                o, w = own[cuts[lo] : cuts[hi]], other[cuts[lo] : cuts[hi]]
                score = (q[o] * v[w]).sum(axis=1) / (lq[o] * lv[w])
                order = np.lexsort((ids[w], -score, o))
                place = np.arange(len(o)) - (cuts[lo:hi] - cuts[lo])[o - a - lo]
                kept = order[place < k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(queries[o[kept]]), pa.array(ids[w[kept]]), pa.array(score[kept])], names=["q", "vec_id", "score"])
                lo = hi

    def run(batches):
        last, held, index = None, [], None
        for b in batches:
            if not len(b):
                continue
            keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("dim", "tab", "bucket", "part", "share")], axis=1)
            kind, ids = np.asarray(b.column("kind")), np.asarray(b.column("id"))
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                key = tuple(keys[lo].tolist())
                if key != last:
                    last, held, index = key, [], None
                v = scaled(_matrix(b.column("vector").slice(lo, hi - lo)))
                if kind[lo] == 0:
                    held.append((ids[lo:hi], v))
                elif held or index is not None:
                    if index is None:
                        every = np.concatenate([h[1] for h in held])
                        index, held = (np.concatenate([h[0] for h in held]), every, np.sqrt((every * every).sum(axis=1))), []
                    yield from search(*index, ids[lo:hi], v)

    return run


def usable(column: str) -> Column:
    """The vector has components, all finite, and not all zero."""
    return F.expr(f"size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({column}, x -> x <> 0)")


def _found(index: DataFrame, dealt: DataFrame, classes: DataFrame, asks: DataFrame, k: int, chunk: int) -> DataFrame:
    """(q, vec_id, score): the best k + 1 of each part that a query looks into."""
    spark, bucket = index.sparkSession, ["dim", "tab", "bucket"]
    # Vectors and queries of each bucket that both have: into how many parts of about `chunk` vectors (less, if long ones) and shares of queries they go.
    parts = F.ceil(F.greatest(F.col("vectors") / chunk, F.col("vectors") * F.col("dim") / (1_024 * chunk))).cast("int")
    sizes = dealt.groupBy(*bucket).agg(F.count("*").alias("vectors")).join(asks.groupBy(*bucket).agg(F.count("*").alias("queries")), bucket)
    sizes = materialise(sizes.select(*bucket, parts.alias("parts"), F.ceil(F.col("queries") / (2 * chunk)).cast("int").alias("shares")), "buckets")
    from_hash = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index_parts = dealt.join(sizes, bucket).select(*bucket, from_hash("parts").alias("part"), each("shares").alias("share"), F.lit(0).alias("kind"), "id").join(index.select("id", "own", "vector"), "id")
    query_parts = asks.join(sizes, bucket).select(*bucket, each("parts").alias("part"), from_hash("shares").alias("share"), F.lit(1).alias("kind"), "id").join(classes.select("id", "own", "vector"), "id")
    key = [*bucket, "part", "share"]
    met = index_parts.unionByName(query_parts).drop("id").withColumnRenamed("own", "id").repartition(partitions(spark), *key).sortWithinPartitions(*key, "kind")
    found = met.mapInArrow(_meet(k), "q long, vec_id long, score double").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k + 1 of each query with their rank r."""
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)


def _prepared(vectors: DataFrame, is_query: Column, k: int, tables: int, fill: int, seed: int) -> tuple[DataFrame, ...]:
    """(queries, one query of each vector, vectors that are indexed, their buckets)."""
    usable_ = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable("vector"))
    usable_ = usable_.withColumn("dim", F.size("vector"))
    one = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    index = usable_.select("id", "vector", "dim").distinct().withColumn("r", one).where(F.col("r") <= k + 1).drop("r")
    number = F.monotonically_increasing_id()  # ids may repeat: a row is known by its number
    # A row for each dimension that occurs: few, whatever the corpus; Spark sees their size and broadcasts them.
    axes = 2 * F.pow(F.lit(2.0), F.ceil(F.log2(F.col("dim").cast("double"))))
    hashes = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.log(F.greatest(F.lit(1.0), F.col("n") / fill)) / F.log(axes)))).cast("int")
    index = materialise(index.select(number.alias("id"), F.col("id").alias("own"), "vector", "dim"), "vectors")
    dims = materialise(index.groupBy("dim").agg(F.count("*").alias("n")).select("dim", "n", hashes.alias("hashes")), "dimensions")
    asked = usable_.where("asks").select("id", "vector", "dim")
    classes = materialise(asked.groupBy("vector", "dim").agg(F.min("id").alias("own")).join(dims, "dim").withColumn("id", number), "queries")
    dealt = materialise(index.join(dims, "dim").mapInArrow(_deal(tables, seed), _DEALT_SCHEMA), "dealt")
    return asked, classes, index, dealt


def _probed(prepared: tuple[DataFrame, ...], k: int, tables: int, first: int, miss: float, chunk: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first probes, what they find, further probes)."""
    _, classes, index, dealt = prepared
    asks = materialise(classes.mapInArrow(_ask(tables, first, miss, seed), _DEALT_SCHEMA), "first-probes")
    near = materialise(_found(index, dealt, classes, asks, k, chunk), "nearest")
    told = near.groupBy("q").agg(F.max(F.when(F.col("r") == k + 1, F.col("score"))).alias("cosine"))
    open_ = classes.join(told, F.col("q") == F.col("own"), "left").drop("q").withColumn("cosine", F.coalesce("cosine", F.lit(float("nan"))))
    return asks, near, materialise(open_.mapInArrow(_ask(tables, first, miss, seed), _DEALT_SCHEMA), "probes")


def _every(dealt: DataFrame, asks: DataFrame) -> DataFrame:
    """dealt with the bucket that holds every vector, where a query looks into it."""
    if asks.where(F.col("tab") == WHOLE).isEmpty():
        return dealt
    return dealt.unionByName(dealt.where("tab = 0").select("dim", F.lit(WHOLE).alias("tab"), F.lit(0).cast("long").alias("bucket"), "id"))


def candidates(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, first: int = FIRST, miss: float = MISS, fill: int = FILL, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(q, n, whole): how many different vectors each query looks at, and whether it looks at every one. As many rows as probes meet: for measuring, not for search."""
    bounded_batches(vectors.sparkSession)
    prepared = _prepared(vectors, is_query, k, tables, fill, seed)
    asks, _, more = _probed(prepared, k, tables, first, miss, chunk, seed)
    both = asks.unionByName(more).withColumnRenamed("id", "q")
    met = both.join(_every(prepared[3], more), ["dim", "tab", "bucket"])
    return met.groupBy("q").agg(F.countDistinct("id").alias("n"), F.max(F.col("tab") == WHOLE).alias("whole"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, first: int = FIRST, miss: float = MISS, fill: int = FILL, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row of vectors (vec_id, embedding) that is_query."""
    bounded_batches(vectors.sparkSession)
    prepared = asked, classes, index, dealt = _prepared(vectors, is_query, k, tables, fill, seed)
    _, near, asks = _probed(prepared, k, tables, first, miss, chunk, seed)
    more = _found(index, _every(dealt, asks), classes, asks, k, chunk)
    found = _best(near.drop("r").unionByName(more.drop("r")).groupBy("q", "vec_id").agg(F.max("score").alias("score")), k).drop("r")
    pairs = asked.select(F.col("id").alias("query_id"), "vector").join(classes.select("vector", F.col("own").alias("q")), "vector").join(found, "q").where("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
