"""A kept index of vectors for approximate cosine search: inverted lists of product-quantised residuals, exact reranking.

Building: coarse centres, about the square root of the rows of them, and a codebook for each of `parts` runs of
components are learnt from a sample (`SAMPLE` rows in expectation, picked by a hash of id). Every row goes to the list of its nearest centre with its
residual as `parts` bytes. Lists are the partitions of one Parquet table (id, code, vector), so a search opens the
files of the lists it probes, and of these only the codes' column; vectors are read of what is reranked. The model (centres, spreads
and sizes of lists, codebooks) is one small file beside it; it grows with the square root of the rows and is broadcast behind a check of its size.

Searching: a query's distance tables give the inner product with every code by `parts` lookups. It looks first into its nearest lists,
as many as hold twice the rows that are reranked, then in rounds into so many more that the rows grow STEP-fold. The score of the last row
that would be reranked is the floor of the next round: of its lists those are left out that can't hold better ones, by their centre's angle and
the angle within which SPREAD of their rows lie, and rows below it are passed over, so what leaves the lists grows with the logarithm of the
rows. The best `keep` rows by code are reranked by the cosine of whole vectors. On clustered vectors most lists are left out;
on vectors without structure codes of all lists are looked at, and vectors of few.

Lists of many rows are parted by a hash of id and each part gives its best `keep` rows, so a hot list is no single task's, nor do its
rows grow with the square of equal vectors. Rows without a usable vector (null, empty, of another size, zero, not finite) are left out; equal scores go to the smaller id.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.vector import norm
from tidepool.operators.search import _cut, _dense, _unit, ranked
from tidepool.schema import K_RETRIEVER

SAMPLE, PARTS, KEEP_FOR_EACH, STEP, SPREAD, CHUNK, SEED = 20_000, 16, 8, 8, 0.98, 4_096, 11
MOST_MODEL = 512 << 20  # bytes that may be broadcast: some four million lists of 16 components


def kmeans(v: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """At most k centres of rows by squared distance; an emptied centre stays where it was."""
    if not len(v):
        return np.zeros((0, v.shape[1]))
    centres = v[np.random.default_rng(seed).permutation(len(v))[:k]].copy()
    for _ in range(rounds):
        own = nearest(v, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(v: np.ndarray, centres: np.ndarray, step: int = 4_096) -> np.ndarray:
    """Each row's nearest centre by squared distance."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.empty(0, np.int64), *((v[a : a + step] @ centres.T - half).argmax(axis=1) for a in range(0, len(v), step))])


class Model:
    """Centres (unit vectors), codebooks (parts, 256, width), and of each list its rows and the angle that holds most of them."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, sizes: np.ndarray, spreads: np.ndarray) -> None:
        self.centres, self.books, self.sizes, self.spreads = centres, books, sizes, spreads

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def cut(self, v: np.ndarray) -> np.ndarray:
        """Rows as runs of components, filled up with zeros."""
        parts, _, width = self.books.shape
        wide = np.zeros((len(v), parts * width))
        wide[:, : v.shape[1]] = v
        return wide.reshape(len(v), parts, width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, angle to the centre) of unit vectors."""
        own = (unit @ self.centres.T).argmax(axis=1)
        runs = self.cut(unit - self.centres[own])
        code = np.stack([nearest(runs[:, p], self.books[p]) for p in range(len(self.books))], axis=1).astype(np.uint8)
        return own, code, np.arccos(np.clip((unit * self.centres[own]).sum(axis=1), -1.0, 1.0))

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """For each query its inner product with each entry of each codebook."""
        return np.einsum("qpw,pcw->qpc", self.cut(unit), self.books)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, books=self.books, sizes=self.sizes, spreads=self.spreads)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        told = np.load(io.BytesIO(raw))
        return cls(*(told[c] for c in ("centres", "books", "sizes", "spreads")))


def learn(points: DataFrame, n: int, lists: int | None = None, parts: int = PARTS, sample: int = SAMPLE) -> Model:
    """Centres and codebooks from a bounded sample of points (id, vector), which comes to the driver."""
    place = F.xxhash64("id", F.lit(SEED))
    some = points if n <= sample else points.where(place < F.lit(-(1 << 63) + (sample << 64) // n))
    rows = [r["vector"] for r in some.orderBy(place, "id").select("vector").limit(2 * sample).collect()]
    v = _unit(np.array(rows, np.float64)) if rows else np.zeros((0, 1))
    lists = max(1, min(len(v), lists or round(n**0.5)))
    centres = kmeans(v, lists)
    centres = centres / np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-12)
    width = -(-v.shape[1] // min(parts, v.shape[1]))
    model = Model(centres, np.zeros((-(-v.shape[1] // width), 1, width)), np.zeros(lists, np.int64), np.zeros(lists))
    if len(v):
        runs = model.cut(v - centres[(v @ centres.T).argmax(axis=1)])
        model.books = np.stack([kmeans(runs[:, p], min(256, len(v))) for p in range(runs.shape[1])])
    return model


class IvfPq:
    """An index at a path; open one that is there, or build() it from points (id, vector)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._model: Model | None = None

    @property
    def model(self) -> Model:
        if self._model is None:
            self._model = Model.from_bytes(bytes(self.spark.read.format("binaryFile").load(f"{self.path}/model").select("content").first()[0]))
        return self._model

    def points(self) -> DataFrame:
        """id, code, vector and list of all rows; filters on list prune files."""
        if not self.model.sizes.sum():
            return self.spark.createDataFrame([], "id long, code binary, vector array<double>, angle double, list int")
        return self.spark.read.parquet(f"{self.path}/lists")

    @staticmethod
    def _usable(points: DataFrame, dim: int | None = None) -> DataFrame:
        good = F.size("vector") > 0 if dim is None else F.size("vector") == dim
        size = norm(F.col("vector"))
        return points.where(good & (size > 0) & (size < float("inf")))

    def build(self, points: DataFrame, lists: int | None = None, parts: int = PARTS, sample: int = SAMPLE) -> IvfPq:
        """Learn, encode every row and write; the vectors' size is that of most of the sample's first row."""
        good = self._usable(points.select("id", "vector"))
        common = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = common["dim"] if common else 1
        model = learn(self._usable(good, dim), common["count"] if common else 0, lists, parts, sample)
        sent = self.spark.sparkContext.broadcast(self._checked(model))

        def run(batches):
            for b in batches:
                for a in range(0, len(b), CHUNK):
                    part = b.slice(a, CHUNK)
                    own, code, angle = sent.value.encode(_unit(_dense(part.column("vector"))))
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), part.column("vector"), pa.array(angle), pa.array(own.astype(np.int32))], names=["id", "code", "vector", "angle", "list"])

        schema = T.StructType([*good.schema.fields[:1], T.StructField("code", T.BinaryType()), good.schema["vector"], T.StructField("angle", T.DoubleType()), T.StructField("list", T.IntegerType())])
        encoded = self._usable(good, dim).mapInArrow(run, schema)
        # A list of many rows is several files: parts by id, as many as there are partitions for a list of all rows.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.xxhash64("id"), F.lit(max(1, min(n, (common["count"] if common else 0) // (16 * CHUNK)))))
        encoded.repartition(n, "list", spread).sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{self.path}/lists")
        every = self.spark.read.schema(T.StructType([*schema.fields])).parquet(f"{self.path}/lists")
        told = every.groupBy("list").agg(F.count("*").alias("n"), F.expr(f"percentile_approx(angle, {SPREAD})").alias("a"))
        for r in told.collect() if common else ():  # a row for each list
            model.sizes[r["list"]], model.spreads[r["list"]] = r["n"], r["a"]
        self._model = model
        self._write_model(model)
        return self

    @staticmethod
    def _checked(model: Model) -> Model:
        if model.centres.nbytes + model.books.nbytes > MOST_MODEL:
            raise ValueError(f"{len(model.centres)} lists are too many to broadcast; build with fewer")
        return model

    def _write_model(self, model: Model) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/model")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(model.to_bytes()))
        out.close()

    def _probes(self, queries: DataFrame, begin: int, end: float) -> DataFrame:
        """queries (qid, vector, floor) with the lists each looks into: of its nearest ones those that hold the rows from begin to end and may reach the floor."""
        sent = self.spark.sparkContext.broadcast(self._checked(self.model))

        def run(batches):
            m = sent.value
            with_rows = m.sizes > 0
            for b in batches:
                for a in range(0, len(b), 256):
                    part = b.slice(a, 256)
                    near = np.where(with_rows, np.clip(_unit(_dense(part.column("vector"))) @ m.centres.T, -1.0, 1.0), -2.0)
                    order = np.argsort(-near, axis=1, kind="stable")
                    held = np.cumsum(m.sizes[order], axis=1)
                    before = held - m.sizes[order]
                    best = np.cos(np.maximum(0.0, np.arccos(np.maximum(near, -1.0)) - m.spreads))
                    floor = np.asarray(part.column("floor"))[:, None]
                    q, at = np.nonzero((before >= begin) & (before < end) & np.take_along_axis((best >= floor) & with_rows, order, 1))
                    take = pa.array(q)
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(take), pa.array(order[q, at].astype(np.int32)), part.column("vector").take(take), part.column("floor").take(take)], names=["qid", "list", "vector", "floor"])

        return queries.mapInArrow(run, T.StructType([queries.schema["qid"], T.StructField("list", T.IntegerType()), queries.schema["vector"], T.StructField("floor", T.DoubleType())]))

    def _by_code(self, probes: DataFrame, keep: int) -> DataFrame:
        """(qid, id, list, score, rank): the best `keep` rows of each query by code, of the lists it looks into."""
        spark, model = self.spark, self.model
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sizes = spark.createDataFrame([(i, -(-int(s) // CHUNK)) for i, s in enumerate(model.sizes) if s], "list int, parts int")  # the model is broadcast anyway
        points = self.points().select("list", "id", "code")
        asked = [r[0] for r in probes.select("list").distinct().collect()]  # as many as there are lists at most
        if len(asked) < len(model.sizes):
            points = points.where(F.col("list").isin(asked))
        null = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
        own = points.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "id", "code", null("qid", probes), null("vector", probes), F.lit(0.0).alias("floor"))
        asks = probes.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), null("id", points), null("code", points), "qid", "vector", "floor")
        met = own.unionByName(asks).repartition(n, "list", "part").sortWithinPartitions("list", "part", "kind")
        sent = spark.sparkContext.broadcast(model)

        def run(batches):
            m, last, held, asked = sent.value, None, [], None
            for b in batches:
                keys = np.stack([np.asarray(b.column(c)) for c in ("list", "part", "kind")], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if last != (cell := tuple(keys[lo, :2].tolist())):
                        last, held, asked = cell, [], None
                    rows = b.slice(lo, hi - lo)
                    if not keys[lo, 2]:
                        held.append(rows.select(["qid", "vector", "floor"]))
                        continue
                    if asked is None and held:
                        asked = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
                    for a in range(0, len(asked) if asked is not None else 0, 128):
                        some = asked.slice(a, 128)
                        unit = _unit(_dense(some.column("vector")))
                        tables = m.tables(unit)
                        score = np.repeat((unit @ m.centres[cell[0]])[:, None], len(code), axis=1)
                        for p in range(code.shape[1]):
                            score += tables[:, p, :][:, code[:, p]]
                        good = score >= np.asarray(some.column("floor"))[:, None]
                        if len(code) > keep:
                            good &= score >= np.partition(score, len(code) - keep, axis=1)[:, len(code) - keep][:, None] - 1e-9
                        q, row = np.nonzero(good)
                        if not len(q):
                            continue
                        for c in _cut([pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, row]), rows.column("id").take(pa.array(row))], names=["_q", "score", "id"])], keep):
                            yield pa.RecordBatch.from_arrays([some.column("qid").take(c.column("_q")), c.column("id"), pa.array(np.full(len(c), cell[0], np.int32)), c.column("score")], names=["qid", "id", "list", "score"])

        schema = T.StructType([probes.schema["qid"], points.schema["id"], T.StructField("list", T.IntegerType()), T.StructField("score", T.DoubleType())])
        return ranked(met.mapInArrow(run, schema), keep)

    def candidates(self, queries: DataFrame, k: int, write) -> DataFrame:
        """(qid, id, list): the rows whose vectors are read for each query. write: keeps an intermediate table."""
        keep = KEEP_FOR_EACH * k
        asked = self._usable(queries.select("qid", "vector"), self.model.dim)
        rows, begin, end, found = int(self.model.sizes.sum()), 0, 2 * keep, None
        open_ = asked.withColumn("floor", F.lit(-2.0))
        while begin < max(1, rows):
            more = self._by_code(write(self._probes(open_, begin, end), "probes"), keep).select("qid", "id", "list", "score")
            found = write(ranked(more if found is None else found.select(*more.columns).unionByName(more), keep), "near")
            floors = found.groupBy("qid").agg(F.max(F.when(F.col("rank") == keep, F.col("score"))).alias("floor"))
            open_ = asked.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
            begin, end = end, STEP * end
        return found.select("qid", "id", "list")

    def search(self, queries: DataFrame, k: int = K_RETRIEVER, write=None) -> DataFrame:
        """qid, rank, id and score of about the k nearest rows of each of queries (qid, vector); scores are exact."""
        from tidepool.sources.storage import written

        found = self.candidates(queries, k, write or written)
        pairs = found.join(self.points().select("list", "id", "vector"), ["list", "id"]).join(queries.select("qid", F.col("vector").alias("q")), "qid")

        def run(batches):
            for b in batches:
                score = (_unit(_dense(b.column("vector"))) * _unit(_dense(b.column("q")))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("id"), pa.array(np.round(score, 6))], names=["qid", "id", "score"])

        schema = T.StructType([queries.schema["qid"], found.schema["id"], T.StructField("score", T.DoubleType())])
        return ranked(pairs.select("qid", "id", "vector", "q").mapInArrow(run, schema), k)
