"""Late interaction through an inverted index of patches: exact top-k pages, most of them told apart by bounds alone.

Building: patch centroids, some times the square root of the patches of them, are learnt from a bounded sample; a page keeps the
centroids that its patches are nearest to and, for each, the angle within which those patches lie. So a page is a few
(centroid, angle) postings in place of its vectors.

Searching: by the triangle inequality a question's token is no nearer to a patch than its angle to the patch's centroid less the
posting's angle, so the best of a page's postings bounds its best cosine, and the sum over tokens its MaxSim. The pages with the
highest bounds are scored exactly first; the k-th of these scores is a floor, and of all pages only those whose bound
reaches it are scored. The result is that of exact search, whatever the vectors; how many pages are scored follows from how
well patches cluster (`scored` tells it), and on vectors without structure it is nearly all.

Pages and questions meet in cells, as in any search here. Defined cases: pages and questions without vectors are left out; a zero or not finite
patch is unlike anything and counts for none of a page, a page or question of such alone is left out; equal scores go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.vector import norm
from tidepool.operators.ivfpq import SAMPLE, SEED, kmeans
from tidepool.operators.search import BLOCK, _dense, _scored, _unit, ranked
from tidepool.schema import K_RETRIEVER

CENTROIDS_PER_ROOT, FIRST_FOR_EACH = 4, 3
_OWN = ["vectors", "near", "reach"]


def centroids_of(pages: DataFrame, per_root: int = CENTROIDS_PER_ROOT, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of the pages' patches, learnt from `sample` patches in expectation, which come to the driver."""
    n = pages.agg(F.coalesce(F.sum(F.size("vectors")), F.lit(0))).first()[0]
    patches = pages.select("id", F.posexplode("vectors").alias("place", "vector")).where((norm(F.col("vector")) > 0) & (norm(F.col("vector")) < float("inf")))
    place = F.xxhash64("id", "place", F.lit(SEED))
    some = patches if n <= sample else patches.where(place < F.lit(-(1 << 63) + (sample << 64) // n))
    rows = [r["vector"] for r in some.orderBy(place, "id", "place").select("vector").limit(2 * sample).collect()]
    if not rows:
        return np.zeros((0, 0))
    found = kmeans(_unit(np.array(rows, np.float64)), max(1, round(per_root * n**0.5)))
    return found / np.maximum(np.sqrt((found * found).sum(axis=1, keepdims=True)), 1e-12)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each row's begin and the last ends)."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])


def postings(pages: DataFrame, centroids: np.ndarray) -> DataFrame:
    """pages (id, vectors, ...) with near, the centroids of their patches, and reach, the angle within which those lie."""
    sent = pages.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = sent.value
        for b in batches:
            vectors = b.column("vectors")
            starts = np.concatenate([[0], np.cumsum(np.asarray(vectors.value_lengths().fill_null(0)))])
            unit = _unit(_dense(vectors.flatten()))
            row = np.repeat(np.arange(len(b)), np.diff(starts))
            good = np.isfinite(unit).all(axis=1)
            cosine = unit[good] @ c.T if len(c) else np.zeros((0, 1))
            own = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(own)), own], -1.0, 1.0))
            key, at = np.unique(row[good] * max(1, len(c)) + own, return_inverse=True)
            reach = np.zeros(len(key))
            np.maximum.at(reach, at, angle)
            cuts = np.searchsorted(key // max(1, len(c)), np.arange(len(b) + 1)).astype(np.int32)
            near, far = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((key % max(1, len(c))).astype(np.float64), reach))
            yield pa.RecordBatch.from_arrays([*b.columns, near, far], names=[*b.schema.names, "near", "reach"])

    kind = T.ArrayType(T.DoubleType())
    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("near", kind), T.StructField("reach", kind)]))


def _asked(questions: DataFrame, floor=None) -> DataFrame:
    """questions (qid, vectors) in the shape of pages; reach holds the floor."""
    none = F.array().cast("array<double>")
    return questions.select("qid", "vectors", none.alias("near"), (none if floor is None else F.array(floor)).alias("reach"))


def _tokens(vectors: pa.Array, floors: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit tokens, where each question's begin, their angles to the centroids, floors of the questions)."""
    sizes = np.asarray(vectors.value_lengths())
    unit = _unit(_dense(vectors.flatten()))
    angles = np.arccos(np.clip(unit @ centroids.T, -1.0, 1.0)) if len(centroids) else np.zeros((len(unit), 1))
    values, starts = _lists(floors)
    floor = np.where(np.diff(starts) > 0, values[np.minimum(starts[:-1], max(0, len(values) - 1))] if len(values) else 0.0, -np.inf)
    return unit, np.cumsum(sizes) - sizes, angles, floor


def _bounds(model, near: pa.Array, reach: pa.Array) -> np.ndarray:
    """For each page and question the most its MaxSim can be."""
    _, starts, angles, _ = model
    at, cuts = _lists(near)
    far, _ = _lists(reach)
    some = np.diff(cuts) > 0
    out = np.full((len(near), len(starts)), -np.inf)
    if some.any():
        best = np.cos(np.maximum(0.0, angles[:, at.astype(np.int64)] - far))  # tokens by postings
        page = np.maximum.reduceat(best, cuts[:-1][some], axis=1)
        out[some] = np.add.reduceat(page, starts, axis=0).T
    return out + 1e-9


def _exact(model, vectors: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """MaxSim where it is wanted, else minus infinity."""
    unit, starts, _, _ = model
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    first = np.cumsum(sizes) - sizes
    rows = _unit(_dense(vectors.flatten()))
    ends = np.append(starts[1:], len(unit))
    out = np.full(wanted.shape, -np.inf)
    for i in np.flatnonzero(wanted.any(axis=1)).tolist():
        q = np.flatnonzero(wanted[i])
        own = rows[first[i] : first[i] + sizes[i]]
        own = own[np.isfinite(own).all(axis=1)]
        n = (ends - starts)[q]
        at = np.repeat(starts[q] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[i, q] = np.add.reduceat((own @ unit[at].T).max(axis=0), np.cumsum(n) - n)
    return out


class PatchIndex:
    """Pages (id, vectors, ...) with their postings, written once by write(df, name)."""

    def __init__(self, pages: DataFrame, write, per_root: int = CENTROIDS_PER_ROOT) -> None:
        some = pages.where(F.size("vectors") > 0)
        self.write, self.centroids = write, centroids_of(some, per_root)
        self.pages = write(postings(some, self.centroids), "patches").where(F.size("near") > 0)
        self._sent = pages.sparkSession.sparkContext.broadcast(self.centroids)

    def _cells(self, pages: DataFrame, asked: DataFrame, k: int, score, block: int) -> DataFrame:
        sent = self._sent
        return _scored(pages.select("id", *_OWN), asked, k, _OWN, lambda v, near, reach: _tokens(v, reach, sent.value), score, block)

    def bounds(self, asked: DataFrame, k: int, block: int = 512) -> DataFrame:
        """The k pages of each question with the highest bounds; no page's vectors leave the scan."""
        slim = self.pages.select("id", F.array().cast(dict(self.pages.dtypes)["vectors"]).alias("vectors"), "near", "reach")
        return self._cells(slim, asked, k, lambda m, v, near, reach: _bounds(m, near, reach), block)

    def floors(self, questions: DataFrame, k: int, block: int = 512) -> DataFrame:
        """qid, vectors and floor: the k-th best score among the pages with the highest bounds; null where there are fewer."""
        first = self.write(self.bounds(_asked(questions), FIRST_FOR_EACH * k, block), "bounds")
        pairs = first.select("qid", "id").join(self.pages.select("id", F.col("vectors").alias("own")), "id").join(questions.select("qid", "vectors"), "qid")

        def run(batches):
            for b in batches:
                score = []
                for own, tokens in zip(b.column("own"), b.column("vectors"), strict=True):
                    rows = _unit(_dense(own.values))
                    score.append(float((rows[np.isfinite(rows).all(axis=1)] @ _unit(_dense(tokens.values)).T).max(axis=0).sum()))
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("id"), pa.array(score, pa.float64())], names=["qid", "id", "score"])

        schema = T.StructType([questions.schema["qid"], self.pages.schema["id"], T.StructField("score", T.DoubleType())])
        exact = ranked(pairs.select("qid", "id", "own", "vectors").mapInArrow(run, schema), k)
        floor = exact.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
        return questions.join(floor, "qid", "left")

    def search(self, questions: DataFrame, k: int = K_RETRIEVER, block: int = 512) -> DataFrame:
        """The k pages of each of questions (qid, vectors) by late interaction: what maxsim_topk gives."""
        questions = self._usable(questions)
        told = self.write(self.floors(questions, k, block), "floors")
        asked = _asked(told, F.coalesce("floor", F.lit(float("-inf"))) - 1e-6)  # scores are told apart at six places
        best = self._cells(self.pages, asked, k, lambda m, v, near, reach: _exact(m, v, _bounds(m, near, reach) >= m[3]), block)
        others = [c for c in self.pages.columns if c not in ("id", *_OWN)]
        return best.join(self.pages.select("id", *others), "id").select("qid", "score", "id", *others, "rank")

    def scored(self, questions: DataFrame, k: int = K_RETRIEVER) -> DataFrame:
        """(qid, n): how many pages are scored exactly for each question. A row for each pair on the way: for measuring, not for search."""
        told = self.write(self.floors(self._usable(questions), k), "floors")
        every = self.bounds(_asked(told), 1 << 30, BLOCK).select("qid", "id", "score")
        reached = every.join(told.select("qid", "floor"), "qid").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor") - 1e-6))
        return reached.groupBy("qid").agg(F.count("*").alias("n"))

    @staticmethod
    def _usable(questions: DataFrame) -> DataFrame:
        """Questions all of whose tokens are comparable; as in exact search, one of no direction makes no score."""
        good = F.forall("vectors", lambda v: (norm(v) > 0) & (norm(v) < float("inf")))
        return questions.select("qid", "vectors").where((F.size("vectors") > 0) & good)
