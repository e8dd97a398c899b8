"""What the operators of this folder share: shared-folder tables, Arrow slices, vectorised word hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step takes at a time; a longer document is a step of its own.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one on a local master and an error on any other."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share: the master is {master}")
        told = getattr(shared_dir, "own", None)
        if told is None:
            told = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tidepool-")
    return told


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table under shared_dir() and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not _written:
        atexit.register(drop_all)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table of materialise() that no plan reads any more."""
    for i, (spark, path) in enumerate(_written):
        if any(path.rpartition("/")[2] in f for f in df.inputFiles()[:1]):
            _delete(spark, path)
            del _written[i]
            return


def tables_written() -> int:
    """How many tables of materialise() there are, to drop later ones by."""
    return len(_written)


def drop_since(first: int, kept: DataFrame) -> None:
    """Delete the tables written since there were `first`, but the one that kept reads; no other plan may need them."""
    files = kept.inputFiles()[:1]
    if not files:
        return
    for spark, path in _written[first:]:
        if path.rpartition("/")[2] not in files[0]:
            _delete(spark, path)
    _written[first:] = [w for w in _written[first:] if w[1].rpartition("/")[2] in files[0]]


def drop_all() -> None:
    """Delete all tables of materialise(); results that read them must be written by then. Runs when Python ends."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20) -> None:
    """Have Spark hand documents to Python in batches of bounded rows and bytes, smaller if the session says so.

    The session keeps the setting, since plans run later than they are made.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        told = spark.conf.get(key, None)
        if told is not None and (told.isdigit() and not 0 < int(told) <= most or not told.isdigit()):
            spark.conf.set(key, str(most))


_NARROW = {"Project", "Filter", "LogicalRelation", "LocalRelation"}


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with _row, a number of each row that every job reads alike.

    Straight from files a row's place in the plan is such a number; after anything else (a shuffle, a
    step that isn't deterministic) rows could come in another order the second time, so they are written first.
    """
    base = docs.withColumn("_row", F.monotonically_increasing_id())
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in _NARROW or not plan.deterministic():
            return materialise(base, name)
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return base


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that nothing is learnt from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sampled(place: Column, wanted: int, total: int) -> Column:
    """Whether a row is among `wanted` of `total` in expectation, by a 64-bit hash of it."""
    if total <= wanted:
        return F.lit(True)
    return place < F.lit(-(1 << 63) + (wanted << 64) // total)


def shielded(df: DataFrame, used: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all but the used columns renamed out of the way of an operator's own, and what names them back."""
    names = {c: c if c in used else f"_own{i}" for i, c in enumerate(df.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*(quoted(c).alias(n) for c, n in names.items())), lambda out, *more: out.select(*(F.col(n).alias(c) for c, n in names.items()), *more)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows that hold about `most` bytes."""
    data, offsets = text_bytes(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG = 64  # bytes from which on a word is hashed by itself


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes a step, each step a bijection of the state; hashes of two seeds are independent.

    Words of eight bytes or fewer never collide with others of their length.
    """
    sizes = ends - starts
    salt = mix(np.array([2 * seed + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    h = mix(sizes.astype(np.uint64) ^ salt)
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    step = 0
    while len(at):
        left = sizes[at] - step
        lane = lanes[starts[at] + step]
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        h[at] = mix((h[at] ^ lane) * _C1 + salt)
        at = at[left > 8]
        step += 8
    for i in np.flatnonzero(sizes > _LONG).tolist():
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], int(salt)))
    return h


_PAIR = np.uint64(0xD6E8FEB86659FD93)


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair of hashes."""
    return mix(mix(a) * _PAIR + b)


def runs_hash(words: np.ndarray, width: int, step: int = 1 << 15) -> np.ndarray:
    """A hash of each `width` consecutive word hashes, joined in halves: each level is mixed, so no arrangement of words cancels out."""
    n = max(0, len(words) - width + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, step):  # in pieces, so that a very long text takes no more memory than a slice
        b = min(n, a + step)
        out[a:b] = slide(mix(words[a : b + width - 1]), width, joined_hash)
    return out


def word_spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of True in keep, cut where a row ends."""
    if not len(keep):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(len(keep) + 1, bool)
    cut[offsets] = True
    start = keep.copy()
    start[1:] &= ~keep[:-1] | cut[1:-1]
    end = keep.copy()
    end[:-1] &= ~keep[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Bytes that are not \x20\x09-\x0D.
IS_DARK = np.ones(256, bool)
IS_DARK[[0x20, *range(0x09, 0x0E)]] = False


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values, in log(width) steps."""
    span = 1
    while span * 2 <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def strings(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The column's values one by one, without one list of them all."""
    for a in range(0, len(column), step):
        yield from column.slice(a, step).to_pylist()


def plus(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with the fields of a DDL string added."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def byte_pieces(raw: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """raw in pieces of about `most` bytes, cut at ASCII white space only."""
    a = 0
    while len(raw) - a > most:
        m = _WHITE.search(raw, a + most)
        b = m.start() if m else len(raw)
        yield raw[a:b]
        a = b
    yield raw[a:] if a else raw
