"""Exact dedup over a kept index of cuckoo filters: digests go in and out, hits are verified, full filters grow from their keys.

A text's key is its SHA-256, its length in bytes and an XXH64 of it: what its content is compared by. Keys are
dealt to shards by a hash. A shard is a cuckoo filter (16-bit fingerprints, four to a bucket) whose
slots tell where in the shard's bucketed content the whole key stands. A fingerprint that isn't in either of
its two buckets is a new text; one that is counts only if the whole key there is equal. Where an insertion
kicks too often, the filter doubles and is filled again from the stored keys; shards that hold too many keys are split
in two, from the stored keys as well.

The state of all shards is one written table, a row each; an update is one cogroup of that table with the
batch, by shard, into a new table, so lost executors cost a task. Batches are aggregated by (key, origin) before
they reach a shard, where origin is the partition that a row was read from: a text that a third of all rows share arrives
as one row for each origin, and finds its way back to its rows by (key, origin), never by its key alone.

Of equal texts the row with the largest doc_id stays, a null one before none; of rows that tie in it the last read one.
With an index that holds earlier batches, a row stays only if its doc_id is larger than what is live.

Defined cases: null text counts as empty, and empty texts are equal; rows that repeat are rows of their own, of which one stays;
texts are hashed whole by the engine, whatever their length; columns named like a result give way to it. Empty tables give empty results.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import materialise, numbered, partitions, shielded

SLOTS, KICKS, KEY_BYTES = 4, 200, 48
SHARD_KEYS = 1 << 16  # keys that a shard should hold; at four times as many it is split
ORIGINS = 4_096
_RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def content_key(text: Column) -> Column:
    """48 bytes that stand for a text: SHA-256, length, XXH64."""
    text = F.coalesce(text, F.lit(""))
    number = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.unhex(F.concat(F.sha2(text, 256), number(F.octet_length(text)), number(F.xxhash64(text))))


class Filter:
    """A cuckoo filter over keys that it also holds; slot i belongs to bucket i // 4 and refs[i] tells the key of its fingerprint."""

    def __init__(self, buckets: int = 4) -> None:
        self.keys: list[bytes] = []
        self.hits = self.false_hits = self.grown = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints, self.refs = array("H", bytes(2 * SLOTS * buckets)), array("i", bytes(4 * SLOTS * buckets))

    @classmethod
    def load(cls, buckets: int, prints: bytes, refs: bytes, keys: bytes) -> Filter:
        self = cls.__new__(cls)
        self.hits = self.false_hits = self.grown = 0
        self.mask, self.prints, self.refs = buckets - 1, array("H", prints), array("i", refs)
        self.keys = [keys[a : a + KEY_BYTES] for a in range(0, len(keys), KEY_BYTES)]
        return self

    @property
    def buckets(self) -> int:
        return self.mask + 1

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "big") or 1

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[2:8], "big") & self.mask

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self.mask)

    def _slot(self, key: bytes) -> int:
        """Where a key that is held has its fingerprint; -1 if it isn't held."""
        fp, first = self._print(key), self._first(key)
        prints, refs = self.prints, self.refs
        for bucket in {first, self._other(first, fp)}:
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[s] == fp:
                    self.hits += 1
                    if self.keys[refs[s]] == key:
                        return s
                    self.false_hits += 1
        return -1

    def find(self, key: bytes) -> int:
        """The number of a held key, else -1."""
        s = self._slot(key)
        return -1 if s < 0 else self.refs[s]

    def _place(self, fp: int, bucket: int, ref: int) -> bool:
        prints, refs = self.prints, self.refs
        for b in (bucket, self._other(bucket, fp)):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not prints[s]:
                    prints[s], refs[s] = fp, ref
                    return True
        for n in range(KICKS):
            s = bucket * SLOTS + (n * 7 + ref) % SLOTS
            fp, prints[s], ref, refs[s] = prints[s], fp, refs[s], ref
            bucket = self._other(bucket, fp)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[s]:
                    prints[s], refs[s] = fp, ref
                    return True
        return False  # one fingerprint is homeless; _grow() fills the filter anew

    def _grow(self) -> None:
        while True:
            self.grown += 1
            self._clear(2 * self.buckets)
            if all(self._place(self._print(k), self._first(k), i) for i, k in enumerate(self.keys)):
                return

    def insert(self, key: bytes) -> int:
        """The number of a new key."""
        self.keys.append(key)
        if not self._place(self._print(key), self._first(key), len(self.keys) - 1):
            self._grow()
        return len(self.keys) - 1

    def delete(self, key: bytes) -> int:
        """The number that a held key had, which the last key takes over; -1 if it isn't held."""
        s = self._slot(key)
        if s < 0:
            return -1
        ref, last = self.refs[s], self.keys[-1]
        if last != key:
            self.refs[self._slot(last)] = ref
            self.keys[ref] = last
        self.keys.pop()
        self.prints[s] = 0
        return ref


_STATE = "shard long, buckets int, prints binary, refs binary, keys binary, n_keys long, ids array<long>, sizes array<long>, hits long, false_hits long, grown long"
_ANSWER = "key binary, origin int, found boolean, keep_id long, keep_row long, group_size long"
_SCHEMA = f"is_state boolean, {_STATE}, {_ANSWER}"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]
_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_KINDS = [_TYPES[f.split()[1]] for f in _SCHEMA.split(", ")]


class _Shard:
    """A shard's filter with the live id and the number of rows of each key."""

    def __init__(self, shard: int, state: pa.Table) -> None:
        row = state.to_pylist()[0] if len(state) else None
        self.shard = shard
        self.filter = Filter.load(row["buckets"], row["prints"], row["refs"], row["keys"]) if row else Filter()
        self.ids: list = row["ids"] if row else []
        self.sizes: list = row["sizes"] if row else []
        self.told = (row["hits"], row["false_hits"], row["grown"]) if row else (0, 0, 0)

    def insert(self, rows: pa.Table) -> Iterator[tuple]:
        f, ids, sizes, live = self.filter, self.ids, self.sizes, {}
        keys = rows["key"].to_pylist()
        at, known = [], []
        for key, doc_id, row, n in zip(keys, rows["id"].to_pylist(), rows["row"].to_pylist(), rows["n"].to_pylist(), strict=True):
            i = f.find(key)
            known.append(i >= 0)
            if i < 0:
                i = f.insert(key)
                ids.append(doc_id), sizes.append(n)
                live[i] = row
            else:
                sizes[i] += n
                new, old = (doc_id is not None, doc_id or 0), (ids[i] is not None, ids[i] or 0)
                if new > old or new == old and i in live and row > live[i]:
                    ids[i], live[i] = doc_id, row
            at.append(i)
        for key, origin, i, k in zip(keys, rows["origin"].to_pylist(), at, known, strict=True):
            yield key, origin, k, ids[i], live.get(i), sizes[i]

    def find(self, rows: pa.Table) -> Iterator[tuple]:
        for key, origin in zip(rows["key"].to_pylist(), rows["origin"].to_pylist(), strict=True):
            i = self.filter.find(key)
            yield (key, origin, False, None, None, 0) if i < 0 else (key, origin, True, self.ids[i], None, self.sizes[i])

    def delete(self, rows: pa.Table) -> Iterator[tuple]:
        gone = {}
        for key, origin in zip(rows["key"].to_pylist(), rows["origin"].to_pylist(), strict=True):
            if key not in gone:
                i = self.filter.delete(key)
                gone[key] = (False, None, None, 0) if i < 0 else (True, self.ids[i], None, self.sizes[i])
                if i >= 0:
                    self.ids[i], self.sizes[i] = self.ids[-1], self.sizes[-1]
                    self.ids.pop(), self.sizes.pop()
            yield key, origin, *gone[key]

    def state(self) -> tuple:
        f = self.filter
        told = [a + b for a, b in zip(self.told, (f.hits, f.false_hits, f.grown), strict=True)]
        return (self.shard, f.buckets, f.prints.tobytes(), f.refs.tobytes(), b"".join(f.keys), len(f.keys), self.ids, self.sizes, *told)

    def half(self, shard: int, shards: int) -> tuple:
        """The state of the keys that belong to one of two shards that this one is split into, filled in anew."""
        part = _Shard(shard, pa.table({}))
        for key, i, n in zip(self.filter.keys, self.ids, self.sizes, strict=True):
            if xxhash.xxh64_intdigest(key, 42) % shards == shard:  # the engine's xxhash64
                part.filter.insert(key), part.ids.append(i), part.sizes.append(n)
        if shard < shards // 2:
            part.told = self.told
        return part.state()


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _step(operation: str) -> Callable:
    """What a shard does with its part of a batch: answers, and its new state unless it only looks."""
    n_state = len(_STATE.split(", "))

    def run(key: tuple, state: pa.Table, rows: pa.Table) -> pa.Table:
        shard = _Shard(key[0].as_py(), state)
        none = (None,) * n_state
        out = [(False, *none, *a) for a in getattr(shard, operation)(rows)]
        if operation != "find":
            out.append((True, *shard.state(), *(None,) * (len(_NAMES) - 1 - n_state)))
        return _table(out, _NAMES, _KINDS)

    return run


class CuckooIndex:
    """The live digests of texts, in shards; each update writes a new table of their states."""

    def __init__(self, spark: SparkSession, shard_keys: int = SHARD_KEYS) -> None:
        self.spark, self.shard_keys, self.shards = spark, shard_keys, 0
        self.state = spark.createDataFrame([], _STATE)

    def _answers(self, operation: str, keys: DataFrame, rows: int) -> DataFrame:
        """keys (key, origin, id, row, n) looked up, inserted or deleted."""
        if not self.shards:
            least = max(8 * partitions(self.spark), -(-rows // self.shard_keys))
            self.shards = 1 << (least - 1).bit_length()
        dealt = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)))
        run = _step(operation)  # a plain function of the key and both tables
        met = self.state.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(lambda key, a, b: run(key, a, b), _SCHEMA)
        met = materialise(met, f"cuckoo-{operation}")
        if operation != "find":
            self.state = met.where("is_state").select(*(f.split()[0] for f in _STATE.split(", ")))
            self._split()
        return met.where("not is_state").select(*(f.split()[0] for f in _ANSWER.split(", ")))

    def _split(self) -> None:
        """Twice as many shards while one holds four times the keys it should."""
        while (self.state.agg(F.max("n_keys")).first()[0] or 0) > 4 * self.shard_keys:
            shards = 2 * self.shards

            def run(batches, shards=shards):
                names, kinds = _NAMES[1 : 1 + len(_STATE.split(", "))], _KINDS[1 : 1 + len(_STATE.split(", "))]
                for b in batches:
                    for i in range(len(b)):
                        one = pa.Table.from_batches([b.slice(i, 1)])
                        whole = _Shard(one["shard"][0].as_py(), one)
                        for s in (whole.shard, whole.shard + shards // 2):
                            yield from _table([whole.half(s, shards)], names, kinds).to_batches()

            self.state = materialise(self.state.mapInArrow(run, _STATE), "cuckoo-split")
            self.shards = shards

    def insert(self, keys: DataFrame, rows: int) -> DataFrame:
        """keys (key, origin, id, row, n) made live: whether each was there, the id and row that stay, and the rows of its text so far."""
        return self._answers("insert", keys, rows)

    def delete(self, docs: DataFrame) -> DataFrame:
        """The texts of docs forgotten; their distinct text_sha256 with found, whether they were live, and group_size, their rows till then."""
        return self._looked_up("delete", docs)

    def contains(self, docs: DataFrame) -> DataFrame:
        """The distinct text_sha256 of docs with found, the live keep_id and group_size; the index stays as it is."""
        return self._looked_up("find", docs)

    def _looked_up(self, operation: str, docs: DataFrame) -> DataFrame:
        keys = materialise(docs.select(content_key(F.col("text")).alias("key")).distinct().select("key", F.lit(0).alias("origin"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("n")), "keys")
        got = self._answers(operation, keys, keys.count())
        return got.select(_sha256(F.col("key")).alias("text_sha256"), "found", "keep_id", "group_size")

    def statistics(self) -> DataFrame:
        """One row: live keys, slots, and how often fingerprints met, met in vain, and filters grew."""
        return self.state.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("keys", "n_keys"), ("slots", F.col("buckets") * SLOTS), ("hits", "hits"), ("false_hits", "false_hits"), ("grown", "grown"))))


def _sha256(key: Column) -> Column:
    return F.lower(F.hex(F.substring(key, 1, 32)))


def classes(docs: DataFrame, columns: list[str] | None = None, index: CuckooIndex | None = None) -> DataFrame:
    """columns of docs (all but text by default) with keep_id, group_size, kept and text_sha256, a row for each row of docs.

    The digests go into the index, a new one unless it is given.
    """
    spark = docs.sparkSession
    index = index or CuckooIndex(spark)
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("text", *_RESULTS)]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own = [quoted(c).alias(f"_own{i}") for i, c in enumerate(names)]
    origin = F.pmod(F.spark_partition_id(), F.lit(ORIGINS))
    staged = docs.select(*own, F.col("doc_id").alias("_id"), content_key(F.col("text")).alias("key"), origin.alias("origin"), F.monotonically_increasing_id().alias("_place"))
    staged = materialise(staged, "digests")  # texts are read once
    best = F.max(F.struct(F.col("_id").cast("long").alias("id"), F.col("_place").alias("row")))
    keys = staged.groupBy("key", "origin").agg(best.alias("best"), F.count("*").alias("n")).select("key", "origin", "best.id", "best.row", "n")
    found = staged.join(index.insert(keys, staged.count()), ["key", "origin"])
    kept = F.coalesce(F.col("_place") == F.col("keep_row"), F.lit(False))
    return found.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(names)), "keep_id", "group_size", kept.alias("kept"), _sha256(F.col("key")).alias("text_sha256"))


def dedup(docs: DataFrame, index: CuckooIndex | None = None) -> DataFrame:
    """docs with one row of each text, all columns as they were."""
    safe, back = shielded(docs, {"doc_id", "text"})
    base = numbered(safe, "documents")
    kept = classes(base.select("doc_id", "text", "_row"), ["_row"], index).where("kept").select("_row")
    return back(base.join(kept, "_row"))
