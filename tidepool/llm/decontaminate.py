"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words: A-Z lower-cased, then runs of digits, a-z and every character from U+0080 on. A window is
`window` consecutive words of one item; a shorter item that has words is one window. Documents are read
once, whatever the benchmark's size: a table of hashed neighbours (two words that follow each other in some
item), of at most 2**21 places, tells the few stretches of a document that may hold a window, and only
their words go through an automaton, whose longest matching length at each word gives the spans.

Items of up to `shard_bytes` make one automaton, which is built where it is used from the broadcast items.
More items are dealt to shards; the table's bits tell which shards a stretch may concern, so stretches,
not documents, meet the shards' items by a shuffle on the shard (the stretches of a busy one parted), and the
spans found come back by row.

Defined cases: null text has no words and stays null; items with null id, null text or no words have
no window; an item id that occurs twice stands for both texts; repeated documents get a row each; long texts
are steps of their own; input columns named n_words, spans or items give way to the results of find(), those
of decontaminate() all pass unchanged. Empty tables give empty results.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, joined_hash, materialise, mix, partitions, plus, shielded, slices, slide, strings, word_spans, words_hash

WINDOW = 10
SHARD_BYTES = 1 << 20
MOST_PLACES = 21  # of the table of neighbours, as a power of two: 8 bytes each
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = np.frombuffer(_TABLE, np.uint8)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """All substrings of all items; each state's link leads to its longest suffix in another state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, here, whole = [-1], [0], [set()], {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            if not ids:
                continue
            last = 0
            for c in ids:
                last = self._extend(last, c, here)
                here[last].add(name)
            if len(ids) < window:
                whole.setdefault(last, {}).setdefault(len(ids), set()).add(name)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            here[self.link[v]] |= here[v]
        self.items = here
        self.whole = [whole.get(v, {}) for v in range(len(self.len))]
        self.above = [-1] * len(self.len)  # the nearest state on the way to the root, itself included, that is a whole short item
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.above[v] = v if self.whole[v] else self.above[self.link[v]] if v else -1

    def _extend(self, last: int, c: int, here: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, here)
        new = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1), here.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q, here)
        return new

    def _clone(self, p: int, c: int, q: int, here: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), here.append(set())
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def search(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """([start, end, start, end, ...] of the words hit, items with occurring windows)."""
        spans: list[int] = []
        found: set[str] = set()
        nxt, link, length, window = self.next, self.link, self.len, self.window
        v = n = 0
        for i, w in enumerate(words):
            c = self.vocabulary.get(w, 0)
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            reach = 0
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                found |= self.items[u]
                reach = window
            u = self.above[v]
            while u >= 0:
                for k, names in self.whole[u].items():
                    if k <= n:
                        found |= names
                        reach = max(reach, k)
                u = self.above[link[u]] if u else -1
            if reach:
                s = i + 1 - reach
                while spans and s <= spans[-1]:
                    spans.pop()
                    s = min(s, spans.pop())
                spans += [s, i + 1]
        return spans, found


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str, str]], window: int) -> Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton([(name, words_of(text)) for name, text in items], window)
    return _BUILT[key]


def _hashed(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row) of each word of a slice in lower case, its hash, and that of it and the next word, 1 where a row ends."""
    starts, ends, row = word_spans(data != 32, offsets)
    words = words_hash(data, starts, ends)
    pairs = np.where(row[1:] == row[:-1], joined_hash(words[:-1], words[1:]) | np.uint64(2), np.uint64(1))
    return starts, ends, row, words, pairs


def _single(words: np.ndarray) -> np.ndarray:
    return mix(words ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(2)


def _places_of(window: int, bits: int):
    """(place, shards) of the neighbours of items (shard, text); place -n stands for windows of n words."""

    def run(batches):
        for b in batches:
            shard = np.uint64(1) << (np.asarray(b.column("shard")).astype(np.uint64) & np.uint64(63))
            place, own = [], []
            for a, e, data, offsets in slices(b.column("text")):
                _, _, row, words, pairs = _hashed(_LOWER[data], offsets)
                n = np.bincount(row, minlength=e - a)
                place.append(-np.minimum(n, window)[n > 0]), own.append(shard[a:e][n > 0])
                keep = pairs != 1
                place.append((pairs[keep] >> np.uint64(64 - bits)).astype(np.int64)), own.append(shard[a + row[:-1][keep]])
                alone = n[row] == 1
                place.append((_single(words[alone]) >> np.uint64(64 - bits)).astype(np.int64)), own.append(shard[a + row[alone]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(place)), pa.array(np.concatenate(own).view(np.int64))], names=["place", "shards"])

    return run


def _neighbours(items: DataFrame, window: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(table of places, masks by window length): which shards, modulo 64, have these neighbours and windows of that many words."""
    bits = min(MOST_PLACES, max(16, (4 * total).bit_length()))
    found = items.mapInArrow(_places_of(window, bits), "place long, shards long").groupBy("place").agg(F.bit_or("shards").alias("shards"))
    table, masks = np.zeros(1 << bits, np.uint64), np.zeros(window + 1, np.uint64)
    got = found.toPandas()  # at most as many rows as the table has places
    place, shards = got["place"].to_numpy(), got["shards"].to_numpy().view(np.uint64)
    table[place[place >= 0]] = shards[place >= 0]
    masks[-place[place < 0]] = shards[place < 0]
    return table, masks


def _stretches(table: np.ndarray, masks: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """(words of each row, list of (row, first word, end word, shards), start and end of each word) of a slice in lower case."""
    starts, ends, row, words, pairs = _hashed(data, offsets)
    shift = np.uint64(64 - (len(table).bit_length() - 1))
    next_ = np.where(pairs == 1, np.uint64(0), table[(pairs >> shift).astype(np.int64)])
    shards = np.zeros(len(words), np.uint64)
    for n in np.flatnonzero(masks).tolist():
        if len(words) < n:
            continue
        run = table[(_single(words) >> shift).astype(np.int64)] if n == 1 else slide(next_, n - 1, np.bitwise_and)
        at = np.flatnonzero(run & masks[n])
        for i in range(n):
            shards[at + i] |= run[at] & masks[n]
    hit = np.flatnonzero(shards)
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    if len(hit):
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(hit)], strict=True):
            r = int(row[hit[a]])
            out.append((r, int(hit[a] - first[r]), int(hit[b - 1] + 1 - first[r]), int(np.bitwise_or.reduce(shards[hit[a:b]])), int(hit[a])))
    return np.diff(first), out, starts, ends


def _words_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, n: int) -> list[bytes]:
    return data[starts[a] : ends[a + n - 1]].tobytes().split()


def _search_at_once(window: int, key: str, sent):
    """Batches with n_words, spans and items, by one automaton of all items."""
    kinds = {"n_words": pa.int64(), "spans": pa.list_(pa.int32()), "items": pa.list_(pa.string())}

    def run(batches):
        rows, table, masks = sent.value
        auto = _automaton(key, rows, window)
        for b in batches:
            n_words, spans, items = [], [[] for _ in range(len(b))], [set() for _ in range(len(b))]
            for a, _, data, offsets in slices(b.column("text")):
                data = _LOWER[data]
                n, found, starts, ends = _stretches(table, masks, data, offsets)
                n_words += n.tolist()
                for r, lo, hi, _, at in found:
                    some, names = auto.search(_words_at(data, starts, ends, at, hi - lo))
                    spans[a + r] += [lo + x for x in some]
                    items[a + r] |= names
            got = [n_words, spans, [sorted(x) for x in items]]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, got, kinds.values())], names=[*b.schema.names, *kinds])

    return run


def _mark(sent):
    """Batches with n_words and stretches (start, shards, words)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("shards", pa.int64()), ("words", pa.string())]))

    def run(batches):
        table, masks = sent.value
        for b in batches:
            n_words, marked = [], [[] for _ in range(len(b))]
            for a, _, data, offsets in slices(b.column("text")):
                data = _LOWER[data]
                n, found, starts, ends = _stretches(table, masks, data, offsets)
                n_words += n.tolist()
                for r, lo, hi, shards, at in found:
                    marked[a + r].append({"start": lo, "shards": shards - (shards >> 63 << 64), "words": b" ".join(_words_at(data, starts, ends, at, hi - lo)).decode()})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), pa.array(marked, kind)], names=[*b.schema.names, "n_words", "stretches"])

    return run


def _by_shard(window: int):
    """(_row, spans, items) of stretches; rows come sorted by shard and part, items before stretches."""

    def run(batches):
        key, items, auto = None, [], None
        for b in batches:
            got: dict[str, list] = {"_row": [], "spans": [], "items": []}
            for shard, part, row, start, name, text in zip(*(strings(b.column(c)) for c in ("shard", "part", "_row", "start", "item_id", "text")), strict=True):
                if (shard, part) != key:
                    key, items, auto = (shard, part), [], None
                if row is None:
                    items.append((name, words_of(text)))
                    continue
                auto = auto or Automaton(items, window)
                spans, found = auto.search(text.encode().split())
                if spans:
                    got["_row"].append(row), got["spans"].append([start + x for x in spans]), got["items"].append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(got["_row"], pa.int64()), pa.array(got["spans"], pa.list_(pa.int32())), pa.array(got["items"], pa.list_(pa.string()))], names=list(got))

    return run


def _merge(batches):
    for b in batches:
        merged = []
        for parts in strings(b.column("spans")):
            flat: list[int] = []
            for s, e in sorted((p[i], p[i + 1]) for p in parts for i in range(0, len(p), 2)):
                if flat and s <= flat[-1]:
                    flat[-1] = max(flat[-1], e)
                else:
                    flat += [s, e]
            merged.append(flat)
        yield b.set_column(b.schema.get_field_index("spans"), "spans", pa.array(merged, pa.list_(pa.int32())))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, columns: list[str] | None = None, after=None) -> DataFrame:
    """Each document with n_words, spans ([start, end, ...] in words) and items (ids with occurring windows).

    columns: what else of docs to keep (all by default); a column named like a result is dropped.
    after: changes the result's batches, in the same Python process if one automaton does.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = {"n_words", "spans", "items", "stretches", "_row", "text"}
    keep = [c for c in (docs.columns if columns is None else columns) if c not in own]
    source = docs.select(*keep, "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    table, masks = _neighbours(items.select("shard", "text"), window, total)
    results = "n_words long, spans array<int>, items array<string>"
    if shards == 1:
        rows = [(r["item_id"], r["text"]) for r in items.collect()]  # at most shard_bytes
        run = _search_at_once(window, uuid.uuid4().hex, spark.sparkContext.broadcast((rows, table, masks)))
        return source.mapInArrow(run if after is None else (lambda batches: after(run(batches))), plus(source.schema, results))
    marked = source.mapInArrow(_mark(spark.sparkContext.broadcast((table, masks))), plus(source.schema, "n_words long, stretches array<struct<start: int, shards: bigint, words: string>>"))
    base = materialise(marked.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    told = F.expr(f"filter(sequence(0, {shards - 1}), s -> (shiftrightunsigned(shards, s % 64) & 1L) = 1L)")
    dealt = base.select("_row", F.inline("stretches")).select("_row", "start", "words", F.explode(told).alias("shard"))
    sizes = materialise(dealt.groupBy("shard").agg(F.ceil(F.count("*") / 20_000).cast("int").alias("parts")), "shards")
    parted = dealt.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("_row", "start"), "parts").cast("int").alias("part"), "_row", "start", F.lit(None).cast("string").alias("item_id"), F.col("words").alias("text"))
    every = items.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("_row"), F.lit(None).cast("int").alias("start"), "item_id", "text")
    met = parted.unionByName(every).repartition(partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", F.col("_row").asc_nulls_first())
    slim = met.mapInArrow(_by_shard(window), "_row long, spans array<int>, items array<string>")
    merged = slim.groupBy("_row").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.mapInArrow(_merge, "_row long, spans array<int>, items array<string>")
    found = base.drop("stretches").join(merged, "_row", "left").select(*keep, "text", "n_words", *(F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in (("spans", "int"), ("items", "string"))))
    return found if after is None else found.mapInArrow(after, found.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: how many words are hit and which items' windows occur."""
    hit = F.expr("coalesce(aggregate(sequence(1, size(spans), 2), 0L, (n, i) -> n + spans[i] - spans[i - 1]), 0L)")
    found = find(docs, benchmark, columns=["doc_id"], **options)
    n_hit = F.when(F.size("spans") > 0, hit).otherwise(F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _cut(text: str, spans: list[int]) -> str:
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out, last = [], 0
    for i in range(0, len(spans), 2):
        out.append(raw[last : at[spans[i]][0]])
        last = at[spans[i + 1] - 1][1]
    return (b"".join(out) + raw[last:]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without the hit spans; a document of which more than max_coverage of the words is hit goes altogether."""
    docs, restored = shielded(docs, {"text"})

    def cut(batches):
        for b in batches:
            text, spans = b.column("text"), b.column("spans")
            hits = np.flatnonzero(np.asarray(spans.value_lengths().fill_null(0)) > 0)
            if len(hits):
                n_words, texts, drop = b.column("n_words"), text.to_pylist(), np.zeros(len(text), bool)
                for i in hits.tolist():
                    s = spans[i].as_py()
                    if sum(s[1::2]) - sum(s[::2]) > max_coverage * n_words[i].as_py():
                        drop[i] = True
                    else:
                        texts[i] = _cut(texts[i], s)
                b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, text.type)).filter(pa.array(~drop))
            yield b

    return restored(find(docs, benchmark, window, after=cut, **options))
