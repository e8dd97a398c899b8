"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Fingerprints at `radius` or fewer differing bits agree on at least `blocks - radius` of `blocks` bit
blocks, so each distinct fingerprint goes to one shard for each choice of that many blocks; the more
distinct fingerprints there are, the more blocks and the longer the keys. Every shard becomes a
BK-tree (children keyed by their integer distance to the parent) that is searched along the edges
within the radius only. A search takes what it finds out of the tree, so a shard of m mutual near
copies costs about m steps and yields m - 1 links, not m squared. Shards are dealt by a shuffle in
place of a broadcast, which would grow with the corpus; a shard of more than `split` fingerprints is
dealt again by four blocks of the bits its key leaves (the same argument), each a smaller tree.
Links then meet in connected components by alternating star steps on written tables.

near_dedup() keeps one document of each group of near copies. Radius 3 on shingles finds few of those
that share 0.8 of their five-word shingles (their fingerprints differ in about 4 to 14 of 64 bits). Each
document goes to 16 shards instead, one for each key of five of its shingles, the first in as many random
orders: where edits lie doesn't matter, and texts of similarity s meet in none with probability
(1 - s ** 5) ** 16, 0.002 at 0.8. A shard is a BK-tree over 256 bits of the five-word shingles, of which
256 acos(2s / (1 + s)) / pi differ, 39 at 0.8 with a deviation of about 6; unrelated texts differ in 128.
Bits only propose: what chains of pairs at 64 or fewer join is searched once more, with the exact sets of
these documents alone, and two are linked if their sets share 0.8 of the union. Both searches take what
they link out of the tree, so a group of m near copies yields m - 1 links and not m squared.

Defined cases: null or empty text has fingerprint zero and links like any other; a null doc_id is
never the smallest unless all of its component are null; equal rows each get a row; long texts are
hashed in pieces; near_duplicates() leaves other columns than doc_id and text out. near_dedup() keeps all
columns, whatever their names; texts without a word are copies of each other. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import IS_DARK, bounded_batches, drop, materialise, mix, numbered, partitions, plus, runs_hash, shielded, slices, strings, word_spans, words_hash

_PIECE = 1 << 16  # shingles that are counted at a time


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Bit i is 1 if it is 1 in over half of the shingles' XXH64 (seed 42), as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), _PIECE):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a : a + _PIECE], ends[a : a + _PIECE], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (doc_id) and fp, the fingerprint's bits as a long."""
    bounded_batches(docs.sparkSession)
    keep = ["doc_id"] if columns is None else columns
    source = docs.select(*keep, "text")

    def run(batches):
        for b in batches:
            fp = pa.array([_signed(fingerprint_of(t, shingle)) for t in strings(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fp], names=[*keep, "fp"])

    return source.mapInArrow(run, plus(source.drop("text").schema, "fp long"))


class Tree:
    """A BK-tree over integers from which what a search finds is taken; equal ones share a node."""

    def __init__(self, values: list[int], wide: list[int] | None = None) -> None:
        self.value, self.children, self.parent, self.live, self.wide = [], [], [], [], wide
        self.node: list[int] = []  # of each item
        self.items: list[dict[int, None]] = []  # what hangs at each node and isn't taken yet
        place: dict[int, int] = {}
        for i, x in enumerate(values):
            v = place.get(x)
            if v is None:
                v = place[x] = len(self.value)
                self.value.append(x), self.children.append({}), self.parent.append(-1), self.live.append(0), self.items.append({})
                u = 0
                while v:
                    d = (x ^ self.value[u]).bit_count()
                    if d not in self.children[u]:
                        self.children[u][d], self.parent[v] = v, u
                        break
                    u = self.children[u][d]
            self.node.append(v)
            self.items[v][i] = None
            while v >= 0:
                self.live[v] += 1
                v = self.parent[v]

    def taken(self, i: int) -> bool:
        return i not in self.items[self.node[i]]

    def take(self, i: int) -> None:
        v = self.node[i]
        del self.items[v][i]
        while v >= 0:
            self.live[v] -= 1
            v = self.parent[v]

    def near(self, i: int, radius: int, confirm: int | None = None) -> list[int]:
        """What is within the radius of item i (and confirmed, if asked) and not yet taken."""
        found, todo = [], [0]
        value, children, live, items, wide, x = self.value, self.children, self.live, self.items, self.wide, self.value[self.node[i]]
        while todo:
            v = todo.pop()
            if not live[v]:
                continue
            d = (x ^ value[v]).bit_count()
            if d <= radius:
                found += items[v] if confirm is None else (j for j in items[v] if (wide[i] ^ wide[j]).bit_count() <= confirm)
            for k, c in children[v].items():
                if d - radius <= k <= d + radius and live[c]:
                    todo.append(c)
        return found

    def pop_near(self, i: int, radius: int, confirm: int | None = None) -> list[int]:
        """What near() finds; takes it."""
        found = self.near(i, radius, confirm)
        for v in found:
            self.take(v)
        return found

    def chains(self, radius: int, alike=None):
        """Pairs (v, w) within the radius, and alike if asked, that join all that chains of such pairs join."""
        for i in range(len(self.node)):
            if self.taken(i):
                continue
            self.take(i)
            group = [i]
            for v in group:
                for w in self.near(v, radius):
                    if alike is None or alike(v, w):
                        self.take(w)
                        group.append(w)
                        yield v, w

    def groups(self, radius: int, confirm: int | None = None) -> list[list[int]]:
        """Nodes that chains of links join, groups of one left out."""
        out = []
        for i in range(len(self.node)):
            if self.taken(i):
                continue
            self.take(i)
            group = [i]
            for v in group:
                group += self.pop_near(v, radius, confirm)
            if len(group) > 1:
                out.append(group)
        return out


def _blocks(n: int, radius: int, bits: int) -> int:
    """Blocks such that about n keys of (blocks - radius) of them exist; as few as can be."""
    blocks = radius + 1
    while blocks < radius + 4 and 2 ** (bits * (blocks - radius) // blocks) * 64 < n:
        blocks += 1
    return blocks


def _masks(positions: list[int], blocks: int, radius: int) -> list[int]:
    """Masks of blocks - radius of the blocks into which the bit positions are cut."""
    parts = [positions[len(positions) * i // blocks : len(positions) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << p for c in chosen for p in parts[c]) for chosen in combinations(range(blocks), blocks - radius)]


def _tree_links(nodes: list[int], values: list[int], wide: list[bytes], radius: int, confirm: int | None):
    if len(nodes) < 2:
        return
    tree = Tree(values, [int.from_bytes(w, "little") for w in wide] if confirm is not None else None)
    for group in tree.groups(radius, confirm):
        names = [nodes[v] for v in group]
        root = min(names)
        yield from ((x, root) for x in names if x != root)


def _search(radius: int, confirm: int | None):
    """Links (a, b) of the trees of a partition whose rows are sorted by key."""

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        key, held = None, ([], [], [])
        out: list[tuple[int, int]] = []
        for b in batches:
            k1, k2 = np.asarray(b.column("table")), np.asarray(b.column("key"))
            cuts = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            node, fp = b.column("node").to_pylist(), np.asarray(b.column("fp")).view(np.uint64).tolist()
            wide = b.column("wide").to_pylist() if confirm is not None else []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k1)], strict=True):
                if lo == hi:
                    continue
                if key != (k1[lo], k2[lo]):
                    out += _tree_links(*held, radius, confirm)
                    key, held = (k1[lo], k2[lo]), ([], [], [])
                held[0].extend(node[lo:hi]), held[1].extend(fp[lo:hi]), held[2].extend(wide[lo:hi])
            if len(out) > 10_000:
                yield rows(out)
                out = []
        out += _tree_links(*held, radius, confirm)
        if out:
            yield rows(out)

    return run


def links(nodes: DataFrame, radius: int = 3, confirm: int | None = None, split: int = 20_000) -> DataFrame:
    """Links (a, b) that join any two of nodes (node, fp; wide to confirm by) within radius, by chains at least."""
    n = nodes.count()
    rest = [c for c in ("node", "fp", "wide") if c in nodes.columns]
    masks = _masks(list(range(64)), _blocks(n, radius, 64), radius)
    own_key = F.col("fp").bitwiseAND(F.col("t.mask")).alias("key")
    table = F.array(*(F.struct(F.lit(i).alias("table"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)))
    dealt = nodes.select(*rest, F.explode(table).alias("t")).select(*rest, F.col("t.table").alias("table"), own_key)
    hot = dealt.groupBy("table", "key").count().where(F.col("count") > split).select("table", "key", F.lit(True).alias("hot"))
    hot = materialise(hot, "hot-shards")
    if hot.count():
        finer, base = [], len(masks)
        for m in masks:
            free = [p for p in range(64) if not m >> p & 1]
            finer.append(F.array(*(F.struct(F.lit(base + j).alias("table"), F.lit(_signed(m | s)).alias("mask")) for j, s in enumerate(_masks(free, radius + 1, radius)))))
            base += radius + 1
        dealt = dealt.join(hot, ["table", "key"], "left")
        again = dealt.where("hot").select(*rest, F.explode(F.element_at(F.array(*finer), F.col("table") + 1)).alias("t"))
        dealt = dealt.where("hot is null").select(*rest, "table", "key").unionByName(again.select(*rest, F.col("t.table").alias("table"), own_key))
    dealt = dealt.repartition(partitions(nodes.sparkSession), "table", "key").sortWithinPartitions("table", "key")
    return dealt.select("table", "key", *rest).mapInArrow(_search(radius, confirm), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node of its component; alternating star steps.

    Rounds grow with the logarithm of the longest chain; an error where `rounds` don't suffice.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = materialise(edges, "edges")
    told = None
    for done in range(rounds + 1):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == told or not state[0]:
            break
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        told = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = least_table = materialise(least, "least")  # a table, so that the join below can split a node of very many edges
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, materialise(small.where("a != b"), "edges")
        drop(before)
        drop(least_table)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(found: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id) of all distinct fp of found (doc_id, fp), a written table."""
    own = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    own = materialise(own, "fingerprints")
    joined = components(links(own.select(F.col("fp").alias("node"), "fp"), radius))
    named = own.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "classes")
    # Only components of more than one fingerprint need the smallest of several.
    roots = joined.select("root").distinct()
    least = named.join(roots, "root", "left_semi").groupBy("root").agg(F.min("least").alias("smallest"))
    return named.join(least, "root", "left").select("fp", F.when(F.col("smallest").isNotNull(), F.col("smallest")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach) of each document."""
    found = materialise(fingerprints(docs, shingle), "simhash")
    return found.join(classes(found, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(words: np.ndarray, shingle: int = 5) -> tuple[int, bytes]:
    """(64 bits of the set of words, 256 bits of the shingles), from the words' hashes."""
    if not len(words):
        return 0, bytes(32)
    return _sketch(words, shingles(words, shingle))


def shingles(words: np.ndarray, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, ascending; of all words, where they are fewer."""
    width = min(shingle, len(words))
    return np.unique(runs_hash(words, width) if width else words)


def _sketch(words: np.ndarray, h: np.ndarray) -> tuple[int, bytes]:
    return int.from_bytes(_majority(np.unique(words)[:, None]), "little"), _majority(np.stack([mix(h + c) for c in _SALTS], axis=1))


def subset_keys(h: np.ndarray) -> np.ndarray:
    """TABLES keys of distinct shingle hashes, each of the CHOSEN shingles that come first in as many random orders.

    Texts of similarity s agree on a key with probability s ** CHOSEN, wherever they differ.
    """
    least = np.full((TABLES * CHOSEN, 1), 2**64 - 1, np.uint64)
    for a in range(0, len(h), 4096):
        np.minimum(least, ((h[a : a + 4096] ^ _ORDERS[0]) * _ORDERS[1]).min(axis=1, keepdims=True), out=least)
    return mix((mix(least.reshape(TABLES, CHOSEN)) * _ORDERS[1][:CHOSEN, 0]).sum(axis=1, dtype=np.uint64))


TABLES, CHOSEN = 16, 5
_ORDERS = np.random.default_rng(8).integers(0, 2**64, (2, TABLES * CHOSEN, 1), np.uint64, endpoint=False) | np.uint64(1)
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * i % (1 << 64)) for i in range(1, 5)]


def _majority(h: np.ndarray) -> bytes:
    """The bits that over half of the rows set."""
    ones = np.zeros(h.shape[1] * 64, np.int64)
    for a in range(0, len(h), _PIECE):
        raw = np.ascontiguousarray(h[a : a + _PIECE].astype("<u8")).view(np.uint8).reshape(-1, 8 * h.shape[1])
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def _sketches(shingle: int):
    def run(batches):
        for b in batches:
            fps, wide, keys = [], [], []
            for a, e, data, offsets in slices(b.column("text")):
                starts, ends, row = word_spans(IS_DARK[data], offsets)
                words = words_hash(_LOWER[data], starts, ends)
                cuts = np.searchsorted(row, np.arange(e - a + 1))
                for r in range(e - a):
                    own = words[cuts[r] : cuts[r + 1]]
                    h = shingles(own, shingle)
                    fp, w = _sketch(own, h) if len(own) else (0, bytes(32))
                    fps.append(_signed(fp)), wide.append(w), keys.append(subset_keys(h).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), pa.array(fps, pa.int64()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_row", "doc_id", "fp", "wide", "keys"])

    return run


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parted(dealt: DataFrame, split: int) -> DataFrame:
    """dealt (table, key, node and others) by shards; a hot shard goes to pairs of its parts, so that any two of its nodes still meet."""
    hot = dealt.groupBy("table", "key").count().where(F.col("count") > split).select("table", "key", F.ceil(F.col("count") * 2 / split).cast("int").alias("parts"))
    hot = materialise(hot, "hot-shards")
    names, parted = dealt.columns, dealt.withColumn("pair", F.lit(0))
    if hot.count():
        dealt = dealt.join(hot, ["table", "key"], "left")
        part = F.pmod(F.xxhash64("node"), "parts").cast("int")
        again = dealt.where("parts is not null").select("*", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).where("p <> q")
        again = again.select(*names, (F.least("p", "q") * F.col("parts") + F.greatest("p", "q")).alias("pair"))
        parted = dealt.where("parts is null").select(*names, F.lit(0).alias("pair")).unionByName(again)
    key = ["table", "key", "pair"]
    return parted.repartition(partitions(dealt.sparkSession), *key).sortWithinPartitions(*key, "node")


def proposed(nodes: DataFrame, radius: int, split: int = 10_000) -> DataFrame:
    """(node, root) of nodes (node, wide, keys) that chains join, each of two with a common key and wide bits within radius."""
    dealt = nodes.select("node", "wide", F.posexplode("keys").alias("table", "key"))
    return components(_parted(dealt, split).select("table", "key", "pair", "node", "wide").mapInArrow(_search_copies(radius, None), "a long, b long"))


def confirmed(nodes: DataFrame, radius: int, percent: int, large: int = 64, split: int = 4_000) -> DataFrame:
    """Links (a, b) that join nodes (node, wide, keys, shingles, root) of a root by chains of pairs that share percent of their shingles.

    A root of more than `large` nodes is searched key by key, so that no task holds all of it.
    """
    hot = materialise(nodes.groupBy("root").count().where(F.col("count") > large).select("root", F.lit(True).alias("hot")), "large-groups")
    nodes = nodes.join(F.broadcast(hot), "root", "left")
    rest = ["node", "wide", "shingles"]
    dealt = nodes.where("hot is null").select(*rest, F.lit(-1).alias("table"), F.col("root").alias("key"))
    dealt = dealt.unionByName(nodes.where("hot").select(*rest, F.posexplode("keys").alias("table", "key")))
    return _parted(dealt, split).select("table", "key", "pair", *rest).mapInArrow(_search_copies(radius, percent), "a long, b long")


def _search_copies(radius: int, percent: int | None):
    """Links (a, b) of the trees of a partition whose rows are sorted by key; of exact sets that share percent, if asked."""

    def links(nodes: list[int], wide: list[bytes], raw: list[bytes]):
        if len(nodes) < 2:
            return
        sets: list[frozenset | None] = [None] * len(raw)

        def alike(v: int, w: int) -> bool:
            small, big = sorted((len(raw[v]), len(raw[w])))
            if 100 * small < percent * big:
                return False
            for x in (v, w):
                if sets[x] is None:
                    sets[x] = frozenset(np.frombuffer(raw[x], np.uint64).tolist())
            both = len(sets[v] & sets[w])
            return 100 * both >= percent * (len(sets[v]) + len(sets[w]) - both)

        for v, w in Tree([int.from_bytes(x, "little") for x in wide]).chains(radius, alike if percent else None):
            yield nodes[v], nodes[w]

    def run(batches):
        for shard in _shards(batches):
            found = links(*shard)
            while out := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _shards(batches):
    """(nodes, wide, shingles, if there are) of each run of rows of one table, key and pair."""
    last, held = None, ([], [], [])
    for b in batches:
        k = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("table", "key", "pair")], axis=1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        columns = [b.column(c).to_pylist() for c in ("node", "wide", "shingles") if c in b.schema.names]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
            if lo == hi:
                continue
            if last != (own := tuple(k[lo].tolist())):
                yield held
                last, held = own, ([], [], [])
            for h, c in zip(held, columns, strict=False):
                h.extend(c[lo:hi])
    yield held


def _shingle_sets(shingle: int):
    def run(batches):
        for b in batches:
            sets = []
            for a, e, data, offsets in slices(b.column("text")):
                starts, ends, row = word_spans(IS_DARK[data], offsets)
                words = words_hash(_LOWER[data], starts, ends)
                cuts = np.searchsorted(row, np.arange(e - a + 1))
                sets += [shingles(words[cuts[r] : cuts[r + 1]], shingle).tobytes() for r in range(e - a)]
            names = ["node", "wide", "keys", "root"]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(sets, pa.binary())], names=[*names, "shingles"])

    return run


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 64) -> DataFrame:
    """docs without all but one document, the smallest doc_id, of each group joined by links that share percent of their shingles."""
    bounded_batches(docs.sparkSession)
    docs, restored = shielded(docs, {"doc_id", "text"})
    base = numbered(docs, "documents")
    source = base.select("_row", "doc_id", "text")
    found = source.mapInArrow(_sketches(shingle), plus(source.drop("text").schema, "fp long, wide binary, keys array<long>"))
    found = materialise(found.withColumn("node", F.xxhash64("fp", "wide")), "sketches")
    # The first row of a node or component: the smallest doc_id, null last, then the first row.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "keys")).alias("first")
    nodes = materialise(found.groupBy("node", "wide").agg(first), "nodes")
    nodes_ = nodes.select("node", "wide", "first.keys", "first._row")
    linked = nodes_.join(proposed(nodes_, radius), "node")
    sets = base.select("_row", "text").join(linked, "_row").select("node", "wide", "keys", "root", "text").mapInArrow(_shingle_sets(shingle), "node long, wide binary, keys array<long>, root long, shingles binary")
    joined = components(confirmed(materialise(sets, "shingle-sets"), radius, percent))
    rooted = nodes.select("node", "first").join(joined, "node", "left")
    kept = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return restored(base.join(kept, "_row", "left_semi"))
