"""A Merkle manifest of a table: a tree over the rows of each source, a tree over the sources, and each row's proof.

A leaf is the SHA-256 of a row's fields, each told by its length so that no two rows spell alike; every `FAN` consecutive nodes have
the hash of their digests as parent, the last run of a level too if it is shorter, until one is left. Sources' last nodes, in the
order of their names, are the leaves of one more tree, whose last node is the manifest's root.

The trees are worked out by supersteps over RDDs. A vertex stands for LEVELS levels of a tree, so for FAN ** LEVELS children.
Upward, children message (place, digest) to their vertex; one that is complete hashes its levels and forwards its digest.
Downward, a vertex gets the sibling path above it from its parent and sends each child that path with the siblings that the child has
within the vertex; leaves fold their digest, or another that is to be verified, with their path. Messages are keyed by
(tree, place), never by source alone, so a source that holds a third of all rows is as many vertices as any other rows.
Each superstep's vertices are written before the next begins: lost executors cost a task, not the supersteps before.

Places of leaves need no global sort in one task: rows are dealt out by ranges of (source, doc_id, leaf), a row's place is its place in its
range, and the counts of ranges (one row for each source and range) are summed up.

Defined cases: null fields are told by a dash; a null source is a tree of its own, before all others; null ids come first
within their source; rows that tie in source and id are put in order by their leaf; equal rows are leaves of their own; a null id
is never tampered with; a long text counts by its digest. Columns but the fields take no part. An empty table gives an empty result and has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import materialise, partitions

FAN, LEVELS = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_VERTEX = "tree long, v long, last boolean, done boolean, digest binary, children binary, ids array<long>, others binary"
_HASH = 32

Path = tuple[tuple[bytes, bytes], ...]  # for each level upward: the digests of the siblings to the left and to the right


def leaf(fields: tuple[str, ...] = FIELDS, text: Column | None = None) -> Column:
    """The digest of a row, in hex: SHA-256 of its fields, each a dash if null, else its length in bytes, a colon and its value."""

    def told(name: str) -> Column:
        value = (F.col(name) if name != "text" or text is None else text).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(told, fields)), 256)


def node(digests: bytes) -> bytes:
    """The parent of digests, which it takes as hex."""
    return hashlib.sha256(digests.hex().encode()).digest()


def levels_of(children: bytes, whole: bool, fan: int, levels: int) -> list[bytes]:
    """The digests of each level from children up: to the one node left of a whole tree, else `levels` levels up."""
    rows = [children]
    while len(rows[-1]) > _HASH if whole else len(rows) <= levels:
        run, row = fan * _HASH, rows[-1]
        rows.append(b"".join(node(row[a : a + run]) for a in range(0, len(row), run)))
    return rows


def siblings(rows: list[bytes], place: int, fan: int) -> Path:
    """The path of a child within its vertex."""
    path = []
    for row in rows[:-1]:
        start, at = place // fan * fan * _HASH, place * _HASH
        path.append((row[start:at], row[at + _HASH : start + fan * _HASH]))
        place //= fan
    return tuple(path)


def folded(digest: bytes, path: Path) -> bytes:
    """The root that a digest and a path lead to."""
    for left, right in path:
        digest = node(left + digest + right)
    return digest


def proof_digest(path: Path) -> str:
    """The hash of all siblings of a path, level by level, left to right."""
    return node(b"".join(left + right for left, right in path)).hex()


def _closed(fan: int, levels: int) -> Callable:
    """The vertex that its children's messages (place, digest, last, other, id) complete."""

    def run(item):
        (tree, v), messages = item
        messages = sorted(messages)
        children, last = b"".join(m[1] for m in messages), any(m[2] for m in messages)
        done = v == 0 and last
        digest = levels_of(children, done, fan, levels)[-1]
        return tree, v, last, done, digest, children, [m[4] for m in messages], b"".join(m[3] for m in messages)

    return run


def ascend(nodes: RDD, name: str, spark, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """The vertices of each superstep from nodes ((tree, place), (digest, last, other, id)) to each tree's last node."""
    span, parts, steps = fan**levels, partitions(spark), []
    while True:
        messages = nodes.map(lambda n: ((n[0][0], n[0][1] // span), (n[0][1] % span, *n[1])))
        vertices = messages.groupByKey(parts).map(_closed(fan, levels))
        steps.append(materialise(spark.createDataFrame(vertices, _VERTEX, verifySchema=False), f"{name}-{len(steps)}"))
        going_on = steps[-1].where("not done").select("tree", "v", "digest", "last")
        if going_on.isEmpty():
            return steps
        nodes = going_on.rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), r[3], b"", None)))


def _children(fan: int, levels: int) -> Callable:
    """((tree, place), (path, subroot)) of each child of a vertex that has its own."""

    def run(item) -> Iterator[tuple]:
        row, (above, subroot) = item
        children, span = bytes(row["children"]), fan**levels
        rows = levels_of(children, row["done"], fan, levels)
        for i in range(len(children) // _HASH):
            yield (row["tree"], row["v"] * span + i), (siblings(rows, i, fan) + above, subroot)

    return run


def descend(steps: list[DataFrame], tops: RDD, parts: int, fan: int = FAN, levels: int = LEVELS) -> RDD:
    """(vertex, (path, subroot)) of the first superstep's vertices, from those of the trees' last nodes by tree."""
    messages = None
    for step in reversed(steps):
        met = step.where("done").rdd.map(lambda r: (r["tree"], r)).join(tops, parts).values()
        if messages is not None:
            met = met.union(step.where("not done").rdd.map(lambda r: ((r["tree"], r["v"]), r)).join(messages, parts).values())
        messages = met.flatMap(_children(fan, levels))
    return met


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf, ...) with tree, the number of their source, and place and n, their place in it and its rows."""
    spark = leaves.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # in the order of sources, a null one first
    slim = materialise(leaves.withColumn("name", name).drop("source"), "leaves")  # the texts are read once
    ranged = slim.repartitionByRange(partitions(spark), "name", "doc_id", "leaf").sortWithinPartitions("name", "doc_id", "leaf")
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "ranges")
    runs = ranged.groupBy("name", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = materialise(runs, "runs")  # a row for each source and each range beyond the first that it reaches into
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs_ = runs.select("name", "range", "first", earlier.alias("earlier"))
    sources = runs.groupBy("name").agg(F.min("range").alias("begins"), F.min("first").alias("first"), F.sum("n").alias("n"))
    begun = sources.groupBy("begins").agg(F.count("*").alias("k"))  # as many rows as ranges
    begun = begun.select("begins", F.coalesce(F.sum("k").over(W.orderBy("begins").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("begins").orderBy("first")) - 1
    sources = sources.withColumn("own", own).join(begun, "begins").select("name", "n", (F.col("before") + F.col("own")).alias("tree"))
    runs_ = runs_.join(sources, "name").select("range", "name", "tree", "n", (F.col("earlier") - F.col("first")).alias("shift"))
    return ranged.join(runs_, ["range", "name"]).withColumn("place", F.col("at") + F.col("shift")).drop("range", "name", "at", "shift")


def manifest(docs: DataFrame, other: Column | None = None, fields: tuple[str, ...] = FIELDS, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs.

    other: a text that is verified against the manifest in place of the row's own (source, doc_id and the other fields as they are).
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    slim = docs.select(*fields)
    told = F.when(other.eqNullSafe(F.col("text")), leaf(fields)).otherwise(leaf(fields, other)) if other is not None else leaf(fields)
    leaves = slim.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(fields)).alias("leaf"), F.unhex(told).alias("other"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = placed(leaves).select("tree", "place", "leaf", (F.col("place") == F.col("n") - 1).alias("last"), "other", "doc_id").rdd
    steps = ascend(rows.map(lambda r: ((r[0], r[1]), (bytes(r[2]), r[3], bytes(r[4]), r[5]))), "tree", spark, fan, levels)
    tops = None
    for step in steps:
        done = step.where("done").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
    n = tops.count()
    if not n:
        return spark.createDataFrame([], schema)
    above = ascend(tops.rdd.map(lambda r: ((0, r[0]), (bytes(r[1]), r[0] == n - 1, b"", r[0]))), "sources", spark, fan, levels)
    root = bytes(above[-1].where("done").first()["digest"])
    start = spark.sparkContext.parallelize([(0, ((), None))], 1)
    paths = descend(above, start, parts, fan, levels).flatMap(_children(fan, levels)).map(lambda m: (m[0][1], m[1][0]))
    named = paths.join(tops.rdd.map(lambda r: (r[0], bytes(r[1]))), parts)
    bottom = descend(steps, named, parts, fan, levels)

    def proofs(item) -> Iterator[tuple]:
        row, (above, subroot) = item
        children, others = bytes(row["children"]), bytes(row["others"])
        rows = levels_of(children, row["done"], fan, levels)
        roots: dict[bytes, bytes] = {}  # of what a vertex' leaves fold to; all but tampered ones to one digest
        for i, doc_id in enumerate(row["ids"]):
            inner = siblings(rows, i, fan)
            top = folded(others[i * _HASH : (i + 1) * _HASH], inner)
            if top not in roots:
                roots[top] = folded(top, above)
            own = children[i * _HASH : (i + 1) * _HASH]
            yield doc_id, own.hex(), subroot.hex(), root.hex(), proof_digest(inner + above), roots[top].hex(), roots[top] == root

    return spark.createDataFrame(bottom.flatMap(proofs), schema, verifySchema=False)


def tampered(text: str = "text") -> Column:
    """The texts of rows whose id's CRC-32 is even, without their line feeds; other texts as they are."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(F.col(text))
