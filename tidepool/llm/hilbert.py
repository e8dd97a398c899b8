"""Sharding along a Hilbert curve: metadata quantised to a grid, rows ordered by curve index, runs cut.

Rows near each other on the curve are near in every dimension, so each shard covers a compact box and
minima and maxima of its columns prune files for filters on any of them. DataFrame functions only.
Every axis is ordinal: it is cut at values that hold about equal numbers of rows, at most 2**bits - 1 of
them, whatever the number of distinct values.

The global rank that cuts equal runs needs no global sort. Keys are written once with the partition they
come from; cells are counted (their number is bounded by the grid) and parted by a hash of the group
columns into at most as many parts again (more where parts would hold over MOST_ROWS); a group that alone is larger than such a part is a part of its
own, parted once more by a hash of order and partition, so not even rows equal in every column meet in
one task. Counts are summed up along the curve, and each row adds its place within its part. Rows of one
group and cell are neighbours. Law: `rows`, shard sizes differ by one at most.

Defined cases: null text has 0 bytes (size 1, CRC 0); null metadata come before all others on their axis;
equal rows get slots of their own; documents of one text lie together whatever their metadata, in the cell of the least
language and source among them (a cut between two shards may part them). Empty tables give empty results. shard() keeps every other column; shard and
slot of the input are replaced. A long text counts by its size and CRC alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import materialise

BITS, SHARDS, MOST_PARTS, ORIGINS = 4, 8, 4_096, 4_096
MOST_ROWS = 1_000_000  # of a part, however many parts that makes


def _tables(n: int) -> tuple[list[int], list[int]]:
    """For each child in curve order: entry point and direction of its own curve, for n dimensions."""
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    ones = [((~i) & (i + 1)).bit_length() - 1 for i in range(1 << n)]  # trailing ones
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << n)]
    turn = [0 if w == 0 else ones[w - 1] % n if w % 2 == 0 else ones[w] % n for w in range(1 << n)]
    return entry, turn


def curve_index(dims: list[Column], bits: int) -> Column:
    """The Hilbert index of a cell whose coordinates are from 0 to 2**bits - 1."""
    n = len(dims)
    entry, turn = _tables(n)
    full = (1 << n) - 1
    named = [f"_x{i}" for i in range(n)]
    digits = " | ".join(f"(shiftleft(shiftright(x.{c}, {bits - 1} - i) & 1, {i}))" for i, c in enumerate(named))
    e, t = (f"array({', '.join(map(str, a))})" for a in (entry, turn))

    def rotate(v: str, by: str, left: bool) -> str:
        other = f"({n} - {by})"
        a, b = (by, other) if left else (other, by)
        return f"((shiftleft({v}, {a}) | shiftright({v}, {b})) & {full})"

    # One level: where the cell lies in this cube (l), its place on the cube's curve (w), and the child's frame.
    local = rotate("(d ^ s.e)", "(s.d + 1)", False)
    inverse = " ^ ".join(f"shiftright(l, {i})" for i in range(n))
    step = (
        f"element_at(transform(array({digits}), d -> element_at(transform(array({local}), l -> element_at(transform(array({inverse}), w -> "
        f"named_struct('h', s.h * {1 << n} + w, 'e', s.e ^ {rotate(f'{e}[w]', '(s.d + 1)', True)}, 'd', (s.d + {t}[w] + 1) % {n})), 1)), 1)), 1)"
    )
    text = f"aggregate(sequence(0, {bits - 1}), named_struct('h', 0L, 'e', 0, 'd', 0), (s, i) -> {step}, s -> s.h)"
    cell = F.struct(*(d.cast("int").alias(c) for d, c in zip(dims, named, strict=True)))
    return F.element_at(F.transform(F.array(cell), lambda x: F.expr(text.replace("x._x", f"{_name(x)}._x"))), 1)


def _name(x: Column) -> str:
    return x._jc.toString() if hasattr(x, "_jc") else str(x)


def cuts(df: DataFrame, columns: list[str], bits: int = BITS) -> list[list]:
    """For each column (strings or whole numbers) at most 2**bits - 1 values, ascending, that cut its rows into runs about equally long.

    A value of many rows takes several runs. Distinct values are counted and put in order by ranges, so no task sorts them all.
    """
    runs, kinds = 1 << bits, dict(df.dtypes)
    text = [F.col(c) if kinds[c] == "string" else F.lit(None).cast("string") for c in columns]
    number = [F.lit(None).cast("long") if kinds[c] == "string" else F.col(c).cast("long") for c in columns]
    value = F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), t.alias("s"), x.alias("x")) for i, (t, x) in enumerate(zip(text, number, strict=True)))))
    counts = df.select(value.alias("v")).select("v.*").where("s is not null or x is not null").groupBy("axis", "s", "x").agg(F.count("*").alias("n"))
    counts = materialise(counts.repartitionByRange("axis", "s", "x").withColumn("range", F.spark_partition_id()), "values")
    ranges = counts.groupBy("axis", "range").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("axis").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("axis", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"), F.sum("n").over(W.partitionBy("axis")).alias("whole"))
    lower = W.partitionBy("axis", "range").orderBy("s", "x").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0))).join(F.broadcast(ranges), ["axis", "range"])  # as many rows as axes and partitions
    at = F.floor((F.col("earlier") + F.col("lower")) * runs / F.col("whole"))
    first = placed.select("axis", at.alias("at"), F.struct("s", "x").alias("v")).where("at > 0").groupBy("axis", "at").agg(F.min("v").alias("v"))
    out: list[list] = [[] for _ in columns]
    for r in first.orderBy("axis", "at").collect():
        out[r["axis"]].append(r["v"]["x"] if r["v"]["s"] is None else r["v"]["s"])
    return out


def coordinate(column: str, at: list) -> Column:
    """How many of the cuts lie at or below a value; none for null."""
    if not at:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c <= F.col(column))), F.lit(0))


def documents_grid(docs: DataFrame, bits: int = BITS) -> list[Column]:
    """Language, source and size of documents (lang, source, size) on the grid."""
    names = ["lang", "source", "size"]
    return [coordinate(c, at) for c, at in zip(names, cuts(docs, names, bits), strict=True)]


def shard(df: DataFrame, cell: Column, order: list[Column], shards: int = SHARDS, most_parts: int = MOST_PARTS, group: int | None = None) -> DataFrame:
    """df with shard and slot: runs of equal numbers of rows along (cell, order).

    group: of how many of the first columns of order equal values are kept together (all but the last by default).
    """
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in ("shard", "slot")]
    group = max(1, len(order) - 1) if group is None else group
    staged = df.select(F.struct(*own).alias("row"), cell.alias("cell"), F.xxhash64(*order[:group]).alias("tie"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("order"), F.spark_partition_id().alias("origin"))
    staged = materialise(staged, "placed")
    total = F.sum("n").over(W.partitionBy())
    some = lambda whole: F.least(F.greatest(whole, F.lit(most_parts * 100)) / most_parts, F.lit(float(MOST_ROWS)))  # noqa: E731  rows that a part may hold
    # One row for each cell of the grid at most, and of parts and large groups most_parts more each: small whatever the corpus.
    groups = staged.groupBy("cell", "tie").agg(F.count("*").alias("n"))
    cells = groups.groupBy("cell").agg(F.sum("n").alias("n")).select("cell", F.ceil(F.col("n") / some(total)).alias("parts"), total.alias("whole"))
    cells = materialise(cells, "cells")
    large = groups.join(F.broadcast(cells), "cell").where(F.col("n") > some(F.col("whole")))
    large = materialise(large.select("cell", "tie", F.ceil(F.col("n") / some(F.col("whole"))).alias("own_parts")), "large-groups")
    parted = staged.join(F.broadcast(cells.select("cell", "parts")), "cell").join(F.broadcast(large), ["cell", "tie"], "left")
    alone = F.col("own_parts").isNotNull()
    sub = F.when(alone, F.pmod(F.xxhash64("order", "origin"), F.col("own_parts"))).otherwise(F.lit(0))
    part = F.struct(F.when(~alone, F.pmod("tie", F.col("parts"))).alias("some"), F.when(alone, F.col("tie")).alias("one"), sub.alias("sub"))
    parted = parted.withColumn("part", part).drop("parts", "own_parts")
    sizes = parted.groupBy("cell", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select("cell", "part", (F.sum("n").over(W.orderBy("cell", "part")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("whole"))
    placed = parted.withColumn("place", F.row_number().over(W.partitionBy("cell", "part").orderBy("tie", "order")))
    ranked = placed.join(F.broadcast(sizes), ["cell", "part"]).withColumn("at", F.col("before") + F.col("place") - 1)
    least, more = F.expr(f"whole div {shards}"), F.col("whole") % shards
    big = more * (least + 1)  # rows in the shards that hold one more
    run = F.when(F.col("at") < big, F.expr(f"at div ((whole div {shards}) + 1)")).otherwise(more + F.floor((F.col("at") - big) / F.greatest(least, F.lit(1))))
    ranked = ranked.withColumn("shard", run.cast("int"))
    start = F.col("shard") * least + F.least(F.col("shard"), more)
    return ranked.select("row.*", "shard", (F.col("at") - start).cast("long").alias("slot"))


def _one_cell(slim: DataFrame) -> DataFrame:
    """slim with the least language and source of each text in place of its rows' own.

    Rows of one text are told apart by where they were read from, so the rows of a hot text never meet by it alone.
    """
    same = ["size", "text_crc32", "text_hash"]
    parts = slim.groupBy(*same, "origin").agg(F.min(F.struct("lang", "source")).alias("least"))
    least = parts.groupBy(*same).agg(F.min("least").alias("least"))
    told = parts.drop("least").join(least, same)
    return slim.drop("lang", "source").join(told, [*same, "origin"]).select("doc_id", "least.lang", "least.source", *same)


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """A folder for each shard; about `files` files in all, each a run of neighbouring slots."""
    runs = sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    runs.write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of each document."""
    text = F.coalesce("text", F.lit(""))
    origin = F.pmod(F.spark_partition_id(), F.lit(ORIGINS))
    slim = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), origin.alias("origin"))
    slim = materialise(slim, "sizes")  # the texts are read once
    cut = cuts(slim, ["lang", "source", "size"], bits)
    slim = _one_cell(slim)
    grid = [coordinate(c, at) for c, at in zip(("lang", "source", "size"), cut, strict=True)]
    named = slim.select("*", *(d.cast("int").alias(f"_x{i}") for i, d in enumerate(grid)))
    cell = curve_index([F.col(f"_x{i}") for i in range(len(grid))], bits)
    done = shard(named, cell, [F.col("text_crc32"), F.col("size"), F.col("doc_id")], shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
