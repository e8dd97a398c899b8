import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidepool.llm import hilbert as H


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), ", ".join(f"c{i} int" for i in range(dims)))
    rows = sorted(cells.select("*", H.curve_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(1 << bits * dims))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a[:-1], b[:-1], strict=True)) == 1


def check(rows, n, shards=8):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.get(s, 0) for s in range(shards)) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    assert set(sizes) <= set(range(shards))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_whole_table(small):
    rows = H.shard_documents(small).collect()
    check(rows, small.count())
    texts = {r.doc_id: r.text.encode() for r in small.collect()}
    assert all((r.size, r.text_crc32, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), None) for r in rows)


def test_hot_cells_are_parted_and_order_follows_the_curve(spark):
    df = spark.range(5_003).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 10).alias("cell"), F.lit("x").alias("slot"), F.lit("y").alias("part"), F.lit(1).alias("n"))
    for parts in (4, 64, 1 << 20):
        rows = H.shard(df, F.col("cell"), [F.col("id")], most_parts=parts).collect()
        check(rows, 5_003)
        rows.sort(key=lambda r: (r.shard, r.slot))
        assert [r.cell for r in rows] == sorted(r.cell for r in rows)
        assert {r.part for r in rows} == {"y"}


def test_odd_documents(odd_docs, no_docs):
    rows = H.shard_documents(odd_docs).collect()
    check(rows, odd_docs.count())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (2, 3)} == {(1, 0)}
    assert H.shard_documents(no_docs).count() == 0
    check(H.shard_documents(odd_docs.limit(3)).collect(), 3)


def test_files_hold_runs_of_slots(spark, small, tmp_path):
    sized = small.withColumn("size", F.octet_length("text").cast("long"))
    grid = [d.cast("int") for d in H.documents_grid(sized)]
    done = H.shard(sized, H.curve_index(grid, H.BITS), [F.col("doc_id")], shards=4)
    H.write_shards(done, str(tmp_path / "s"), 8)
    back = spark.read.parquet(str(tmp_path / "s")).withColumn("file", F.input_file_name())
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in small.collect())
    runs = back.groupBy("shard", "file").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b - r.a + 1 == r.n for r in runs) and len({r.shard for r in runs}) == 4


def plain_cuts(values, runs=16):
    """Values at which a run begins, runs counted over sorted rows."""
    rows, out, last = sorted(v for v in values if v is not None), [], None
    for v in sorted(set(rows)):
        at = rows.index(v) * runs // len(rows)
        if at and at != last:
            out.append(v)
            last = at
    return out


def test_cuts_against_sorted_rows(spark):
    rows = [(f"s{i * i % 37:02d}" if i % 3 else "s05", None if i % 11 == 0 else i * 7919 % 501) for i in range(2_000)]
    df = spark.createDataFrame(rows, "s string, x long").repartition(5)
    assert H.cuts(df, ["s", "x"]) == [plain_cuts([r[i] for r in rows]) for i in (0, 1)]
    assert H.cuts(df.limit(0), ["s", "x"]) == [[], []]


def test_every_slot_follows_from_curve_text_and_id(spark):
    """Slots of a real table against rows sorted by cell, one for each text; within it rows of one text are neighbours, ordered by doc_id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    size = {i: len(r.text.encode()) + 1 for i, r in rows.items()}
    axes = [{i: r.lang for i, r in rows.items()}, {i: r.source for i, r in rows.items()}, size]
    at = [plain_cuts(a.values()) for a in axes]
    least = {}  # the least language and source of each text stand for all of its rows
    for r in rows.values():
        least[r.text] = min(least.get(r.text, (r.lang, r.source)), (r.lang, r.source))
    for j in (0, 1):
        axes[j] = {i: least[r.text][j] for i, r in rows.items()}
    points = {i: tuple(sum(c <= a[i] for c in cut) for a, cut in zip(axes, at, strict=True)) for i in rows}
    cells = spark.createDataFrame([(i, *p) for i, p in points.items()], "doc_id long, x int, y int, z int")
    curve = {r.doc_id: r.h for r in cells.select("doc_id", H.curve_index([F.col("x"), F.col("y"), F.col("z")], 4).alias("h")).collect()}
    got = sorted(H.shard_documents(docs).collect(), key=lambda r: (r.shard, r.slot))
    assert [curve[r.doc_id] for r in got] == sorted(curve.values())
    texts = [(curve[r.doc_id], rows[r.doc_id].text) for r in got]
    starts = [t for i, t in enumerate(texts) if not i or texts[i - 1] != t]
    assert len(starts) == len(set(starts)) < len(got)
    assert all(a.doc_id < b.doc_id for a, b, t, u in zip(got, got[1:], texts, texts[1:], strict=False) if t == u)
    n = len(got)
    assert [(r.shard, r.slot) for r in got] == [(s, k) for s in range(8) for k in range(n // 8 + (s < n % 8))]


def test_rows_equal_in_every_column_are_parted(spark):
    df = spark.range(20_000, numPartitions=16).select(F.lit(1).alias("cell"), F.lit("same").alias("t"), F.lit(None).cast("long").alias("doc_id"))
    done = H.shard(df, F.col("cell"), [F.col("t"), F.col("doc_id")], most_parts=64)
    check(done.collect(), 20_000)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "own_parts" in plan


def test_files_are_pruned_on_every_axis(spark, tmp_path):
    """Of 64 files, those whose minima and maxima admit a filter: far fewer along the curve than in the order of doc_id."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("size", F.octet_length("text").cast("long"))
    done = H.shard(docs, H.curve_index([d.cast("int") for d in H.documents_grid(docs)], H.BITS), [F.col("text"), F.col("doc_id")]).drop("text")
    H.write_shards(done, str(tmp_path / "curve"), 64)
    docs.drop("text").repartitionByRange(64, "doc_id").write.parquet(str(tmp_path / "plain"))
    share = {}
    for name in ("curve", "plain"):
        files = spark.read.parquet(str(tmp_path / name)).groupBy(F.input_file_name().alias("f")).agg(*(f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for f, n in ((F.min, "lo"), (F.max, "hi")))).collect()
        hits = []
        for c in ("lang", "source", "size"):
            values = [r[0] for r in docs.select(c).distinct().orderBy(c).collect()]
            hits.append(sum(f[f"lo_{c}"] <= v <= f[f"hi_{c}"] for f in files for v in values) / len(files) / len(values))
        share[name] = hits
    assert all(a < 0.8 * b for a, b in zip(share["curve"], share["plain"], strict=True)) and sum(share["curve"]) < 0.5 * sum(share["plain"]), share


def test_groups_of_equal_texts_lie_in_one_shard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    placed = H.shard_documents(docs).join(docs.select("doc_id", F.md5("text").alias("t")), "doc_id")
    groups = placed.groupBy("t").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).where("n > 1").collect()
    assert len(groups) > 500
    # only the seven cuts between shards part a group
    assert sum(g.shards > 1 for g in groups) <= 7 and max(g.shards for g in groups) <= 2


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "MOST_ROWS", 50)
    df = spark.range(3_000, numPartitions=4).select("id", (F.col("id") % 3).alias("cell"), (F.col("id") % 7).alias("t"))
    check(H.shard(df, F.col("cell"), [F.col("t"), F.col("id")], most_parts=2).collect(), 3_000)
