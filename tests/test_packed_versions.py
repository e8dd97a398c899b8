"""Blocks pass through the state as strings, a row for each source."""

from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidepool.streaming import versions

TEXTS = ["plain words and more", "  two  spaces and \t tabs ", "quote \" back \\ slash | bar \x1f   end", "0 text 7 like a head", "é ü 한국 🙂 letters", " ", ""]


def test_blocks_come_out_as_they_went_in(spark):
    rows = [(f"{i:036d}", f"{i:032x}", i + 1, "table" if i % 2 else "text", i, t) for i, t in enumerate(TEXTS)]
    blocks = spark.createDataFrame(rows, "id string, hash string, page int, block_type string, block_index int, text string")
    told = blocks.agg(F.collect_list(versions.packed(F.struct("*"))).alias("changed")).select(F.lit("s").alias("source"), F.lit(3).cast("long").alias("version"), "changed", F.array(F.lit("x" * 36)).alias("gone"))
    got = versions.unpacked(told)
    assert got.columns == [c.split()[0] for c in versions.CHANGES.split(", ")]
    assert sorted(tuple(r) for r in got.where("not deleted").collect()) == [("s", i, 3, False, page, kind, n, t) for i, _, page, kind, n, t in rows]
    assert [tuple(r) for r in got.where("deleted").collect()] == [("s", "x" * 36, 3, True, None, None, None, None)]


def test_a_source_that_changed_is_one_row_of_strings():
    held = {}
    value = SimpleNamespace(get=lambda: held.get("v"), update=lambda new: held.update(v=new))
    p = versions.PackedVersions()
    p.init(SimpleNamespace(getValueState=lambda name, schema: value))
    block = lambda i, h: f"{i:036d} {h * 32} 1 text {i} some text {i}"
    turn = lambda version, blocks: list(p.handleInputRows(("s",), iter([Row(version=version, hash="h", blocks=blocks)]), None))
    assert turn(1, [block(i, "a") for i in range(3)]) == [Row(source="s", version=1, changed=[block(i, "a") for i in range(3)], gone=[])]
    assert turn(1, [block(0, "b")]) == [] and turn(2, [block(i, "a") for i in range(3)]) == []
    assert turn(3, [block(0, "a"), block(1, "b")]) == [Row(source="s", version=3, changed=[block(1, "b")], gone=[f"{2:036d}"])]
    (last,) = turn(4, [])
    assert last.changed == [] and sorted(last.gone) == [f"{i:036d}" for i in range(2)] and held["v"] == (4, "")
