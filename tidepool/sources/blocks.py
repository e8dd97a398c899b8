"""Typed blocks and pages of documents: lines of plain text, elements of web pages, files of a folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.text import strip
from tidepool.functions.vector import png
from tidepool.schema import LINES_PER_PAGE, MIN_TEXT_LEN

_ELEMENT = r"(?is)<(h1|p|li)(?:\s[^>]*)?>(.*?)</\1>"
_DROPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def document_source(doc_id: str = "doc_id", source: str = "source") -> Column:
    """Each document is a file of its own."""
    return F.concat_ws("/", F.coalesce(F.col(source), F.lit("")), F.col(doc_id).cast("string"))


def _of_type(lines: Column, kind: str, table: bool, lines_per_page: int) -> Column:
    """The lines of one type as structs, numbered from 0 among themselves."""
    own = F.filter(lines, lambda x: F.contains(x["raw"], F.lit("|")) if table else ~F.contains(x["raw"], F.lit("|")))
    return F.transform(own, lambda x, i: F.struct((F.floor(x["pos"] / lines_per_page) + 1).cast("int").alias("page"), F.lit(kind).alias("block_type"), i.alias("block_index"), x["raw"].alias("raw")))


def block_lists(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns to keep, and blocks: each document's lines as a list of structs (page, block_type, block_index, raw), text ones first."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = documents.select("doc_id", document_source().alias("source"), *keep, F.transform(split, lambda x, i: F.struct(i.alias("pos"), x.alias("raw"))).alias("lines"))
    every = F.concat(_of_type(F.col("lines"), "text", False, lines_per_page), _of_type(F.col("lines"), "table", True, lines_per_page))
    return lines.select("doc_id", "source", *keep, every.alias("blocks"))


def raw_blocks(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Every line of every document as a block: a table row block if it has a bar, else text.

    Indices count all blocks of a document, for each type on its own, before any filter; they come
    from the document's own row, so numbering needs no shuffle.
    """
    listed = block_lists(documents, lines_per_page)
    return listed.select("doc_id", "source", F.inline("blocks")).select("doc_id", "source", "page", "block_type", "block_index", strip(F.col("raw")).alias("text"))


def extract_blocks(documents: DataFrame, min_len: int = MIN_TEXT_LEN) -> DataFrame:
    """Blocks of at least min_len characters after stripping; indices keep their gaps."""
    return raw_blocks(documents).where(F.char_length("text") >= min_len).select("doc_id", "source", "page", "block_type", "block_index", "text")


def table_markdown(documents: DataFrame) -> DataFrame:
    """Each run of lines with a bar as one Markdown table: source, first_line, n_rows and markdown, whose first row is the header.

    Cells are what bars part, stripped, the empty ones at both ends left out; rows are made as wide as the header.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = documents.select(document_source().alias("source"), F.transform(split, lambda x, i: F.struct(i.alias("i"), x.alias("x"))).alias("l"))
    bars = F.filter("l", lambda x: F.contains(x["x"], F.lit("|")))
    # A run is what keeps the same distance between a line's number and its place among the lines with bars.
    rows = lines.select("source", F.posexplode(bars).alias("p", "b")).select("source", (F.col("b.i") - F.col("p")).alias("run"), F.col("b.i").alias("i"), F.col("b.x").alias("x"))
    inner = F.regexp_replace(strip(F.col("x")), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda c: strip(c))
    tables = rows.select("source", "run", F.struct("i", cells.alias("c")).alias("row")).groupBy("source", "run").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    width = F.size(F.element_at("rows", 1)["c"])
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    wide = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    body = F.transform("rows", lambda r: line(wide(r["c"])))
    every = F.concat(F.slice(body, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(body, F.lit(2), F.size(body)))
    return tables.select("source", F.element_at("rows", 1)["i"].alias("first_line"), F.size("rows").alias("n_rows"), F.array_join(every, "\n").alias("markdown"))


def html_blocks(pages: DataFrame, min_len: int = MIN_TEXT_LEN) -> DataFrame:
    """Headings, paragraphs and list items of web pages, scripts, styles, comments and tags removed."""
    clean = F.regexp_replace(F.coalesce("html", F.lit("")), _DROPPED, "")
    found = pages.select("page_id", F.col("url").alias("source"), F.posexplode(F.regexp_extract_all(clean, F.lit(_ELEMENT), F.lit(2))).alias("pos", "raw"))
    text = strip(F.regexp_replace("raw", "<[^>]*>", ""))
    return found.select("page_id", "source", "pos", text.alias("text")).where(F.char_length("text") >= min_len).select("page_id", "source", F.col("pos").alias("block_index"), "text")


def first_page(provenance: Column) -> Column:
    """The page of a block's first place, null where it has none."""
    return F.try_element_at(provenance, F.lit(1))["page_no"]


def iter_pages(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """The pages of every document, from 1, with their whole text."""
    lines = documents.select("doc_id", document_source().alias("source"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(lines_per_page))
    cut = lines.select("doc_id", "source", F.posexplode(F.transform(starts, lambda a: F.slice(F.col("lines"), a + 1, F.lit(lines_per_page)))).alias("p", "own"))
    return cut.select("doc_id", "source", (F.col("p") + 1).alias("page"), F.array_join("own", "\n").alias("page_text"))


def page_count(documents: DataFrame) -> DataFrame:
    """How many pages each source has."""
    n = F.ceil(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) / LINES_PER_PAGE).cast("int")
    return documents.select("doc_id", document_source().alias("source"), n.alias("n_pages"))


def lookup_pages(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (source, page) that exist; pages count from 1. Only documents that have a wanted page are cut, and only these pages."""
    asked = wanted.select("source", "page").where("page > 0").distinct()
    lines = documents.select("doc_id", document_source().alias("source"), F.col("text")).join(asked, "source")
    lines = lines.select("doc_id", "source", "page", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    first = (F.col("page") - 1) * LINES_PER_PAGE + 1
    return lines.where(first <= F.size("lines")).select("doc_id", "source", "page", F.array_join(F.slice("lines", first, F.lit(LINES_PER_PAGE)), "\n").alias("page_text"))


def plain_raster(text: str | None, scale: float = 1.5) -> tuple[int, int, int, bytes]:
    """A stand-in for a renderer: (height, width, channels, data), a grey page where each character but white space is a dark dot of `scale` pixels."""
    dot = max(1, round(scale))
    lines = [np.frombuffer(line.encode("utf-32-le"), np.uint32) for line in (text or "").split("\n")]
    a = np.full((len(lines), max(1, *map(len, lines))), 0xFF, np.uint8)
    for i, line in enumerate(lines):
        a[i, : len(line)] = np.where(line == 0x20, 0xFF, 0x40)
    a = a.repeat(dot, axis=0).repeat(dot, axis=1)
    return *a.shape, 1, a.tobytes()


def page_images(pages: DataFrame, scale: float = 1.5, render=plain_raster) -> DataFrame:
    """pages (source, page, page_text) with image, a PNG file of each page, drawn by a pluggable renderer (text, scale).

    A page is drawn and packed before the next one, so that one raster is held at a time and none leaves its task.
    """

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 64):
                part = b.slice(a, 64)
                images = pa.array([png(*render(t.as_py(), scale)) for t in part.column("page_text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, images], names=[*part.schema.names, "image"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("image", T.BinaryType())]))


DEFAULT_PATHS = ("data/*.pdf",)


def read_files(spark: SparkSession, paths: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """(files as binary rows, paths that match no file): missing files are reported and skipped; no paths mean the default ones."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def matches(p: str) -> bool:
        found = hadoop.Path(p).getFileSystem(conf).globStatus(hadoop.Path(p))
        return found is not None and len(found) > 0

    paths = list(paths or DEFAULT_PATHS)
    there = [p for p in paths if matches(p)]
    found = spark.read.format("binaryFile").load(there) if there else None
    return found, [p for p in paths if p not in there]


def skip_report(missing: list[str]) -> str:
    """A line for each path that was skipped."""
    return "\n".join(f"SKIP {p}: no such file" for p in missing)
