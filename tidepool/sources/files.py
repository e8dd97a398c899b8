"""Text files as pages or documents: a data source for Spark, the writer of such files, and the way from files to a collection.

    spark.dataSource.register(PageFiles)
    spark.read.format("page_files").option("paths", root).load()

A file is a document. Under a root each has a path that follows from its source (`path_of`), in one of FOLDERS folders, so a filter
on source opens that file and lists nothing. Without one, a partition is a run of folders or of files that were named, and tasks
list folders themselves; nothing about single files passes the driver. Filters on source and page reach the reader where
spark.sql.python.filterPushdown.enabled is set (`read_pages` does); without it they are applied to what is read.

A path that isn't there gives one row whose `error` says so, and a file that isn't UTF-8 text likewise: that is the report of what was
skipped, from the tasks that looked. Files are reached by pyarrow's file systems (local paths, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidepool.schema import LINES_PER_PAGE
from tidepool.sources.blocks import document_source

FOLDERS, RUNS, ENDING = 256, 64, ".txt"
_PAGES, _DOCUMENTS = "source string, page int, page_text string, error string", "doc_id string, source string, text string, error string"


def path_of(source: str) -> str:
    """Where under its root the file of a source lies."""
    return f"{crc32(source.encode()) % FOLDERS:03d}/{quote(source, safe='')}{ENDING}"


def source_of(path: str) -> str:
    """The source of a file: as path_of() spells it, or the path itself for a file of another name."""
    name = path.rpartition("/")[2]
    source = unquote(name.removesuffix(ENDING))
    return source if path.endswith(path_of(source)) else path


class _Run(InputPartition):
    """Paths that one task reads; a folder stands for the files in it."""

    def __init__(self, paths: list[tuple[str, str]]) -> None:
        self.paths = paths  # (path, the source it is read for; empty if it tells its own)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], unit: str, lines_per_page: int) -> None:
        self.roots, self.unit, self.lines = roots, unit, lines_per_page
        self.sources: set[str] | None = None
        self.pages: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column == "source" and self.unit == "pages":
                self.sources = values if self.sources is None else self.sources & values
            elif column == "page" and self.unit == "pages":
                self.pages = values if self.pages is None else self.pages & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Runs of folders, or of the files that filters and paths name."""
        found: list[tuple[str, str]] = []
        for root in self.roots:
            where, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
            folder = where.get_file_info(path).type == fs.FileType.Directory
            if folder and self.sources is not None:
                found += [(f"{root}/{path_of(s)}", s) for s in sorted(self.sources)]
            elif folder:
                inner = [i for i in where.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory]
                found += [(f"{root}/{i.base_name}", "") for i in sorted(inner, key=lambda i: i.base_name)] or [(root, "")]
            else:
                found.append((root, ""))
        step = max(1, -(-len(found) // RUNS))
        return [_Run(found[a : a + step]) for a in range(0, len(found), step)] or [_Run([])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        for path, source in partition.paths:
            where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            info = where.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                if not source:  # a source that a filter asks for and no root has is no missing path
                    yield self._failed(path, "no such file")
                continue
            names = [i.path for i in where.get_file_info(fs.FileSelector(inner)) if i.is_file] if info.type == fs.FileType.Directory else [inner]
            for name in sorted(names):
                own = source_of(name)
                if self.sources is not None and own not in self.sources:
                    continue
                try:
                    with where.open_input_file(name) as f:
                        text = f.read().decode()
                except (OSError, UnicodeDecodeError) as error:
                    yield self._failed(own, f"{type(error).__name__}: {str(error)[:200]}")
                    continue
                yield from self._rows(own, text)

    def _failed(self, source: str, error: str) -> tuple:
        return (source, None, None, error) if self.unit == "pages" else (None, source, None, error)

    def _rows(self, source: str, text: str) -> Iterator[tuple]:
        if self.unit == "documents":
            folder, _, name = source.rpartition("/")
            yield name, folder, text, None
            return
        lines = text.split("\n")
        for p in range(-(-len(lines) // self.lines)):
            if self.pages is None or p + 1 in self.pages:
                yield source, p + 1, "\n".join(lines[p * self.lines : (p + 1) * self.lines]), None


class PageFiles(DataSource):
    """Options: paths (one, or a JSON list of files and roots), unit (pages or documents), lines_per_page."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return _DOCUMENTS if self.options.get("unit", "pages") == "documents" else _PAGES

    def reader(self, schema) -> DataSourceReader:
        told = self.options["paths"]
        roots = json.loads(told) if told.startswith("[") else [told]
        return _Reader([r.rstrip("/") for r in roots], self.options.get("unit", "pages"), int(self.options.get("lines_per_page", LINES_PER_PAGE)))


def _read(spark: SparkSession, paths: list[str], unit: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)
    return spark.read.format("page_files").option("paths", json.dumps(paths)).option("unit", unit).load()


def read_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, page, page_text and error of files and roots; filters on source and page open only what they need."""
    return _read(spark, paths, "pages")


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, source, text and error: each file as a document."""
    return _read(spark, paths, "documents")


def write_documents(documents: DataFrame, root: str) -> DataFrame:
    """Each of documents (doc_id, source, text) as a file under root; (files, bytes) of each task, which write when this is read.

    A task that runs again writes the same files; of documents of equal source and id any one stays; a null text is an empty file.
    """

    def run(batches):
        files = size = 0
        where, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        made: set[str] = set()
        for b in batches:
            for source, text in zip(b.column("source").to_pylist(), b.column("text").to_pylist(), strict=True):
                name = path_of(source)
                folder = f"{path}/{name[:3]}"
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                raw = (text or "").encode()
                with where.open_output_stream(f"{path}/{name}") as out:
                    out.write(raw)
                files, size = files + 1, size + len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([files]), pa.array([size])], names=["files", "bytes"])

    return documents.select(document_source().alias("source"), F.col("text")).mapInArrow(run, "files long, bytes long")


def index_files(spark: SparkSession, paths: list[str], collection, points) -> DataFrame:
    """Upsert the points of all files into a collection; what was skipped comes back as (source, error).

    points: from documents to what the collection holds, as streaming.index_upkeep.points. Files are read twice, once for the report.
    """
    documents = read_documents(spark, paths)
    collection.ensure()
    collection.upsert(points(documents.where("error is null").drop("error")))
    return documents.where("error is not null").select("source", "error")
