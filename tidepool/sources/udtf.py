"""Blocks of pages as a table function of SQL.

    SELECT * FROM tidepool_blocks(TABLE(pages))

The table has source, page and page_text; the function asks for it by source, in order of pages: a partition is one source, whose blocks are numbered by type across its pages.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidepool.schema import MIN_TEXT_LEN

NAME = "tidepool_blocks"
_OUT = T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("block_type", T.StringType()), T.StructField("block_index", T.IntegerType()), T.StructField("text", T.StringType())])


@udtf
class Blocks:
    """Every line of a page is a block, of a table if it has a bar, else of text; shorter ones than min_len are left out and leave gaps."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, min_len: AnalyzeArgument | None = None) -> AnalyzeResult:
        """Asks for pages by source, in order; an error for a table of other columns."""
        if not pages.isTable or not {"source", "page", "page_text"} <= set(pages.dataType.names):
            raise ValueError(f"{NAME} takes a table with source, page and page_text")
        return AnalyzeResult(_OUT, partitionBy=[PartitioningColumn("source")], orderBy=[OrderingColumn("page")])

    def __init__(self) -> None:
        self.next = {"text": 0, "table": 0}

    def eval(self, row: Row, min_len: int = MIN_TEXT_LEN):
        for line in (row["page_text"] or "").split("\n"):
            kind = "table" if "|" in line else "text"
            number, self.next[kind] = self.next[kind], self.next[kind] + 1
            text = line.strip()
            if len(text) >= min_len:
                yield row["source"], row["page"], kind, number, text


def register(spark: SparkSession) -> None:
    spark.udtf.register(NAME, Blocks)
