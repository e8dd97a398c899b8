"""A table laid out for lookups by key: bucketed and sorted by it, with bloom filters, so that a lookup moves what is asked for and not the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(df: DataFrame, key: str, path: str, name: str, buckets: int | None = None) -> DataFrame:
    """df as a table at a path in `buckets` buckets by key, each sorted by it, with a bloom filter on the key in each row group.

    Joined by key to rows in as many partitions, it stays where it is; an equality on the key opens one bucket and skips row groups.
    """
    spark = df.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    # Row groups of some megabytes, so that a filter passes most of a bucket over.
    out.option("parquet.bloom.filter.enabled#" + key, "true").option("parquet.block.size", 4 << 20).saveAsTable(name)
    return spark.table(name)


def looked_up(table: DataFrame, wanted: DataFrame, key: str, others: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a bucketed table that wanted (key, others) names; wanted is gathered by key, which is how the table lies, so the table isn't moved.

    Of one key wanted's others are one list, no longer than the key's rows in any table of distinct ones.
    """
    asked = wanted.groupBy(key).agg(F.collect_set(F.struct(*others)).alias("_asked")) if others else wanted.select(key).distinct()
    found = table.join(asked, key)
    return found.where(F.array_contains("_asked", F.struct(*others))).drop("_asked") if others else found


def one(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key."""
    return table.where(F.col(key) == F.lit(value))
