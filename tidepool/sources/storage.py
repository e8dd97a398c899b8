"""Tables that a plan writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, deleted when Python ends; a local master without one gets a temporary folder, any other an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share: the master is {master}")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidepool-"))
        told = _own[0]
    path = f"{told}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_all)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table, which cuts the lineage."""
    path, schema = shared_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop_all() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass
