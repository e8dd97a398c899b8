"""A client of a remote embedding service, run on executors with one connection for each task."""

from __future__ import annotations

import json
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.vector import from_wire


class EmbeddingClient:
    """Posts texts or images and returns payloads of half-precision matrices; service errors are raised."""

    def __init__(self, url: str, timeout: float = 60.0) -> None:
        self.url, self.timeout = url.rstrip("/"), timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            return json.load(r)

    def health(self) -> dict:
        return self._call("/health")

    def embed_image(self, image_b64: str) -> dict:
        return self._call("/embed_image", {"image_b64": image_b64})

    def embed_query(self, query: str) -> dict:
        return self._call("/embed_query", {"query": query})

    def embed_queries(self, queries: list[str]) -> list[dict]:
        return self._call("/embed_queries", {"queries": queries})["embeddings"]

    def close(self) -> None:
        """Nothing is kept open between calls; callers may still end with it."""


def checked(queries: DataFrame) -> DataFrame:
    """Blank queries are an error, as they are for the service."""
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    return queries.withColumn("query", F.when(blank, F.raise_error(F.lit("a query must not be blank"))).otherwise(F.col("query")))


def _embedded(rows: DataFrame, make_client, ask, batch: int) -> DataFrame:
    """rows with vectors; ask(client, list of the last column's values) gives as many payloads, anything else is an error."""

    def run(batches):
        client = make_client()
        try:
            for b in batches:
                for a in range(0, len(b), batch):
                    part = b.slice(a, batch)
                    got = ask(client, part.column(part.num_columns - 1).to_pylist())
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} embeddings for {len(part)} inputs")
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([g["embedding_b64"] for g in got]), pa.array([g["shape"] for g in got], pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "embedding_b64", "shape"])
        finally:
            getattr(client, "close", lambda: None)()

    kept = T.StructType(rows.schema.fields[:-1])
    sent = rows.mapInArrow(run, T.StructType([*kept.fields, T.StructField("embedding_b64", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType()))]))
    return sent.select(*kept.names, from_wire("embedding_b64", "shape").alias("vectors"))


def embed_queries(queries: DataFrame, make_client, batch: int = 8) -> DataFrame:
    """queries (qid, query) with vectors, `batch` a call; make_client is called once for each task."""
    source = checked(queries).select("qid", "query", F.col("query").alias("_input"))
    return _embedded(source, make_client, lambda client, some: client.embed_queries(some), batch)


def embed_query(queries: DataFrame, make_client) -> DataFrame:
    """queries (qid, query) with vectors, one a call."""
    source = checked(queries).select("qid", "query", F.col("query").alias("_input"))
    return _embedded(source, make_client, lambda client, some: [client.embed_query(q) for q in some], 1)


def embed_images(pages: DataFrame, make_client) -> DataFrame:
    """pages (image, a file, and any other columns) with vectors in place of the image, one a call: a multi-vector index's points."""
    rest = [c for c in pages.columns if c != "image"]
    source = pages.select(*rest, F.translate(F.base64("image"), "\r\n", "").alias("_input"))
    return _embedded(source, make_client, lambda client, some: [client.embed_image(i) for i in some], 1).withColumn("n_patches", F.size("vectors"))
