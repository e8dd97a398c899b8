"""Vector expressions and the wire format of half-precision matrices."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.schema import MEDIA_TYPES


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """A unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where one is a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


@F.pandas_udf(T.StringType())
def to_wire(vectors: pd.Series) -> pd.Series:
    """Row-major half-precision values in base64."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, np.float16).tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def from_wire(payload: pd.Series, shape: pd.Series) -> pd.Series:
    """The matrix of single-precision values that a payload of a given shape holds."""

    def one(data, dims):
        return None if data is None else np.frombuffer(base64.b64decode(data), np.float16).reshape([int(d) for d in dims]).astype(np.float32).tolist()

    return pd.Series([one(p, s) for p, s in zip(payload, shape, strict=True)])


def png(height: int, width: int, channels: int, data) -> bytes:
    """Rows of grey, BGR or BGRA bytes as an RGB PNG file, made by strips of about a megabyte; other shapes are an error."""
    if channels not in (1, 3, 4) or len(data) != height * width * channels:
        raise TypeError(f"not an image of {height} x {width} x {channels} bytes: {len(data)}")
    a = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))
    packed, body = zlib.compressobj(6), []
    step = max(1, (1 << 20) // max(1, 3 * width))
    for i in range(0, height, step):
        some = a[i : i + step]
        rgb = np.repeat(some, 3, axis=2) if channels == 1 else some[:, :, 2::-1]
        body.append(packed.compress(np.concatenate([np.zeros((len(some), 1), np.uint8), rgb.reshape(len(some), -1)], axis=1).tobytes()))
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"".join(body) + packed.flush()) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def png_of(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Decoded images as Spark's image source holds them as PNG files."""
    return pd.Series([None if x[3] is None else png(*x) for x in zip(height, width, channels, data, strict=True)])


def media_type(path: Column) -> Column:
    """From the file's extension; unknown ones count as PNG."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    found = F.lit("image/png")
    for name, kind in MEDIA_TYPES.items():
        found = F.when(extension == name, kind).otherwise(found)
    return found
