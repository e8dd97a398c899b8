"""Name-based identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.schema import CAPTION_NAMESPACE, TEXT_NAMESPACE, VISION_NAMESPACE


def uuid5(namespace: str, name: Column) -> Column:
    """The UUID of version 5 of a name in a namespace."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def block_id(source: Column, block_type: Column, block_index: Column) -> Column:
    return uuid5(TEXT_NAMESPACE, F.concat_ws(":", source, block_type, block_index.cast("string")))


def page_id(source: Column, page: Column) -> Column:
    return uuid5(VISION_NAMESPACE, F.concat_ws(":", source, F.lit("page"), page.cast("string")))


def caption_id(source: Column, page: Column) -> Column:
    return uuid5(CAPTION_NAMESPACE, F.concat_ws(":", source, F.lit("caption"), F.lit("page"), page.cast("string")))
