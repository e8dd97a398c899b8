"""Costs and latency told by the job itself: rows, tokens and seconds of a plan while it is written, with no second job."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, metrics: dict[str, Column], write: Callable[[DataFrame, str], DataFrame], name: str = "observed") -> tuple[DataFrame, dict]:
    """(df as written, what its job counted): metrics are aggregates, worked out as rows pass; rows and seconds come on top."""
    seen = Observation(name)
    began = time.monotonic()
    done = write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in metrics.items())), name)
    return done, dict(seen.get) | {"seconds": time.monotonic() - began}
