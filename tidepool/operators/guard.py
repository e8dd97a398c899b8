"""Plug-ins that run by row: a value or an error for each, so that one bad row fails alone."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def guarded(rows: DataFrame, run: Callable[[dict], object], value: str = "value string") -> DataFrame:
    """rows with the field `value` that run gives for each as a dict, and error: what it raised, else null.

    run is shipped to the tasks and must give what the field's type holds; a value that doesn't fit is an error of its row too.
    """
    field = T.StructType.fromDDL(value).fields[0]
    kind = to_arrow_type(field.dataType)
    schema = T.StructType([*rows.schema.fields, field, T.StructField("error", T.StringType())])

    def told(row: dict):
        try:
            return pa.array([run(row)], kind)[0].as_py(), None
        except Exception as error:  # noqa: BLE001  whatever a plug-in raises is the row's
            return None, f"{type(error).__name__}: {str(error)[:200]}"

    def each(batches):
        for b in batches:
            got = [told(row) for row in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.string())], names=schema.names)

    return rows.mapInArrow(each, schema)
