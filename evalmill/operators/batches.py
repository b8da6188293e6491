"""Pandas frames inside tasks whose whole numbers survive nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def whole_frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as a frame. A column of whole numbers with nulls stays one (pandas alone makes it floating point, which changes numbers beyond 2**53)."""
    columns = {}
    for name, column in zip(batch.schema.names, batch.columns):
        exact = pa.types.is_integer(column.type) and column.null_count
        columns[name] = pd.Series(pd.arrays.ArrowExtensionArray(column)) if exact else column.to_pandas()
    return pd.DataFrame(columns)


def _column(values: pd.Series, kind: pa.DataType) -> pa.Array:
    made = pa.array(values, type=kind, from_pandas=True)
    return made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made


def map_frames(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` without its change of nullable whole numbers to floating point."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(map(whole_frame, batches)):
            yield pa.RecordBatch.from_arrays([_column(frame[f.name], f.type) for f in wanted], schema=wanted)

    return rows.mapInArrow(body, schema)
