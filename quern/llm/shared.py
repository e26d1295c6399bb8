"""Arrow helpers, and the tables of the core package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..tables import Scratch, delete, shared_folder  # noqa: F401


def small_batches(spark: SparkSession) -> None:
    """Texts are long: bound what one Arrow batch holds, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions, which whoever runs the job sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for columns in f(batches):
                yield pa.RecordBatch.from_arrays([_column(columns[x.name], x.type) for x in arrow], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        return


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores appended while a column of that name is there already."""
    seen, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in seen:
            n += "_"
        out.append(n)
    return out


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed ones, bit by bit."""
    return x.view(np.int64)
