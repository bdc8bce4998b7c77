"""Arrow batches in and out of Python workers, in bounded pieces."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: What Spark puts into a batch for a worker, at most (a single row may be larger).
ROWS_PER_BATCH, BYTES_PER_BATCH = 8192, "8m"
#: What a worker works on, or gives back, at once where the work takes many times its size.
PIECE_BYTES = 1 << 20


def small_batches(spark) -> None:
    """Hold the batches that go to Python workers small, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


def pieces(b: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in pieces of up to most bytes of a string column (a single row may be larger)."""
    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, to - at)
        at = to


def released(f: Callable) -> Callable:
    """f over the batches of a task, after which the worker's freed memory goes back to the system: workers wait for
    further tasks, and what they hold counts as the executor's while others work."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return run


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """f maps a batch to columns (a dict of arrays), or to several such; order and types follow the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            out = f(b)
            for cols in [out] if isinstance(out, dict) else out:
                arrays = [x if isinstance(x, pa.Array) and x.type == t.type else pa.array(x, t.type) for t, x in ((t, cols[t.name]) for t in target)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(released(run), schema)
