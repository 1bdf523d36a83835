"""Shared helpers: the folder all executors see, written intermediate tables, Arrow-batched column functions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from colloquy.shared import new_folder

#: ASCII white space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and lost executors cost
    no recomputation. The files go when the session ends."""
    path = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: bound what one Arrow batch holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


_kept: list = []


def keep(owner: str, key, make: Callable):
    """What a Python worker holds from batch to batch: one operator's state at a time. Workers serve all operators
    in turn, and what each of them once loaded would add up."""
    if not _kept or _kept[0][:2] != (owner, key):
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _kept.append((owner, key, make()))
    return _kept[0][2]


def steady_heap() -> None:
    """In a worker that makes many arrays of a few MB: their memory stays with the process from one to the next."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def column_udf(fn: Callable, kind: T.DataType | str, raw: bool = False) -> Callable[..., Column]:
    """fn(list of Python values, ...) -> list or Arrow array, evaluated once a row over Arrow batches. raw: fn gets
    Arrow arrays."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    arrow = to_arrow_type(kind)

    def batch(*cols):
        out = fn(*(c if raw else c.to_pylist() for c in cols))
        return out if isinstance(out, pa.Array) else pa.array(out, arrow)

    return arrow_udf(batch, kind, ArrowUDFType.SCALAR).asNondeterministic()


def binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array of data[edges[i]:edges[i + 1]], without a Python object for each. Edges count elements of data
    (bytes, where data has more dimensions)."""
    width = data.itemsize if data.ndim == 1 else 1
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((np.asarray(edges) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those that would clash with names (in either case)."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]
