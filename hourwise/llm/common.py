"""Small helpers of the text operators."""
from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}
SLICE_ROWS = 256          # rows a worker turns into Python objects at once


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix for working columns that begins no name in `columns`, whatever the case of its letters."""
    names, prefix = [c.lower() for c in columns], "__w"
    while any(c.startswith(prefix) for c in names):
        prefix += "_w"
    return prefix + "_"


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def objects(array: pa.Array) -> list:
    """The values of an array of texts or bytes as Python objects; Arrow makes them at once, `to_pylist` one at a time."""
    return array.to_numpy(zero_copy_only=False).tolist()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The kept columns of `batch` with new ones behind them, in the order of `schema`."""
    arrays = [batch.column(n).cast(schema.field(n).type) if n in keep else
              (columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], schema.field(n).type)) for n in schema.names]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def give_back() -> None:
    """Hand freed memory of this worker back to the system: workers live on, and the next stage needs it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers by name, or any path."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)
