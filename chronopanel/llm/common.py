"""Helpers the training-data operators share.

Words are runs of characters other than the six ASCII blanks (tab to carriage return, and space).
On UTF-8 bytes this is exactly what ``bytes.split()`` cuts at, so words never need a regular expression
inside a Python task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: pattern of a word, for SQL functions
WORD = r"[^\x20\x09-\x0D]+"
#: pattern of what lies between words
BLANKS = r"[\x20\x09-\x0D]+"
#: texts are handed on in pieces of about this many bytes inside a task
CHUNK_BYTES = 3_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_KINDS = {"long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def fields(ddl: str) -> T.StructType:
    """``a long, b string`` as a type; unlike Spark's parser it needs no session, so modules can use it."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in ddl.split(", "))])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def names(df: DataFrame) -> list[str]:
    """All column names of a table, quoted."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, _UPPER, _UPPER.lower())


def text_key(text: Column) -> Column:
    """128 bits of a text (null: empty) as a struct of two longs; equal texts have equal keys."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(t, F.lit(0)).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes in each (a longer text alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(batch.schema.get_field_index(column)))[1]
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: Spark uses the worker again in other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other C libraries have none
    if trim is not None:
        trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of every i, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
