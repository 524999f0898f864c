"""Rows of ``embeddings`` as whole numbers in units of 1/256."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 256
#: Entries are held within these bounds, so that sums over a vector stay whole numbers of 64 bits.
BOUND = 1 << 53


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def whole(column: pa.Array, dim: int, bound: int = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that have ``dim`` entries, all of them finite, and their
    entries as floor(256 * entry), one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(at), dim)  # a null becomes NaN
    fine = np.isfinite(values).all(axis=1)
    return at[fine], np.clip(np.floor(UNIT * values[fine]), -bound, bound).astype(np.int64)


def pack(x: np.ndarray) -> pa.Array:
    """Rows as bytes, 2 an entry where all of a row fit, else 8: equal rows have equal bytes."""
    small = (np.abs(x) < 1 << 15).all(axis=1) if len(x) else np.zeros(0, bool)
    two, eight = x.astype("<i2"), x.astype("<i8")
    return pa.array([two[k].tobytes() if s else eight[k].tobytes() for k, s in enumerate(small.tolist())], pa.binary())


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.empty((len(column), dim), np.int64)
    size = column.cast(pa.large_binary())
    size = np.asarray(pc.binary_length(size).to_numpy(zero_copy_only=False))
    for width, kind in ((2, "<i2"), (8, "<i8")):
        at = np.flatnonzero(size == width * dim)
        if len(at):
            raw = b"".join(column.take(pa.array(at)).to_pylist())
            out[at] = np.frombuffer(raw, kind).reshape(len(at), dim)
    return out


def dimension(rows: DataFrame) -> int:
    """The most common length of the vectors without null or non-finite entries
    (of equally common ones the longest); 0 if there is none. One row per length is counted."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))), F.lit(False)))
    best = rows.where(fine & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("dim")).count().agg(
        F.max(F.struct("count", "dim")).alias("m")).first()
    return best.m.dim if best and best.m else 0


def rows_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)
