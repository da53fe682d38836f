"""Arrays of vectors in Arrow batches, shared by the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def width_of(*columns: tuple[DataFrame, str]) -> str:
    """float if all the given vector columns hold 32-bit numbers, else double: what is shuffled is no wider than what was read."""
    kinds = [df.schema[c].dataType for df, c in columns]
    return "float" if all(isinstance(k, T.ArrayType) and isinstance(k.elementType, T.FloatType) for k in kinds) else "double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", kind: str = "double") -> DataFrame:
    """(id, v): ids, none null, with vectors that are neither null nor empty nor zero and wholly finite."""
    v = F.col(f"`{vector_col}`").cast(f"array<{kind}>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, filled up with zeros to one width, and their own lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return flat.reshape(len(lengths), width), lengths
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = flat
    return out, lengths


def runs(batches, keys: list[str]):
    """Tables of rows with equal keys from batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[a].tolist())
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
