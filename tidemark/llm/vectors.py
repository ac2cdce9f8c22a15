"""Vectors as blocks of whole numbers: what the iterative vector operators read again and again.

A row of the block table holds up to BLOCK vectors: their ids, what else is carried, and their
components as one column-major matrix of the narrowest type that holds them. A pass over the table
moves a few large binary values instead of lists, and no task holds more than a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release, scratch
from tidemark.llm.topk import quantised

#: Vectors and components of a block at most.
BLOCK = 2048
CELLS = 1 << 18
LONG = 2**63 - 1


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, shift: int = 0, **carried: str) -> DataFrame:
    """id, v and what is carried of every sound row: v is floor(scale * x) + shift of every component.
    Rows are left out whose vector is null or has a null or non-finite component. Numbers beyond 63
    bits become the nearest that fits."""
    v = F.transform(quantised(F.col(f"`{vector_col}`"), scale), lambda x: F.least(x, F.lit(LONG - shift)) + F.lit(shift))
    columns = [F.col(f"`{c}`").alias(n) for n, c in carried.items()]
    return df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"), *columns).where(F.col("v").isNotNull())


def _matrix(column: pa.Array, fill: int) -> np.ndarray:
    """Rows of a list column, padded to one width, in columns that follow each other in memory."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return np.asfortranarray(flat.reshape(len(column), width))
    out = np.full((len(column), width), fill, np.int64, order="F")
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def vector_blocks(whole: DataFrame, name: str, fill: int = 0) -> DataFrame:
    """Writes what `whole_vectors` gives as a scratch table of blocks: n, width, kind (a NumPy type),
    top (the largest magnitude), data, and a list for the id and for each column carried."""
    carried = [c for c in whole.columns if c != "v"]
    lists = [T.StructField(f"{c}s", T.ArrayType(whole.schema[c].dataType)) for c in carried]
    schema = T.StructType([*T._parse_datatype_string("n int, width int, kind string, top double, data binary").fields, *lists])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            at = 0
            while at < len(batch):
                widest = max(1, int(np.diff(vectors.slice(at, BLOCK).offsets.to_numpy()).max(initial=1)))
                size = min(BLOCK, max(1, CELLS // widest), len(batch) - at)
                x = _matrix(vectors.slice(at, size), fill)
                low, high = int(x.min(initial=0)), int(x.max(initial=0))
                kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
                row = [pa.array([size], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([np.dtype(kind).name]), pa.array([float(max(-low, high))]), pa.array([x.astype(kind).tobytes(order="F")], pa.binary())]
                for c in carried:
                    values = batch.column(c).slice(at, size)
                    row.append(pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(row, names=[f.name for f in schema.fields])
                at += size
        release()

    return scratch(whole.select("v", *carried).mapInArrow(cut, schema), name)


def matrix(n: int, width: int, kind: str, data: bytes, wide: int, fill: int = 0) -> np.ndarray:
    """A block's vectors as a matrix of int64, padded to the width of the widest block."""
    x = np.frombuffer(data, kind).reshape((n, width), order="F").astype(np.int64)
    return x if width == wide else np.hstack([x, np.full((n, wide - width), fill, np.int64)])


def nearest_long(value: int) -> int:
    """A number of any size as the nearest that fits a long."""
    return max(-LONG - 1, min(LONG, int(value)))
