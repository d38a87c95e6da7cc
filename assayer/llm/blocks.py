"""Vectors as whole numbers, exactly, in blocks of rows; tables whose files are dealt by block, so that joins on it move nothing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assayer.llm import common

#: Vectors in a block; a component times 1,024 must stay below this, so that sums of a block fit a long.
BLOCK, LARGEST = 4096, 1 << 50
_LONG = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x).  The product of a double and a power of two is exact."""
    with np.errstate(over="ignore"):
        f = np.floor(x * 1024.0)
    if f.size and np.abs(f).max() >= LARGEST:
        raise ValueError("a component is 2**40 or more in size")
    return f.astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all: 2, 4 or 8 each, the first byte says which."""
    top = int(np.abs(x).max()) if x.size else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(data: bytes, columns: int) -> np.ndarray:
    x = np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64)
    return x.reshape(-1, columns) if columns else x.reshape(0, 0)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The same numbers as doubles, where squared distances between their rows are exact so, else as Python's integers."""
    top = max([int(np.abs(a).max()) for a in arrays if a.size] or [0])
    fits = 4 * max(1, arrays[0].shape[-1]) * top * top < 1 << 53
    return [a.astype(np.float64) if fits else a.astype(object) for a in arrays]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c; both from ``exact``."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def as_long(d: np.ndarray) -> list[int | None]:
    """Null for what a long can't hold."""
    return [v if v <= _LONG else None for v in map(int, d.tolist())]


def block_rows(it, first: int):
    """Record batches in pieces of BLOCK rows: number of the block, the piece.  Numbers follow from the partition and the
    order of its rows, so a task that runs again gives the same."""
    at, held = first << 32, []
    for b in it:
        held.append(b)
        while sum(x.num_rows for x in held) >= BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            yield at, table.slice(0, BLOCK)
            at, held = at + 1, table.slice(BLOCK).to_batches()
    if sum(x.num_rows for x in held):
        yield at, pa.Table.from_batches(held).combine_chunks()


def partition_number() -> int:
    return TaskContext.get().partitionId()


def matrix(column) -> np.ndarray:
    """A column of lists of equal length as doubles."""
    column = column.combine_chunks()
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return flat.reshape(len(column), -1) if len(column) and len(flat) else np.zeros((len(column), 0))


class Dealt:
    """Tables in the shared folder whose files are dealt by a column: joins of two of them on it exchange nothing."""

    def __init__(self, spark, key: str, n: int):
        self.spark, self.key, self.n, self.names = spark, key, n, []

    def save(self, df: DataFrame, name: str, dealt: bool = True) -> DataFrame:
        """``dealt``: whether the rows stand as they are to be dealt already."""
        table = f"assayer_{uuid.uuid4().hex}"
        df = df if dealt else df.repartition(self.n, self.key)
        df.write.format("parquet").option("compression", "zstd").option("path", common.shared_path(self.spark, name)).bucketBy(self.n, self.key).sortBy(self.key).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def forget(self) -> None:
        """Take the names out of the catalog; files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
