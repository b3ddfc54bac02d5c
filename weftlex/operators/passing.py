"""Stored vectors that pass each task's own rows in chunks: no pairs of rows are shuffled, no task holds all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.scratch import scratch_folder
from ..sources.store import located

#: Stored rows that pass at a time, and own rows that meet them in one matrix product.
CHUNK, OWN = 4096, 1024
#: Near pairs measured at a time.
PAIRS = 1 << 16


def stored(vectors: DataFrame, name: str) -> str:
    """Write ``vectors`` once to the shared folder; returns the path for chunks()."""
    path = scratch_folder(vectors.sparkSession, name)
    vectors.write.parquet(path)
    return path


def chunks(path: str, columns: list[str], rows: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """The columns of what stored() has written, ``rows`` rows at a time; called inside a task."""
    from pyarrow import fs, parquet

    system, at = located(path)
    for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")):
        with system.open_input_file(name) as source:
            for batch in parquet.ParquetFile(source).iter_batches(rows, columns=columns):
                if batch.num_rows:
                    yield [matrix(batch.column(c)) for c in columns]


def matrix(column: pa.Array) -> np.ndarray:
    """Numbers as they are, arrays of numbers as the rows of a matrix."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def dealt(rows: DataFrame) -> DataFrame:
    """A row meets all stored vectors: as many tasks as there are partitions, however few bytes the rows have."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def unit(m: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """Rows of unit length as vectors.l2_normalize() makes them, sums in array order."""
    return m / np.maximum(np.sqrt(products(m, m)), floor)[:, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows, summed in array order."""
    out = np.zeros(len(a))
    for c in range(a.shape[1]):
        out += a[:, c] * b[:, c]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows, summed in array order."""
    out = np.zeros(len(a))
    for c in range(a.shape[1]):
        x = a[:, c] - b[:, c]
        out += x * x
    return out


def all_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows by a matrix product; those of near pairs, where it cancels, in array order."""
    sizes = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    out = sizes - 2 * (a @ b.T)
    i, j = np.nonzero(out < 1e-3 * sizes)
    for k in range(0, len(i), PAIRS):
        x, y = i[k : k + PAIRS], j[k : k + PAIRS]
        out[x, y] = distances(a[x], b[y])
    return np.maximum(out, 0, out=out)


class Least:
    """The k rows of least (key, tie) for each of n own rows, from candidates given chunk by chunk.

    A matrix product tells keys within rounding; ``wanted`` gives the pairs that
    may be among the k, ``add`` takes their keys measured in array order.
    """

    def __init__(self, n: int, k: int):
        self.k, self.edge = k, np.full(n, np.inf)
        self.own, self.key, self.tie, self.value = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0)

    def wanted(self, near: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (own row, column) of rough keys ``near`` that are no further than the k-th so far, or of the chunk."""
        edge = self.edge
        if near.shape[1] > self.k and np.isinf(edge).any():
            edge = np.minimum(edge, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + slack)
        bound = (edge + slack).astype(near.dtype)
        if near.dtype != edge.dtype:
            bound = np.nextafter(bound, np.array(np.inf, near.dtype))
        hit = near <= bound[:, None]
        if np.isinf(bound).any():
            hit &= near < np.inf
        return np.divmod(np.flatnonzero(hit), near.shape[1])  # far faster than nonzero() of two dimensions

    def add(self, own: np.ndarray, key: np.ndarray, tie: np.ndarray, value: np.ndarray) -> None:
        if not len(own):
            return
        own, key, tie, value = (np.concatenate(x) for x in ((self.own, own), (self.key, key), (self.tie, tie), (self.value, value)))
        order = np.lexsort((tie, key, own))
        place = self._places(own[order])
        order, place = order[place < self.k], place[place < self.k]
        self.own, self.key, self.tie, self.value = own[order], key[order], tie[order], value[order]
        last = place == self.k - 1
        self.edge[self.own[last]] = self.key[last]

    @staticmethod
    def _places(own: np.ndarray) -> np.ndarray:
        return np.arange(len(own)) - np.searchsorted(own, own)

    def places(self) -> np.ndarray:
        """Place among the k, from 0, of each row held."""
        return self._places(self.own)
