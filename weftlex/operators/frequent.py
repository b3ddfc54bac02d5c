"""The most frequent n-grams, exact: hash buckets are counted first, then the n-grams of the few buckets that can hold one.

The totals of buckets bound the frequencies of what falls into them (Park, Chen
and Yu), so only n-grams of heavy buckets become strings and are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import scratch_folder

#: Buckets of each order, how many of them travel in one row, characters worked on at a time.
BUCKETS, SLICE, BLOCK = 1 << 20, 1 << 14, 1 << 17
#: Counts that a task holds before it hands them on.
HELD = 100_000
#: Kinds of characters: begins a word, goes on in one, joins two parts of one, white space.
BEGINS, GOES_ON, JOINS, SPACE = 1, 2, 4, 8
_CODES = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _kinds(spark: SparkSession) -> np.ndarray:
    """The kind of every character, as the patterns of functions.text tell it."""
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    flag = lambda test, n: F.when(test, n).otherwise(0)
    kind = flag(c.rlike(r"^[\p{L}\p{N}]$"), BEGINS) + flag(c.rlike(r"^[\p{L}\p{M}\p{N}]$"), GOES_ON) + flag(c.rlike(r"^['’\-\x{2011}]$"), JOINS) + flag(~c.rlike(f"^{T.BOUNDARY}$"), SPACE)
    found = spark.range(_CODES).where("id NOT BETWEEN 55296 AND 57343").select(F.col("id").cast("int").alias("id"), kind.cast("byte").alias("kind")).where("kind > 0").toArrow()
    out = np.zeros(_CODES, np.uint8)
    out[found["id"].to_numpy()] = found["kind"].to_numpy()
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """Texts in blocks, a character that bounds segments between them; a long text is cut at a full stop, which does too."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            text, low = (value.as_py() or b"").decode("utf-8", "replace"), 0
            while len(text) - low > BLOCK:
                at = text.rfind(".", low, low + BLOCK) + 1 or text.find(".", low + BLOCK) + 1 or len(text)
                yield text[low:at]
                low = at
            held.append(text[low:])
            size += len(text) - low + 1
            if size >= BLOCK:
                yield "\x01".join(held)
                held, size = [], 0
    if held:
        yield "\x01".join(held)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Words of a block of text and where n of them follow each other inside a segment."""

    def __init__(self, kinds: np.ndarray):
        self.kinds, self.powers, self.inverse = kinds, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def read(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kinds[codes]
        begins, word = (kind & BEGINS) != 0, (kind & GOES_ON) != 0
        word[1:-1] |= ((kind[1:-1] & JOINS) != 0) & ((kind[:-2] & GOES_ON) != 0) & begins[2:]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        bounds = ~word & ((kind & SPACE) == 0)
        late = np.flatnonzero(~begins[start])
        if len(late):  # marks that follow no word bound a segment; the word begins behind them
            bounds[start[late]] = True
            ahead = np.append(np.flatnonzero(begins), len(codes))
            start = start.copy()
            start[late] = ahead[np.searchsorted(ahead, start[late])]
            start, end = start[start < end], end[start < end]
        if len(codes) > len(self.powers):
            self.powers, self.inverse = _powers(len(codes), _BASE), _powers(len(codes), np.uint64(pow(int(_BASE), -1, 1 << 64)))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.powers[: len(codes)], out=sums[1:])
        self.text, self.start, self.end = text, start, end
        self.hash = self._mixed((sums[end] - sums[start]) * self.inverse[start])
        passed = np.cumsum(bounds)
        self.near = passed[start[1:]] == passed[start[:-1]] if len(start) else np.empty(0, bool)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, bucket) of each n-gram."""
        m = max(len(self.start) - n + 1, 0)
        whole, h = np.ones(m, bool), self.hash[:m]
        for k in range(1, n):
            whole &= self.near[k - 1 : k - 1 + m]
            h = self._mixed(h * np.uint64(3) + self.hash[k : k + m])
        at = np.flatnonzero(whole)
        return at, (h[at] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)

    def strings(self, n: int, at: np.ndarray) -> list[str]:
        """The n-grams that begin at these words."""
        starts, ends = ([x[at + k].tolist() for k in range(n)] for x in (self.start, self.end))
        words = ([self.text[a:b] for a, b in zip(s, e)] for s, e in zip(starts, ends))
        return list(map(" ".join, zip(*words)))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("binary").alias("text"))


def bucket_totals(docs: DataFrame, orders: list[int], text: str = "text") -> dict[int, np.ndarray]:
    """The number of n-grams in each of ``BUCKETS`` hash buckets, for each order; of one size whatever the input."""
    kinds = _kinds(docs.sparkSession)

    def told(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for n, total in totals.items():
            for k in range(0, BUCKETS, SLICE):
                if len(at := np.flatnonzero(total[k : k + SLICE])):
                    row = [[n], [k // SLICE], [at.astype(np.uint16).tobytes()], [total[k : k + SLICE][at].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["n", "slice", "at", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, totals = Runs(kinds), {n: np.zeros(BUCKETS, np.int64) for n in orders}
        for block in _blocks(batches):
            runs.read(block)
            for n in orders:
                np.add.at(totals[n], runs.ngrams(n)[1], 1)
        yield from told(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for n, k, at, counts in zip(*(c.to_pylist() for c in batch.columns)):
                totals.setdefault((n, k), np.zeros(SLICE, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int64)
        for (n, k), total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["n", "slice", "total"])

    parts = _texts(docs, text).mapInArrow(count, "n int, slice int, at binary, counts binary")
    sums = {n: np.zeros(BUCKETS, np.int64) for n in orders}
    for r in parts.repartition("n", "slice").mapInArrow(add, "n int, slice int, total binary").collect():
        sums[r["n"]][r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["total"], np.int64)
    return sums


def counts_in(docs: DataFrame, alive: dict[int, np.ndarray], text: str = "text") -> DataFrame:
    """(n, text, frequency): exact counts of the n-grams whose buckets are ``alive``, a flag for each bucket of each order."""
    kinds, bits = _kinds(docs.sparkSession), {n: np.packbits(x) for n, x in alive.items()}

    def rows(n: int, found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["n", "text", "frequency"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = Runs(kinds), {n: Counter() for n in bits}
        flags = {n: np.unpackbits(x).astype(bool) for n, x in bits.items()}
        for block in _blocks(batches):
            runs.read(block)
            for n, found in held.items():
                at, bucket = runs.ngrams(n)
                found.update(runs.strings(n, at[flags[n][bucket]]))
                if len(found) >= HELD:
                    yield rows(n, found)
                    found.clear()
        for n, found in held.items():
            yield rows(n, found)

    return _texts(docs, text).mapInArrow(count, "n int, text string, frequency long").groupBy("n", "text").agg(F.sum("frequency").alias("frequency"))


def _guess(totals: np.ndarray, k: int) -> int:
    """A frequency that the k-th n-gram may be expected to reach: the k-th bucket's total without what a bucket holds anyhow."""
    return max(1, int(0.9 * (np.partition(totals, -k)[-k] - 2 * np.median(totals)))) if k < len(totals) else 1


def top_counts(docs: DataFrame, take: dict[int, int], text: str = "text") -> DataFrame:
    """(n, text, frequency) of n-grams within segments, case kept, ``take`` most frequent of each order n at least, counted exactly.

    An n-gram left out is in a bucket whose total is below ``least``, so it is
    rarer than the last one wanted if that one reaches ``least``.  If it does
    not, its frequency is the next bound, and the pass is made again.
    """
    spark, kept = docs.sparkSession, []
    totals = bucket_totals(docs, list(take), text)
    least = {n: _guess(totals[n], k) for n, k in take.items()}
    while least:
        path = scratch_folder(spark, "frequent")
        counts_in(docs, {n: totals[n] >= x for n, x in least.items()}, text).write.parquet(path)
        found, again = spark.read.schema("n int, text string, frequency long").parquet(path), {}
        for n, x in least.items():
            own = found.where(F.col("n") == n)
            last = own.orderBy(F.desc("frequency")).limit(take[n]).agg(F.count("*").alias("rows"), F.min("frequency").alias("least")).first()
            if last["rows"] < take[n] and x > 1:
                again[n] = x // 8 or 1
            elif last["rows"] == take[n] and last["least"] < x:
                again[n] = last["least"]
            else:
                kept.append(own)
        least = again
    out = kept[0]
    for own in kept[1:]:
        out = out.unionByName(own)
    return out
