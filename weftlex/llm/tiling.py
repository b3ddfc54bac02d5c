"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased letter-and-digit
tokens.  Runs of ``min_match`` tokens seed the comparison: Karp-Rabin hashes of
the documents' runs are joined with those of the items.  For each (document,
item) pair that shares enough of them, the longest match of unmarked tokens is
marked, again and again, until none of ``min_match`` tokens is left.  The tiles may stand in any
order, so a passage whose sentences were reordered is still covered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_rows, free_name, lean, small_side, staged

from . import wordhash

#: Bytes of item texts up to which they are broadcast to the pairs.
ITEM_BYTES = 8 << 20
#: The sieve of item seeds has two to the power of this many bits (2 MB).
SIEVE_BITS = 24
#: Tasks over which a key of a benchmark too large to broadcast is split.
SALT = 16
#: Pairs of matching positions of a document and an item that are listed at once.
PAIRS = 1 << 21
#: Letters of scripts that put no space between words (Thai, Lao, Myanmar, Khmer, kana, Han): each is a token by itself.
UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"


def tiles(doc: np.ndarray, item: np.ndarray, at: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the greedy tiling.

    ``doc`` and ``item`` are token hashes; ``at`` the document positions where a
    run of ``min_match`` tokens is one of the item's.
    """
    runs_d, runs_i = wordhash.windows(doc, min_match)[at], wordhash.windows(item, min_match)
    order = np.argsort(runs_i, kind="stable")
    lo, hi = np.searchsorted(runs_i[order], runs_d, "left"), np.searchsorted(runs_i[order], runs_d, "right")
    n = hi - lo
    if n.sum() > PAIRS:
        return _searched_tiles(doc, item, min_match)
    t = np.repeat(at, n)
    p = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else t
    if not len(t):
        return []
    by = np.lexsort((p, t - p))
    p, t = p[by], t[by]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(t) != 1)]))
    length = np.diff(np.concatenate([new, [len(p)]])) + min_match - 1
    heap = [(-int(k), int(a), int(b)) for k, a, b in zip(length, p[new], t[new], strict=True)]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        k, a, b = heapq.heappop(heap)
        k = -k
        taken = in_item[a : a + k] | in_doc[b : b + k]
        if taken.any():  # what is left of it, in pieces
            edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= min_match:
                    heapq.heappush(heap, (s - e, a + s, b + s))
            continue
        in_item[a : a + k] = in_doc[b : b + k] = True
        out.append((a, b, k))
    return out


def _searched_tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """The same tiling where too many pairs of positions match to be listed: memory grows with the texts alone.

    The longest match of unmarked tokens is found by halving its length, with
    Karp-Rabin hashes of all runs of a length; a tile marks at least
    ``min_match`` tokens of the item, which bounds the searches.
    """
    n, m = len(doc), len(item)
    p, q = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, m), base, np.uint64)]), dtype=np.uint64) for base in (wordhash._P, wordhash._PINV))
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mix(x) * p[: len(x)], dtype=np.uint64)]) for x in (doc, item)]
    used, out, most = [np.zeros(n, np.int64), np.zeros(m, np.int64)], [], min(n, m)

    def common(size: int) -> tuple[int, int] | None:
        found = []
        for s, u in zip(sums, used, strict=True):
            count = len(u) - size + 1
            if count < 1:
                return None
            marks = np.concatenate([[0], np.cumsum(u)])
            free = np.flatnonzero(marks[size:] == marks[:count])
            found.append((free, ((s[size:] - s[:count]) * q[:count])[free]))
        (at, left), (pos, right) = found
        hit = np.flatnonzero(np.isin(right, left))
        return (int(pos[hit[0]]), int(at[np.flatnonzero(left == right[hit[0]])[0]])) if len(hit) else None

    while most >= min_match and (best := common(min_match)):
        low, high = min_match, most
        while low < high:
            half = (low + high + 1) // 2
            if found := common(half):
                low, best = half, found
            else:
                high = half - 1
        a, b = best
        used[1][a : a + low] = used[0][b : b + low] = 1
        out.append((a, b, low))
        most = low
    return out


def _seeds(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of ``size`` tokens, apart from those of other sizes."""
    return wordhash.mix(wordhash.windows(hashes, size) + np.uint64(size))


def _item_seeds(min_match: int, percent: int):
    """mapInArrow: (item row, text) to its distinct seeds, at how many places each stands and how many places a covering document must share."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, hashes, bounds in wordhash.words(batch.column(1), wordhash.NON_ALNUM):
                parts = [[np.zeros(0, np.int64)] * 5]
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if b > a:
                        size = min(min_match, b - a)
                        seed, places = np.unique(_seeds(hashes[a:b], size), return_counts=True)
                        # tiles that mark c tokens hold at least c / min_match shared places
                        need = -(-max(1, -(-percent * (b - a) // 100)) // min_match)
                        parts.append([np.full(len(seed), ids[first + i]), seed.view(np.int64), places, np.full(len(seed), need), np.full(len(seed), size)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], names=["item", "seed", "places", "need", "size"])

    return run


def _document_seeds(sieve: np.ndarray, sizes: list[int]):
    """mapInArrow: (row, text) to those of its distinct seeds that pass the sieve."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, hashes, bounds in wordhash.words(batch.column(1), wordhash.NON_ALNUM):
                for size in sizes:
                    seed = _seeds(hashes, size)
                    at = seed >> np.uint64(64 - SIEVE_BITS)
                    hit = np.flatnonzero((sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(bounds, hit, "right") - 1
                    inside = hit + size <= bounds[row + 1]
                    row, seed = row[inside], seed[hit[inside]]
                    by = np.lexsort((seed, row))
                    row, seed = row[by], seed[by]
                    if len(row):
                        new = np.concatenate([[True], (np.diff(row) != 0) | (seed[1:] != seed[:-1])])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first + row[new]], pa.int64()), pa.array(seed[new].view(np.int64), pa.int64())], names=["row", "seed"])

    return run


def _verify(min_match: int, percent: int):
    """mapInArrow: (id, text, item_id, item text) to a row for each pair of which the text covers the item."""

    def tokens(text: str) -> np.ndarray:
        return next(wordhash.words(pa.array([text], pa.large_string()), wordhash.NON_ALNUM))[2]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                if (text := batch.column(1)[i].as_py()) != last:
                    last, doc = text, tokens(text)
                item = tokens(batch.column(3)[i].as_py())
                size = min(min_match, len(item))
                at = np.flatnonzero(np.isin(_seeds(doc, size), _seeds(item, size)))
                found = [(0, int(at[0]), size)] if size < min_match and len(at) else tiles(doc, item, at, min_match) if len(at) else []
                covered = sum(x[2] for x in found)
                if found and 100 * covered >= percent * len(item):
                    out.append((batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), covered, len(item), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["id", "item_id", "covered", "item_tokens", "tiles"])

    return run


def _join(rows: DataFrame, named: DataFrame, on: str, salt: str, small: bool) -> DataFrame:
    """Inner join: ``named`` is broadcast where it is small, else each key is split over SALT tasks by ``salt``."""
    if small:
        return rows.join(F.broadcast(named), on)
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALT)).cast("int")).join(salted, [on, "salt"]).drop("salt")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = 5, percent: int = 50) -> DataFrame:
    """(id_col, item_id, covered, item_tokens, tiles, coverage): a row for each document and item that it covers.

    A document covers an item when tiles of at least ``min_match`` tokens mark
    ``percent`` of the item's tokens or more.  An item of fewer tokens than that
    is covered where all of it stands as one run; one without a token, and a
    null or empty text, cover nothing; letters of unspaced scripts are tokens by
    themselves; two items of equal text give two rows; repeated rows of ``docs``
    give repeated rows; other columns are not read.  Empty tables give no rows.

    Seeds of documents and items are joined.  A sieve of 2 ** SIEVE_BITS bits,
    whatever the benchmark's size, keeps most seeds that no item has out of that
    join; pairs that share too few places to reach ``percent`` go before the
    texts are joined to them.  Rows are named by a hash of id and text there:
    rows of one name only share candidates, since tiles are of the texts.
    """
    lowered = lambda c: F.when(c.rlike(UNSPACED), F.regexp_replace(c, F.lit(UNSPACED), F.lit(" $1 "))).otherwise(c)
    spark, schema = docs.sparkSession, "id long, item_id long, covered long, item_tokens long, tiles long"
    source = arrow_rows(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    source = source.select(F.xxhash64("id", "text").alias("row"), "id", lowered(F.lower("text")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), lowered(F.lower(F.col(item_text).cast("string"))).alias("item_text")).where("item_id IS NOT NULL AND item_text <> ''")
    items = items.select(F.xxhash64("item_id", "item_text").alias("item"), "item_id", "item_text")
    of_items = staged(items.select("item", "item_text").distinct().mapInArrow(_item_seeds(min_match, percent), "item long, seed long, places long, need long, size long"), "item_seeds")
    sizes = sorted(r.size for r in of_items.select("size").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], schema).withColumn("coverage", F.col("covered") / F.col("item_tokens")).withColumnRenamed("id", id_col)
    bit = F.shiftrightunsigned("seed", 64 - SIEVE_BITS)
    words = of_items.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - SIEVE_BITS}) & 63 AS INT))")).alias("bits")).toPandas()
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    seeds = source.select("row", "text").mapInArrow(_document_seeds(sieve, sizes), "row long, seed long")
    shared = _join(seeds, of_items.drop("size"), "seed", "row", of_items.count() <= BROADCAST_ROWS)
    # repeated rows count a place more than once, which only lets more candidates through
    pairs = staged(shared.groupBy("row", "item").agg(F.sum("places").alias("places"), F.max("need").alias("need")).where("places >= need").select("row", "item"), "candidates")
    size = items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0]
    found = _join(source.join(small_side(pairs), "row"), items, "item", "row", size <= ITEM_BYTES).select("id", "text", "item_id", "item_text")
    return found.mapInArrow(_verify(min_match, percent), schema).withColumn("coverage", F.col("covered") / F.col("item_tokens")).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that cover no item; columns unchanged.

    Rows are told apart by a hash of id and text, so that of rows repeated under
    one id, or without an id, each is judged by its own text.
    """
    mark = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    name = free_name(docs, "mark")
    marked = docs.select(mark.alias(name), F.col(text_col).alias("text_of_mark"))
    hit = staged(contaminated(marked, benchmark, name, "text_of_mark", **kw).select(name).distinct(), "contaminated")
    return docs.join(small_side(hit), mark == F.col(name), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
