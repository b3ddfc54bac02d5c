"""Deterministic addresses: polynomial n-gram hashes, packed bits, digests."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The bounded polynomial hash and its default table sizes.
MODULUS, MULTIPLIER = 2_147_483_647, 1_000_003
SEED_BASE, SEED_ORDER, SEED_HEAD, POSITION_STEP = 1_000_033, 10_007, 1_000_037, 97
HASH_ORDERS, HASH_HEADS = (2, 3), 4
TABLE_ROWS = {2: 1_048_576, 3: 4_194_304}


def hash_ids(ids: Column, order: int, head: Column | int, rows: int) -> Column:
    """Table row of ``order`` token ids under one head.  BIGINT never overflows: the state stays below 2**31."""
    head = F.lit(head) if isinstance(head, int) else head
    seed = (F.lit(SEED_BASE + order * SEED_ORDER).cast("long") + head.cast("long") * SEED_HEAD) % MODULUS
    steps = F.transform(ids, lambda x, i: x.cast("long") + (i.cast("long") + 1) * POSITION_STEP)
    return F.aggregate(steps, seed, lambda acc, x: (acc * F.lit(MULTIPLIER).cast("long") + x) % MODULUS) % F.lit(rows).cast("long")


def hash_addresses(ids: Column, order: int, heads: int = HASH_HEADS, rows: int | None = None) -> Column:
    """One row per head for the ids; null if there are fewer than ``order``."""
    size = rows or TABLE_ROWS[order]
    return F.when(F.size(ids) == order, F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: hash_ids(ids, order, h, size)))


def pack_bits(bits: Column) -> Column:
    """Sum of bit j times 2**j."""
    return F.aggregate(F.transform(bits, lambda b, j: b.cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), j)), F.lit(0).cast("long"), lambda acc, x: acc + x)


def latent_address(route: Column, symbols: Column, alphabet: int) -> Column:
    """route * K**n + sum of symbol j times K**j, the oldest symbol first; null if a symbol is."""
    power = lambda j: F.aggregate(F.array_repeat(F.lit(alphabet).cast("long"), j), F.lit(1).cast("long"), lambda acc, x: acc * x)
    total = F.aggregate(F.transform(symbols, lambda s, j: s.cast("long") * power(j)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return route.cast("long") * power(F.size(symbols)) + total


def table_rows(routes: int, alphabet: int, order: int) -> int:
    return routes * alphabet**order


def _blake(person: bytes):
    @F.pandas_udf(BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.blake2b(x.encode() if isinstance(x, str) else bytes(x), digest_size=16, person=person).digest(), na_action="ignore")

    return run


#: 16-byte BLAKE2b digest of a text's UTF-8, where that exact key is stored; elsewhere sha2 keeps to the JVM.
document_digest = _blake(b"")


def tuple_key(ids: Column) -> Column:
    """Storage form of an id tuple: little-endian 32-bit count, then the ids."""
    hex32 = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    swap = lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    return F.unhex(F.concat(swap(hex32(F.size(ids))), F.array_join(F.transform(ids, lambda x: swap(hex32(x))), "")))


def tuple_ids(key: Column) -> Column:
    """The ids of a tuple's storage form; a key whose length is not what its count says raises."""
    h = F.hex(key)
    number = lambda at: F.conv(F.concat(*(F.substring(h, at + k, F.lit(2)) for k in (6, 4, 2, 0))), 16, 10).cast("long")
    count = number(F.lit(1))
    ok = (F.octet_length(key) >= 4) & (F.octet_length(key) == 4 * (count + 1))
    ids = F.transform(F.sequence(F.lit(1).cast("long"), count), lambda i: number((8 * i + 1).cast("int")))
    return F.when(ok, F.when(count > 0, ids).otherwise(F.array().cast("array<bigint>"))).otherwise(F.raise_error(F.lit("not the key of an id tuple")).cast("array<bigint>"))


def shard_of(row: Column, size: int) -> Column:
    """(shard_index, local_row) of a dense row number."""
    return F.struct(F.floor(row / size).cast("long").alias("shard_index"), (row % size).cast("long").alias("local_row"))
