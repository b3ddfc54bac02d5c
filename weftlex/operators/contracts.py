"""Contracts: key readers and inventories with their checks, fingerprints, selectors, batch statistics."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..sources.files import file_hashes, fingerprint
from .dictionary import contiguous


def checked_keys(keys: DataFrame, order: int, number: str = "row_index") -> DataFrame:
    """Keys of one order, raising unless every row is of that order and the row numbers are dense from 0."""
    ok = contiguous(keys, number).first()
    wrong = keys.where((F.col("n") != order) | F.col("n").isNull()).limit(1).count()
    if wrong or not ok.contiguous:
        raise ValueError(f"keys of order {order} with dense {number} are expected")
    return keys


def dictionary_records(senses: DataFrame, words: DataFrame) -> DataFrame:
    """Senses with their word's surface and normal form, by word_id."""
    return senses.drop("surface", "normalized").join(words.select("word_id", "surface", "normalized"), "word_id")


def validate_dictionary(words: DataFrame, senses: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, violations) of the constraints that the tables promise."""
    rules = {
        "word_id is unique": words.groupBy("word_id").count().where("count > 1"),
        "normalized is unique": words.groupBy("normalized").count().where("count > 1"),
        "sense_row is unique": senses.groupBy("sense_row").count().where("count > 1"),
        "senses have words": senses.join(words, "word_id", "left_anti"),
        "edges have senses": edges.join(senses, "sense_row", "left_anti"),
        "edges have words": edges.join(words.select(F.col("word_id").alias("definition_word_id")), "definition_word_id", "left_anti"),
        "edge positions are unique": edges.groupBy("sense_row", "position").count().where("count > 1"),
    }
    out = None
    for rule, bad in rules.items():
        part = bad.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


def write_dictionary(words: DataFrame, senses: DataFrame, edges: DataFrame, path: str) -> None:
    """The three tables, once their constraints hold."""
    broken = validate_dictionary(words, senses, edges).where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
    for name, df in (("words", words), ("senses", senses), ("definition_word_edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_inventory(words: DataFrame, senses: DataFrame, path: str) -> None:
    """words and senses as JSON lines in order of their numbers."""
    for name, df, key in (("words", words, "word_id"), ("senses", senses, "sense_row")):
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(f"{path}/{name}")


def write_index(addresses: DataFrame, name: str, key: list[str], buckets: int = 64) -> None:
    """An address table bucketed and sorted by its lookup key, so that look-ups by it do not shuffle it."""
    addresses.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).format("parquet").saveAsTable(name)


def anchor_pairs(left: DataFrame, right: DataFrame, key: str, v: str) -> DataFrame:
    """(key, a, b) of both sources' vectors; a missing side or another width raises when it is read."""
    a, b = left.select(key, F.col(v).alias("a")), right.select(key, F.col(v).alias("b"))
    both = a.join(b, key, "full")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.size("a") == F.size("b"))
    checked = F.when(ok, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("no matching anchor: "), F.col(key).cast("string"))).cast(both.schema["a"].dataType))
    return both.withColumn("a", checked)


def tuple_hash(key: Column, person: bytes = b"") -> Column:
    """16-byte BLAKE2b of a packed tuple under a personalisation string, for stores that hold that digest."""
    return H._blake(person)(key)


def word_tuple_key(words: Column) -> Column:
    """Storage form of a word tuple: compact JSON in UTF-8; an empty tuple or word raises."""
    ok = (F.size(words) > 0) & ~F.exists(words, lambda w: w == "")
    return F.encode(F.when(ok, F.to_json(words)).otherwise(F.raise_error(F.lit("word tuple cannot be empty")).cast("string")), "UTF-8")


def projection_fingerprint(projection: DataFrame, algorithm: str) -> str:
    """SHA-256 of the algorithm's name, a zero byte and the canonical ids as little-endian 32-bit numbers.

    A projection has one row for each token of a vocabulary, which bounds it.
    """
    ids = [r[0] for r in projection.orderBy("raw_token_id").select("canonical_token_id").collect()]
    return hashlib.sha256(algorithm.encode() + b"\0" + struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def vocabulary_fingerprint(pieces: Mapping[str, int], name: str, special: Iterable[int] = ()) -> str:
    """Fingerprint of a vocabulary: its pieces by id, and its special ids."""
    return fingerprint({"name": name, "vocabulary": sorted(([p, int(i)] for p, i in pieces.items()), key=lambda x: (x[1], x[0])), "special_ids": sorted(map(int, special))})


def tokenizer_contract(identity: Mapping[str, object], encode: Callable[[str], list[int]], samples: Iterable[str], files: DataFrame | None = None) -> dict:
    """What a tokenizer must keep to: identity, how samples encode at the start and after a space, and its files' hashes."""
    base: dict = dict(identity) | {"add_special_tokens": False, "samples": {s: {"bos": encode(s), "internal": encode(" " + s)} for s in samples}}
    if files is not None:
        base["files"] = [[r.name, r.length, r.sha256] for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256").orderBy("name").collect()]
    return base | {"fingerprint": fingerprint(base)}


def validate_contract(spark, contract: Mapping[str, object], folder: str | None = None) -> None:
    """Raise where a contract is not what its fingerprint says, asks for special tokens, or its files differ."""
    base = {k: v for k, v in contract.items() if k != "fingerprint"}
    if fingerprint(base) != contract.get("fingerprint"):
        raise ValueError("contract fingerprint mismatch")
    if base.get("add_special_tokens", True):
        raise ValueError("addresses need add_special_tokens off")
    if folder is not None:
        want = {tuple(x) for x in base.get("files", [])}
        have = {(r.path.rsplit("/", 1)[-1], r.length, r.sha256) for r in file_hashes(spark, folder).collect()}
        if missing := want - have:
            raise ValueError(f"files differ from the contract: {sorted(x[0] for x in missing)}")


def hash_contract(orders: tuple[int, ...] = H.HASH_ORDERS, heads: int = H.HASH_HEADS, rows: Mapping[int, int] = H.TABLE_ROWS) -> dict:
    """The settings of the hash fallback, as kept in manifests."""
    return {"orders": list(orders), "heads": heads, "table_rows": {str(n): rows[n] for n in orders}, "hash": {"modulus": H.MODULUS, "multiplier": H.MULTIPLIER}, "activation": "phrase miss"}


def sequence_number(name: Column) -> Column:
    """The six-digit number at the end of a shard's file name; null if there is none."""
    return F.nullif(F.regexp_extract(name, r"_(\d{6})\.(?:parquet|bin)$", 1), F.lit("")).cast("int")


def uncommitted(shards: DataFrame, committed: DataFrame, name: str = "name") -> DataFrame:
    """Shards newer than their source's committed number: what a restart removes before it goes on."""
    numbered = shards.withColumn("sequence", sequence_number(F.col(name)))
    return numbered.join(committed, "source").where(F.col("sequence") > F.col("committed"))


def layer_of(key: Column) -> Column:
    """Layer number in a parameter's key; null if there is none."""
    return F.nullif(F.regexp_extract(key, r"(?:^|\.)layers?\.(\d+)(?:\.|$)", 1), F.lit("")).cast("int")


def selected_layers(choice: str, layer: Column) -> Column:
    """Whether a layer is in 'all' or in a list of numbers and ranges such as '0,4-7'."""
    if choice.strip().lower() == "all":
        return layer.isNotNull()
    out = F.lit(False)
    for part in filter(None, (p.strip() for p in choice.split(","))):
        low, _, high = part.partition("-")
        out = out | layer.between(int(low), int(high or low))
    return out


def has_module(key: Column, module: str) -> Column:
    """Whether a key names the module as one of its parts."""
    return F.array_contains(F.split(key, r"\."), module)


def length_statistics(rows: DataFrame, by: str, length: str) -> DataFrame:
    """Least, largest and mean length by group."""
    return rows.groupBy(by).agg(F.min(length).alias("minimum"), F.max(length).alias("maximum"), F.avg(length).alias("mean"))


def by_length(rows: DataFrame, length: str, ordinal: str) -> DataFrame:
    """Rows in order of length, then as they came."""
    return rows.orderBy(length, ordinal)


#: What settings must satisfy, by the name of the rule; a row of settings breaks those whose predicate is not true.
RULES: dict[str, str] = {f"{c} is positive": f"{c} >= 1" for c in "vocabulary width memory_width length rounds window nearest skills skill_rank skill_top experts expert_width branches expert_top heads chunk".split()} | {
    "directions are not negative": "directions >= 0",
    "directions need a top": "directions = 0 OR direction_top >= 1",
    "skills hold their top": "skill_top <= skills",
    "experts hold their top": "expert_top <= experts",
    "the window fits the length": "window <= length",
    "the nearest fit the window": "nearest <= window",
    "the exponent is positive": "exponent > 0",
    "the width holds whole routes": "width % bits = 0",
    "every order has a table": "size(orders) = size(table_rows)",
    "orders are positive": "NOT exists(orders, x -> x < 1)",
    "tables have rows": "NOT exists(table_rows, x -> x < 1)",
    "memory has a quarter": "abs(memory_fraction - 0.25) <= 1e-12",
    "the loop exponent is known": "loop_exponent IN (0.25, 0.5)",
}


def broken_rules(settings: DataFrame, key: str) -> DataFrame:
    """(key, rule) of each rule that a row of settings breaks; a null setting breaks what it is part of."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(f"({test})"), F.lit(False)), F.lit(rule)) for rule, test in RULES.items())))
    return settings.select(key, F.explode(found).alias("rule"))


@dataclass(frozen=True)
class Settings:
    """Shapes of the memory and routing layers; impossible ones raise."""

    width: int = 64
    memory_width: int = 64
    bits_per_route: int = 4
    latent_orders: tuple[int, ...] = (2, 3)
    hash_orders: tuple[int, ...] = H.HASH_ORDERS
    hash_rows: tuple[int, ...] = field(default_factory=lambda: tuple(H.TABLE_ROWS.values()))
    hash_heads: int = H.HASH_HEADS
    window: int = 8
    nearest: int = 4
    exponent: float = 2.0
    rounds: int = 2
    loop_exponent: float = 0.25

    def __post_init__(self) -> None:
        if min(self.width, self.memory_width, self.bits_per_route, self.hash_heads, self.window, self.nearest, self.rounds) < 1:
            raise ValueError("sizes must be positive")
        if self.width % self.bits_per_route:
            raise ValueError("the width must hold whole routes")
        if len(self.hash_orders) != len(self.hash_rows) or min((*self.hash_orders, *self.latent_orders)) < 1:
            raise ValueError("every order needs a table")
        if self.nearest > self.window or self.exponent <= 0 or self.loop_exponent not in (0.25, 0.5):
            raise ValueError("impossible geometry")

    @classmethod
    def of(cls, values: Mapping[str, object]) -> Settings:
        """From a mapping, passing over names that are not settings."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})
