"""Discrete latent n-grams: sign bits to symbols, symbols to table addresses over causal windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H


def symbols(v: Column, bits: int) -> Column:
    """One symbol for each run of ``bits`` coordinates: its positive signs, packed."""
    routes = F.sequence(F.lit(0), (F.size(v) / bits).cast("int") - 1)
    return F.transform(routes, lambda r: H.pack_bits(F.transform(F.slice(v, r * bits + 1, F.lit(bits)), lambda x: (x > 0).cast("int"))))


def symbol_rows(states: DataFrame, seq: str, t: str, v: str, bits: int) -> DataFrame:
    """(seq, t, route, symbol)."""
    return states.select(seq, t, F.posexplode(symbols(F.col(v), bits)).alias("route", "symbol"))


def addresses(states: DataFrame, seq: str, t: str, v: str, bits: int, order: int) -> DataFrame:
    """(seq, t, route, address) of the ``order`` latest symbols; null before there are as many.

    One window over whole states carries all routes, which is a sort of T rows
    in place of T times the routes.
    """
    w = Window.partitionBy(seq).orderBy(t)
    df = states.select(seq, t, symbols(F.col(v), bits).alias("s"))
    for k in range(order):
        df = df.withColumn(f"s{k}", F.lag("s", order - 1 - k).over(w))
    out = df.select(seq, t, F.posexplode(F.transform("s", lambda x, r: F.struct(r.alias("route"), F.array(*(F.get(f"s{k}", r) for k in range(order))).alias("window")))).alias("_r", "a"))
    full = ~F.exists("a.window", lambda x: x.isNull())
    return out.select(seq, t, F.col("a.route").alias("route"), F.when(full, H.latent_address(F.col("a.route"), F.col("a.window"), 1 << bits)).alias("address"))


def forced(computed: DataFrame, overrides: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Computed addresses with non-negative overrides in their place; one past the table raises."""
    out = computed.join(overrides.select(*keys, F.col("address").alias("_f")), keys, "left")
    ok = F.when(F.col("_f") >= rows, F.raise_error(F.lit("forced address exceeds the table")).cast("long")).when(F.col("_f") >= 0, F.col("_f"))
    return out.select(*keys, F.coalesce(ok, F.col("address")).alias("address"))


def gathered(found: DataFrame, table: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of ``table(address, values)`` for each address; a null or unknown one gives zeros."""
    return found.join(table, "address", "left").select(*keys, "address", F.coalesce("values", F.array_repeat(F.lit(0.0), width)).alias("values"))


def causal_convolution(states: DataFrame, seq: str, t: str, v: str, kernel: list[float], bias: float = 0.0) -> DataFrame:
    """Adds ``conv``: for each coordinate the kernel over the latest states, the last weight on the current one."""
    w = Window.partitionBy(seq).orderBy(t).rowsBetween(-(len(kernel) - 1), 0)
    df = states.withColumn("_w", F.collect_list(v).over(w))
    weights = F.slice(F.array(*map(F.lit, kernel)), F.lit(len(kernel) + 1) - F.size("_w"), F.size("_w"))
    terms = F.zip_with("_w", weights, lambda x, k: F.transform(x, lambda y: y * k))
    start = F.transform(F.col(v), lambda _: F.lit(float(bias)))
    return df.withColumn("conv", F.aggregate(terms, start, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))).drop("_w")
