"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts are a group and stay together.  So that the packer's input has a
fixed bound, groups are first summed into BUCKETS hash buckets; a group larger
than half a shard is split by a hash of its rows' places, so also where ids repeat, into chunks of
about a quarter of a shard, each measured exactly.  Buckets and chunks are then placed, the
largest first, where the dot product of their vector with a shard's residual
capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Hash buckets that are packed: the bound of what the driver holds and broadcasts.
BUCKETS = 1 << 16
#: Share of a shard beyond which a group is split, and the share that a chunk has.
SPLIT_AT, CHUNK = 1 / 2, 1 / 4
#: Rows that share one numbering partition of a shard.
SLOT_ROWS = 500_000
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (2.0, 1.0, 1.0)


def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item: by the largest weighted dot product with residual capacity among those it fits.

    An item that fits nowhere goes where most room for its first dimension is
    left.  Ties go to the lowest shard; items of equal size keep their order.
    """
    total = vectors.sum(axis=0)
    v = vectors / np.where(total > 0, total / shards, 1.0)
    w = v * np.array(weights)
    room = np.ones((shards, v.shape[1]))
    out = np.zeros(len(v), np.int32)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        score = room @ w[i]
        fits = (room >= v[i]).all(axis=1)
        k = int(np.where(fits, score, -np.inf).argmax()) if fits.any() else int(room[:, 0].argmax())
        room[k] -= v[i]
        out[i] = k
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, n_tokens) for each row.

    ``size`` is the UTF-8 bytes of the text plus 16; a null text counts as empty
    and groups with empty ones.  ``law`` is 'bytes': sizes near equal.  ``slot``
    numbers the rows of a shard from 0 without gaps; ``grown_shard`` is null.
    Repeated ids and rows are rows like any other; other columns are not read;
    an empty table gives no rows.  One text longer than a shard's share takes a
    shard of its own, which no split can mend.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),  # written once with the sizes: rows equal in all else are dealt by it
    ).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    rows = staged(rows, "sizes")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]

    per = rows.groupBy("bucket").agg(*sums).toPandas().sort_values("bucket")
    items = np.zeros((BUCKETS, 3))
    items[per["bucket"].to_numpy()] = per[["b", "t", "r"]].to_numpy()
    total = np.maximum(items.sum(axis=0), 1.0)
    large = SPLIT_AT * total / shards
    suspects = np.flatnonzero((items > large).any(axis=1) & (items[:, 2] > 1))
    # at most 3 * shards / SPLIT_AT buckets and groups can be this large
    groups = []
    if len(suspects):
        over = " OR ".join(f"{c} > {x!r}" for c, x in zip("btr", map(float, large), strict=True))
        groups = rows.where(F.col("bucket").isin(suspects.tolist())).groupBy("bucket", "h").agg(*sums).where(f"r > 1 AND ({over})").orderBy("h").collect()
    base, heavy, vectors = BUCKETS, [], [items]
    for g in groups:
        own = np.array([g.b, g.t, g.r], float)
        chunks = int(np.ceil((own / (CHUNK * total / shards)).max()))
        items[g.bucket] -= own
        heavy.append((g.h, base, chunks))
        base += chunks
    item = F.col("bucket")
    if heavy:
        hot = F.broadcast(spark.createDataFrame(heavy, "h long, base int, chunks int"))
        rows = rows.join(hot, "h", "left")
        item = F.coalesce(F.col("base") + F.pmod("salt", F.col("chunks").cast("long")).cast("int"), "bucket")
        rows = rows.withColumn("item", item)
        found = rows.where("base IS NOT NULL").groupBy("item").agg(*sums).toPandas()
        extra = np.zeros((base - BUCKETS, 3))
        extra[found["item"].to_numpy() - BUCKETS] = found[["b", "t", "r"]].to_numpy()
        vectors.append(extra)
    else:
        rows = rows.withColumn("item", item)
    every = np.concatenate(vectors)
    used = np.flatnonzero(every[:, 2] > 0)
    placed = pack(every[used], shards)
    where = F.broadcast(spark.createDataFrame([(int(a), int(b)) for a, b in zip(used, placed, strict=True)], "item int, shard int"))
    subs = max(8, int(np.ceil(total[2] / shards / SLOT_ROWS)))
    rows = staged(rows.join(where, "item").select("id", "size", "tokens", "crc", "shard", F.pmod(F.xxhash64("salt"), F.lit(subs)).cast("int").alias("sub")), "placed")

    counts = rows.groupBy("shard", "sub").count().orderBy("shard", "sub").collect()
    starts, at = [], {}
    for c in counts:
        starts.append((c["shard"], c["sub"], at.get(c["shard"], 0)))
        at[c["shard"]] = at.get(c["shard"], 0) + c["count"]
    first = F.broadcast(spark.createDataFrame(starts, "shard int, sub int, first long"))
    order = Window.partitionBy("shard", "sub").orderBy("id", "crc", "size")
    return (
        rows.join(first, ["shard", "sub"])
        .withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("tokens").alias("n_tokens"))
    )
