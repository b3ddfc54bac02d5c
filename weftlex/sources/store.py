"""Fixed-width record shards: written whole or not at all, checked when opened, read by row number.

Shard ``k`` holds records ``k * shard_rows`` and on, each of ``width`` bytes,
with nothing between them.  Beside the shards lies a table of their digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Shards that a task keeps open: a fixed value.
CACHED_SHARDS = 2
#: Rows of one output batch.
BATCH_ROWS = 1_000
#: Shard digests that are broadcast; beyond it they are joined by shuffle.
BROADCAST_SHARDS = 200_000
MANIFEST = "shard_index bigint, name string, records bigint, width int, shard_rows bigint, sha256 string"

Loader = Callable[[str], bytes]


def located(path: str):
    """(file system, path in it) of a path or URI; a bare path is local."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def load_bytes(path: str) -> bytes:
    """The bytes of one file of any file system that Arrow knows: the default loader."""
    system, at = located(path)
    with system.open_input_stream(at) as f:
        return f.read()


def replace_bytes(path: str, data: bytes) -> None:
    """Write a file so that readers see the old one or the new one: a name of its own first, then one rename."""
    system, at = located(path)
    own = f"{at}.{uuid.uuid4().hex}.tmp"
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, at)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def packed_floats(v: str) -> Column:
    """An array of floats as little-endian 32-bit numbers."""

    @F.pandas_udf(BinaryType())
    def pack(values):
        return values.map(lambda x: struct.pack(f"<{len(x)}f", *x), na_action="ignore")

    return pack(F.col(v))


def unpacked_floats(record: str) -> Column:
    """The floats of a packed record."""

    @F.pandas_udf("array<float>")
    def unpack(values):
        return values.map(lambda x: struct.unpack(f"<{len(x) // 4}f", x), na_action="ignore")

    return unpack(F.col(record))


def write_shards(rows: DataFrame, path: str, width: int, shard_rows: int) -> DataFrame:
    """Store ``rows(row_index, record)``, row numbers dense from 0, as shards; returns the table of digests.

    A task holds one shard at a time.  A record of another width, a gap and a
    number given twice raise.  A task that runs again writes the same bytes.
    """
    spark = rows.sparkSession
    number = F.col("row_index").cast("long")
    dealt = rows.select(F.floor(number / shard_rows).cast("long").alias("shard_index"), number.alias("row_index"), "record")
    dealt = dealt.repartition("shard_index").sortWithinPartitions("row_index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def done() -> pa.RecordBatch:
            data = b"".join(parts)
            replace_bytes(f"{path}/{shard_name(shard)}", data)
            row = {"shard_index": shard, "name": shard_name(shard), "records": len(parts), "width": width, "shard_rows": shard_rows, "sha256": hashlib.sha256(data).hexdigest()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard_index", pa.int64()), ("name", pa.string()), ("records", pa.int64()), ("width", pa.int32()), ("shard_rows", pa.int64()), ("sha256", pa.string())]))

        for batch in batches:
            for s, row, record in zip(*(batch.column(c).to_pylist() for c in ("shard_index", "row_index", "record"))):
                if s != shard:
                    if parts:
                        yield done()
                    shard, parts = s, []
                if record is None or len(record) != width:
                    raise ValueError(f"record {row} has not {width} bytes")
                if row != s * shard_rows + len(parts):
                    raise ValueError(f"record {s * shard_rows + len(parts)} is missing or record {row} is given twice")
                parts.append(record)
        if parts:
            yield done()

    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{path}/digests")
    out = spark.read.schema(MANIFEST).parquet(f"{path}/digests")
    short = out.where((F.col("records") < F.col("shard_rows")) & (F.col("shard_index") < out.agg(F.max("shard_index")).first()[0])).limit(1).collect() if not out.isEmpty() else []
    if short:
        raise ValueError(f"{short[0].name} is not full")
    return out


def read_records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(record) of all shards below a path; a length that is no multiple of ``width`` raises."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    whole = F.when(F.col("length") % width == 0, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("cut inside a record: "), "path")).cast("binary"))
    at = F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / width) - 1)
    cut = found.where("length > 0").select(whole.alias("c"), F.explode(at).alias("k"))
    return cut.select(F.substring(F.col("c"), (F.col("k") * width + 1).cast("int"), F.lit(width)).alias("record"))


class ShardCache:
    """The last shards that were read, each checked against its digest when it is loaded."""

    def __init__(self, load: Loader, size: int = CACHED_SHARDS):
        self.load, self.size, self.held, self.loads = load, size, OrderedDict(), 0

    def get(self, path: str, sha256: str) -> bytes:
        if path in self.held:
            self.held.move_to_end(path)
            return self.held[path]
        data = self.load(path)
        self.loads += 1
        if hashlib.sha256(data).hexdigest() != sha256:
            raise ValueError(f"not the bytes that were stored: {path}")
        self.held[path] = data
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return data


def read_at(spark: SparkSession, path: str, wanted: DataFrame, row: str, loader: Loader = load_bytes, cached: int = CACHED_SHARDS) -> DataFrame:
    """``wanted`` with ``record``, the bytes of the row that column ``row`` numbers.

    Rows are dealt by range of their numbers, so neighbours share a task, each
    task opens a shard once, and a hot shard is read by several tasks.  A row
    that no shard holds, or a null, raises; so does a shard with other bytes
    than its digest says.  ``loader`` reads a shard's bytes by its path.
    """
    found = spark.read.schema(MANIFEST).parquet(f"{path}/digests")
    first = found.select("shard_rows", "width").first()
    if first is None:
        raise ValueError(f"the store is empty: {path}")
    shard_rows, width = first
    digests = found.select(F.col("shard_index").alias("_shard"), F.col("sha256").alias("_sha256"))
    digests = F.broadcast(digests) if digests.count() <= BROADCAST_SHARDS else digests
    asked = wanted.withColumn("_shard", F.floor(F.col(row) / shard_rows).cast("long")).join(digests, "_shard", "left")
    # equal rows are told apart by a hash of all columns, so that one row asked for often is still split
    asked = asked.withColumn("_salt", F.xxhash64(*(F.col(f"`{c}`") for c in wanted.columns)))
    dealt = asked.repartitionByRange(F.col(row), F.col("_salt")).sortWithinPartitions(row).drop("_salt")
    out = StructType([*wanted.schema.fields, StructField("record", BinaryType())])
    names = wanted.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ShardCache(loader, cached)
        for big in batches:
            for low in range(0, big.num_rows, BATCH_ROWS):
                batch, records = big.slice(low, BATCH_ROWS), []
                for r, s, d in zip(*(batch.column(c).to_pylist() for c in (row, "_shard", "_sha256"))):
                    if d is None:
                        raise IndexError(f"no such row: {r}")
                    data = cache.get(f"{path}/{shard_name(s)}", d)
                    at = (r - s * shard_rows) * width
                    if at + width > len(data):
                        raise IndexError(f"no such row: {r}")
                    records.append(data[at : at + width])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(records, pa.binary())], names=[*names, "record"])

    return dealt.mapInArrow(read, out)
