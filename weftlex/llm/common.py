"""What the operators share: tables, the shared folder, staged tables, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of two or three narrow columns that is broadcast (about 16 MB).
BROADCAST_ROWS = 500_000
#: Rows and bytes of an Arrow batch that goes to a Python worker; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


#: Input below this many bytes, in fewer files than there are cores, is dealt out to all of them.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input that few scan tasks would read out to all cores; a large one stays as its files split."""
    spark = df.sparkSession
    cores, found = spark.sparkContext.defaultParallelism, df.inputFiles()
    if len(found) >= cores:
        return df
    jvm, conf, size = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in found:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        size += at.getFileSystem(conf).getFileStatus(at).getLen()
    return df.repartition(cores) if 0 < size < SPREAD_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a session without one raises, save in local mode.

    In local mode driver and executors are one process, so a folder under the warehouse serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone by then; the folder is scratch
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has run."""
    for t in tables:
        _delete(t.sparkSession, t._staged_at)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if, counted, it has at most ``limit`` narrow rows."""
    return F.broadcast(df) if df.count() <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores, such that no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def look_up(rows: DataFrame, named: DataFrame, on: str, total: int) -> DataFrame:
    """Left join of ``rows`` with staged ``named`` (one row for each ``on``, ``k`` of how many rows of ``rows`` it is).

    A small ``named`` is broadcast.  Else the keys of a thousandth of the rows
    or more, a thousand at most, are broadcast and looked up first, so that no
    task of the shuffle join that follows gets more than such a share by a key.
    """
    others = [c for c in named.columns if c not in (on, "k")]
    if named.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named.drop("k")), on, "left")
    heavy = named.where(F.col("k") * 1000 >= total).drop("k")
    hot = F.broadcast(heavy.select(on, F.lit(True).alias("is_hot")))
    marked = rows.join(hot, on, "left")
    easy = marked.where("is_hot").drop("is_hot").join(F.broadcast(heavy), on, "left")
    rest = marked.where("is_hot IS NULL").drop("is_hot").join(named.where(F.col("k") * 1000 < total).drop("k"), on, "left")
    return easy.unionByName(rest).select(*rows.columns, *others)


def arrow_rows(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches made small: a batch lies in the JVM, beside it and in the worker at once."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give a task's memory back to the system when it ends; idle workers live on beside the next stage."""

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return held


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(u, v)``: (node, root), root the smallest node.

    Alternates large-star and small-star steps until nothing moves; each step is
    a grouped minimum and a join back, staged in the shared folder; the minima
    are written before they are joined, so that the join can split a hub's
    rows.  Nodes without an edge to another one are left out.  An empty input
    gives no rows.
    """

    def step(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        dropped(least)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), name)
        near = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = staged(near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        dropped(least, large, e)
        return out

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    cur = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = mark(cur)
    while before[0]:
        cur = step(cur)
        after = mark(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
