"""A table as a stream in a reproducible order, shuffled through a buffer and resumed by row count.

The buffer has ``buffer`` slots, filled with the first rows.  Step i gives out
the row in slot ``slot(i)`` and puts the next row there; after the last row the
slots are given out in a seeded order.  Slots come from arithmetic on the step
alone, so which row a position holds is known without reading the rows before
it: any range of positions can be read anywhere, at any time, and is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from .scratch import shuffles_dropped

# The default seed, slots of the buffer, and rows between two checkpoints.
SEED, BUFFER, CHECKPOINT_ROWS = 42, 10_000, 25_000
#: Arithmetic of the slots: a line and two squares modulo a prime; no product reaches 2**62.
PRIME, STEP, SEED_STEP = 2_147_483_647, 48_271, 69_621
#: Most rows of one file of a stored order; a batch reads the files that it needs.
BLOCK_ROWS = 50_000
#: Positions given by one task.
TASK_ROWS = 10_000
#: Positions of one batch that are broadcast (24 bytes each).
BROADCAST_POSITIONS = 1_000_000
#: Index of the files of a stored order.
FILES = "file string, start bigint, n bigint"


def mixed(i, seed: int):
    """A reproducible number below ``PRIME`` for each step: of a NumPy array of int64, a column or an integer."""
    x = (i % PRIME * STEP + seed % 32_768 * SEED_STEP + 1) % PRIME
    for _ in range(2):
        x = (x * x + x + 7) % PRIME
    return x


def mixed_sql(i: str, seed: int) -> str:
    """The same as SQL."""
    x = f"(({i}) % {PRIME} * {STEP} + {seed % 32_768 * SEED_STEP + 1}) % {PRIME}"
    for _ in range(2):
        x = f"(({x}) * ({x}) + ({x}) + 7) % {PRIME}"
    return x


def _last_before(step: int, slots: np.ndarray, buffer: int, seed: int) -> np.ndarray:
    """For each slot the last step before ``step`` that filled it, or -1.  Looks back block by block until all are found."""
    found = np.full(buffer, -1, np.int64)
    open_ = np.zeros(buffer, bool)
    open_[slots] = True
    while step > 0 and open_.any():
        low = max(0, step - 4 * buffer)
        i = np.arange(low, step, dtype=np.int64)
        s = mixed(i, seed) % buffer
        last = np.full(buffer, -1, np.int64)
        last[s] = i  # of equal slots the last assignment stays
        new = open_ & (last >= 0)
        found[new] = last[new]
        open_ &= ~new
        step = low
    return found[slots]


def rows_at(start: int, end: int, total: int, buffer: int = BUFFER, seed: int = SEED) -> np.ndarray:
    """Numbers of the rows at positions ``start`` to ``end``, exclusive, of ``total`` rows."""
    buffer, end = min(buffer, total), min(end, total)
    if start >= end:
        return np.empty(0, np.int64)
    steps = total - buffer
    i = np.arange(start, min(end, steps), dtype=np.int64)
    slots = mixed(i, seed) % buffer
    order = np.argsort(slots, kind="stable")
    by_slot = slots[order]
    before = np.full(len(i), -2, np.int64)
    if len(i):
        again = np.flatnonzero(by_slot[1:] == by_slot[:-1]) + 1
        before[order[again]] = i[order[again - 1]]
        first = before == -2
        before[first] = _last_before(start, slots[first], buffer, seed)
    out = np.where(before < 0, slots, buffer + before)
    if end <= steps:
        return out
    every = np.arange(buffer, dtype=np.int64)
    drained = np.lexsort((every, mixed(steps + every, seed)))[max(0, start - steps) : end - steps]
    last = _last_before(steps, drained, buffer, seed)
    return np.concatenate([out, np.where(last < 0, drained, buffer + last)])


def buffer_order(rows: DataFrame, number: str, total: int, buffer: int = BUFFER, seed: int = SEED) -> DataFrame:
    """Adds ``pos``, the position of each row under the buffer, for a whole table at once.

    ``number`` is the dense row number.  A slot's rows are sorted in one task:
    there are ``buffer`` groups of about ``total / buffer`` numbers; no other
    column is shuffled with the window's but those of ``rows``.
    """
    buffer = min(buffer, total) or 1
    step = F.col(number) - buffer
    slot = F.when(step < 0, F.col(number)).otherwise(mixed(step, seed) % buffer)
    gone = F.lead("_step").over(Window.partitionBy("_slot").orderBy("_step"))
    df = rows.withColumn("_step", step).withColumn("_slot", slot).withColumn("pos", gone)
    session = rows.sparkSession
    every = session.range(buffer).select(F.col("id").alias("_slot"), mixed(F.col("id") + (total - buffer), seed).alias("_m"))
    drained = every.select("_slot", (F.row_number().over(Window.orderBy("_m", "_slot")) - 1 + (total - buffer)).cast("long").alias("_late"))
    # one row for each slot of the buffer, whose size is a parameter
    drained = F.broadcast(drained) if buffer <= BROADCAST_POSITIONS else drained
    return df.join(drained, "_slot").withColumn("pos", F.coalesce("pos", "_late")).drop("_slot", "_step", "_late")


class BufferOrder(DataSource):
    """Stream ``buffer_order``: (pos, row_no), its offset the number of positions given out.

    Options: total, from (where the last run ended), rows (of a batch), buffer, seed.
    """

    @classmethod
    def name(cls) -> str:
        return "buffer_order"

    def schema(self) -> str:
        return "pos bigint, row_no bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _OrderReader({k: int(self.options.get(k, d)) for k, d in (("total", 0), ("from", 0), ("rows", CHECKPOINT_ROWS), ("buffer", BUFFER), ("seed", SEED))})


class _OrderReader(DataSourceStreamReader):
    """Each batch ends ``rows`` positions after the one before; only a planned batch moves on."""

    def __init__(self, options: dict[str, int]):
        self.o = options
        self.at = options["from"]

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": min(self.at + self.o["rows"], self.o["total"])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["rows"])
        return [InputPartition((a, min(a + TASK_ROWS, end["rows"]))) for a in range(start["rows"], end["rows"], TASK_ROWS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        for pos, row in zip(range(a, b), rows_at(a, b, self.o["total"], self.o["buffer"], self.o["seed"]).tolist()):
            yield pos, row


def write_order(rows: DataFrame, order: list[str], path: str, block_rows: int = BLOCK_ROWS, partitions: int | None = None) -> int:
    """Store ``rows`` once, in the order of columns that identify a row, in files of at most ``block_rows``; returns the row count.

    A row's dense number is its place in its file and what the files before it
    hold: ``files`` keeps where each starts.  It is written last, so an order
    that has it is whole.  The rows pass one shuffle, which goes when they are stored.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    with shuffles_dropped(spark):
        ranged.sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", block_rows).parquet(f"{path}/sorted")
    found = spark.read.schema(rows.schema).parquet(f"{path}/sorted").select(F.col("_metadata.file_name").alias("file"), F.struct(*order).alias("_key"))
    files = found.groupBy("file").agg(F.count("*").alias("n"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    before = Window.orderBy("_low", "_high", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n").write.mode("overwrite").parquet(f"{path}/files")
    return stored_rows(spark, path)


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a stored order."""
    return spark.read.schema(FILES).parquet(f"{path}/files").agg(F.sum("n")).first()[0] or 0


def write_blocks(rows: DataFrame, order: list[str], path: str, block_rows: int) -> int:
    """As write_order(), and the rows once more with their dense ``row_no``, a folder for each ``block_rows`` numbers."""
    spark = rows.sparkSession
    total = write_order(rows, order, path, block_rows)
    found = spark.read.schema(rows.schema).parquet(f"{path}/sorted")
    numbered(found, spark.read.schema(FILES).parquet(f"{path}/files")).withColumn("block", F.floor(F.col("row_no") / block_rows)).write.partitionBy("block").mode("overwrite").parquet(f"{path}/blocks")
    return total


def numbered(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored rows with ``row_no``.  One row a file is broadcast."""
    placed = stored.withColumns({"_file": F.col("_metadata.file_name"), "row_no": F.col("_metadata.row_index")})
    begins = files.select(F.col("file").alias("_file"), F.col("start").alias("_start"))
    return placed.join(F.broadcast(begins), "_file").withColumn("row_no", F.col("_start") + F.col("row_no")).drop("_file", "_start")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def progress(spark: SparkSession, state: str) -> DataFrame:
    """(batch, rows_seen): the batches that a run has stored."""
    schema = "rows_seen bigint, batch bigint"
    path = f"{state}/progress"
    return (spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)).select("batch", "rows_seen")


def run_in_order(spark: SparkSession, path: str, total: int, state: str, save, rows: int = CHECKPOINT_ROWS, buffer: int = BUFFER, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> None:
    """Call ``save(batch, batch_id)`` for every ``rows`` rows of a stored order, from where ``state`` ends to the last row.

    ``batch`` has the stored columns and ``pos``.  ``save`` must replace what
    it wrote for the same id before: a run that broke off repeats its last
    batch with the same rows.  Only the files that a batch needs are read: the
    driver finds them by arithmetic, and there are at most as many as rows.
    Files are found by their index, whatever ``block_rows`` they were cut by.
    The shuffles of a batch go when it is saved.
    """
    done = progress(spark, state).agg(F.max("rows_seen")).first()[0] or 0
    if done >= total:
        return
    spark.dataSource.register(BufferOrder)
    files = spark.read.schema(FILES).parquet(f"{path}/files").orderBy("start").collect()  # one row for each file
    starts, schema = np.array([f.start for f in files], np.int64), spark.read.parquet(f"{path}/sorted").schema

    def holding(first: int, end: int) -> list:
        """The files that hold the rows at these positions."""
        held: set[int] = set()
        for a in range(first, end, TASK_ROWS):
            held.update((np.searchsorted(starts, rows_at(a, min(a + TASK_ROWS, end), total, buffer, seed), "right") - 1).tolist())
        return [files[k] for k in sorted(held)]

    def give(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession  # the stream's own
        batch = batch.persist()
        try:
            first, end = batch.agg(F.min("pos"), F.max("pos") + 1).first()
            needed = holding(first, end)
            stored = session.read.schema(schema).parquet(*(f"{path}/sorted/{f.file}" for f in needed))
            wanted = F.broadcast(batch) if rows <= BROADCAST_POSITIONS else batch
            with shuffles_dropped(session):
                save(numbered(stored, session.createDataFrame(needed, FILES)).join(wanted, "row_no").drop("row_no"), batch_id)
        finally:
            batch.unpersist()
        session.range(0, 1, 1, 1).select(F.lit(end).cast("long").alias("rows_seen")).write.mode("overwrite").parquet(f"{state}/progress/batch={batch_id}")

    options = {"total": total, "from": done, "rows": rows, "buffer": buffer, "seed": seed}
    stream = spark.readStream.format("buffer_order").options(**{k: str(v) for k, v in options.items()}).load()
    query: StreamingQuery = stream.writeStream.foreachBatch(give).option("checkpointLocation", f"{state}/stream").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def ordered_rows(rows: DataFrame, order: list[str], path: str, batch_rows: int = CHECKPOINT_ROWS, buffer: int = BUFFER, seed: int = SEED) -> DataFrame:
    """``rows`` with ``pos``, as the stream gives them out, stored batch by batch."""
    spark = rows.sparkSession
    total = write_order(rows, order, path)
    run_in_order(spark, path, total, f"{path}/state", lambda b, k: b.write.mode("overwrite").parquet(f"{path}/out/batch={k}"), batch_rows, buffer, seed)
    schema = rows.limit(0).withColumn("pos", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).option("basePath", f"{path}/out").option("recursiveFileLookup", True).parquet(f"{path}/out") if total else spark.createDataFrame([], schema)
