"""Streaming corpus operators: deduplication, n-gram counts and word units over a growing folder.

Runs use ``availableNow`` triggers: each takes what is new, commits its offsets
in the checkpoint, and ends, so a run that is broken off resumes without loss or
repeats.  State is bound to a fingerprint of the settings.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as T
from ..operators.align import word_units
from ..sources import ordered
from ..sources.files import fingerprint
from ..sources.scratch import delete

#: N-grams of one partial table (a fixed value for order two).
PARTIAL_KEYS = 10_000_000
#: Fewest documents of a checkpoint that are dealt to one task.
DEALT_ROWS = 1_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_stream(spark: SparkSession, folder: str, schema: str, files: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """Rows of the Parquet files that arrive in a folder; of a path that is one file, its rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getFileStatus(at).isFile():
        folder, pattern = at.getParent().toString(), at.getName()  # a stream's source is a folder
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def bind(spark: SparkSession, state: str, settings: dict) -> None:
    """Keep the settings' fingerprint beside the state; other settings than those it was begun with raise."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{state}/settings")
    mark = fingerprint(settings)
    if at.getFileSystem(conf).exists(at):
        found = spark.read.text(at.toString()).first()
        if found is None or json.loads(found.value)["fingerprint"] != mark:
            raise ValueError("the state was begun with other settings")
        return
    spark.createDataFrame([(json.dumps({"fingerprint": mark}),)], "value string").coalesce(1).write.text(at.toString())


def deduplicated(stream: DataFrame, text: str = "text") -> DataFrame:
    """The first row of each text ever seen.  State holds one digest for each distinct text and has no bound in time."""
    return stream.withColumn("digest", F.sha2(F.col(text), 256)).dropDuplicates(["digest"])


def ngram_updates(stream: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(text, frequency): running counts; in update mode a batch emits the n-grams that it changed."""
    return stream.select(F.explode(T.ngrams(T.units(F.col(text)), n)).alias("text")).groupBy("text").agg(F.count("*").alias("frequency"))


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to Parquet, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_counts(stream: DataFrame, n: int, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Write each batch's n-gram counts as one partial table; a batch that runs again replaces its own.

    Final counts are the sum over partials, so no streaming state grows with
    the vocabulary.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        counts = batch.select(F.explode(T.ngrams(T.units(F.col(text)), n)).alias("text")).groupBy("text").agg(F.count("*").alias("frequency"))
        counts.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpointed_counts(docs: DataFrame, order: list[str], n: int, path: str, rows: int = ordered.CHECKPOINT_ROWS, keys: int = PARTIAL_KEYS, buffer: int = ordered.BUFFER, text: str = "text") -> DataFrame:
    """(text, frequency): exact n-gram counts from partial tables, one set for each ``rows`` documents of the shuffled order.

    A batch's documents are dealt evenly over tasks by position, and each task
    counts its own, so n-grams are shuffled once, for the final sums.  Counts
    are flushed in files of at most ``keys`` n-grams, so a partial never holds
    more, and what a task holds in memory spills.  Under ``path`` an
    interrupted run goes on after its last stored batch; a batch that runs
    again replaces its own partials.  The order is stored once and goes when
    all of it is counted.
    """
    spark = docs.sparkSession
    marks = {"n": n, "order": order, "rows": rows, "keys": keys, "buffer": buffer}
    bind(spark, f"{path}/state", marks)
    if not ordered.exists(spark, f"{path}/order/files/_SUCCESS"):
        ordered.write_order(docs, order, f"{path}/order")
    total = ordered.stored_rows(spark, f"{path}/order")
    parts = max(min(spark.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS)), -(-rows // ordered.TASK_ROWS))

    def save(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.select(F.col(text).alias("text"), F.pmod("pos", F.lit(parts)).cast("int").alias("part")).repartitionById(parts, "part")
        found = dealt.select("part", F.explode(T.ngrams(T.units(F.col("text")), n)).alias("text"))
        counts = found.groupBy("part", "text").agg(F.count("*").alias("frequency")).drop("part")
        counts.write.mode("overwrite").option("maxRecordsPerFile", keys).option("compression", "zstd").parquet(f"{path}/partials/batch={batch_id}")

    ordered.run_in_order(spark, f"{path}/order", total, f"{path}/state", save, rows, buffer)
    delete(spark, f"{path}/order/sorted")
    if not total:
        return spark.createDataFrame([], "text string, frequency bigint")
    return spark.read.schema("text string, frequency bigint").parquet(f"{path}/partials").groupBy("text").agg(F.sum("frequency").alias("frequency"))


def append_word_units(stream: DataFrame, path: str, checkpoint: str, ordinal: str, text: str = "text") -> StreamingQuery:
    """Append the words that a batch is the first to hold; ids go on where the table ends.

    A batch reads only what earlier batches wrote, so running it again gives
    the same ids.
    """
    spark = stream.sparkSession
    schema = "word_id bigint, surface string, normalized string"

    def save(batch: DataFrame, batch_id: int) -> None:
        found = batch.select(F.col(ordinal).alias("o"), F.posexplode(T.words(F.col(text))).alias("i", "surface")).select(F.struct("o", "i").alias("ordinal"), "surface")
        known = None
        if batch_id:
            known = spark.read.schema(schema + ", batch bigint").option("basePath", path).parquet(path).where(F.col("batch") < batch_id).select("word_id", "surface", "normalized")
        units = word_units(found, known)
        fresh = units if known is None else units.join(known.select("surface"), "surface", "left_anti")
        fresh.select("word_id", "surface", "normalized").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def require_budget(metrics: DataFrame, budgets: dict[str, int], tokens: str = "tokens") -> None:
    """Raise, after what there is has been stored, for sources that ended below their budgets."""
    spark = metrics.sparkSession
    want = spark.createDataFrame(list(budgets.items()), "source string, budget long")
    short = want.join(metrics.select("source", tokens), "source", "left").where(F.coalesce(tokens, F.lit(0)) < F.col("budget")).orderBy("source").collect()
    if short:
        raise RuntimeError("below budget: " + ", ".join(f"{r.source} {r[tokens] or 0} of {r.budget}" for r in short))
