"""Registry of named queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


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


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
