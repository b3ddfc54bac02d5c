"""Files: JSON lines, text, ranked keys, vector banks, manifests; readers and writers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H

NGRAM = "text string, frequency bigint, n int, rank bigint"
KEYS = "text string, frequency bigint, n int, rank bigint, row_index bigint, source_rank bigint, donor_token_count int"
DEFINITIONS = "surface string, word string, lemma string, headword string, definition string, gloss string, meaning string, part_of_speech string, pos string, source string, source_sense_key string, sense_key string, synset_id string, id string, examples array<string>"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Objects of one line each; blank lines pass, any other malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_definitions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Definition records, their source the file's stem where they name none, with an ordinal by file and line."""
    df = read_jsonl(spark, path, DEFINITIONS)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*(?:\.gz)?$", 1)
    df = df.withColumn("source", F.coalesce(F.nullif(F.btrim("source"), F.lit("")), stem))
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, paths: list[str] | None = None, literals: list[str] | None = None, field: str | None = None) -> DataFrame:
    """(text) of files, each a line or a JSON field of it, and of literal strings."""
    parts = []
    if paths:
        parts.append(read_jsonl(spark, paths, f"`{field}` string").select(F.col(field).alias("text")) if field else spark.read.text(paths).select(F.col("value").alias("text")))
    if literals:
        parts.append(spark.createDataFrame([(x,) for x in literals], "text string"))
    if not parts:
        raise ValueError("no inputs")
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def top_rows(ranked: DataFrame, n: int, take: int) -> DataFrame:
    """The first ``take`` ranks of one order; fewer of them raise."""
    rows = ranked.where((F.col("n") == n) & (F.col("rank") <= take))
    found = rows.count()
    if found != take:
        raise ValueError(f"{take} rows are expected, {found} found")
    return rows


def write_ranked(ranked: DataFrame, path: str) -> None:
    """A ranked table as JSON lines, one folder for each order, rows in order of rank."""
    ranked.repartitionByRange("n", "rank").sortWithinPartitions("n", "rank").write.partitionBy("n").mode("overwrite").json(path)


def write_collisions(collisions: DataFrame, path: str) -> None:
    """Addresses of several surfaces as JSON lines, their candidates nested."""
    collisions.write.mode("overwrite").json(path)


def write_phrase_keys(keys: DataFrame, path: str) -> None:
    """Phrase keys as JSON lines, one folder for each order, in order of their row numbers."""
    keys.repartitionByRange("n", "row_index").sortWithinPartitions("n", "row_index").write.partitionBy("n").mode("overwrite").json(path)


def write_sense_lookup(senses: DataFrame, path: str, shard_rows: int = 50_000) -> None:
    """Where each sense's vector lies: (sense_id, sense_row, shard_index, local_row), sorted by sense_id for point reads."""
    at = senses.select("sense_id", "sense_row", H.shard_of(F.col("sense_row"), shard_rows).alias("s"))
    at.select("sense_id", "sense_row", "s.shard_index", "s.local_row").repartitionByRange("sense_id").sortWithinPartitions("sense_id").write.mode("overwrite").parquet(path)


def write_basis(basis: DataFrame, path: str) -> None:
    """A fitted basis: one row for each component, with its eigenvalue and explained ratio."""
    each = F.arrays_zip(F.col("components"), F.col("eigenvalues"), F.col("ratio"))
    out = basis.select(*(c for c in basis.columns if c == "source"), F.posexplode(each).alias("component", "x"))
    out.select(*(c for c in basis.columns if c == "source"), "component", "x.components", "x.eigenvalues", "x.ratio").write.mode("overwrite").parquet(path)


def compile_source(spark: SparkSession, source: str, path: str, spec) -> dict:
    """A raw lexicon as canonical JSON lines under ``path`` with a manifest beside it; what holds already is kept.

    Returns the manifest's counts: sense rows and distinct headwords.
    """
    from . import lexicons

    contract = {"source_id": spec.source_id, "parser": spec.parser, "version": spec.version, "files": sorted((r.path.rsplit("/", 1)[-1], r.sha256) for r in file_hashes(spark, source).select("path", "sha256").collect())}
    manifest = f"{path}.manifest"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    if not (at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) and manifest_problems(spark, manifest, path, contract).isEmpty()):
        lexicons.read_source(spark, source, spec).write.mode("overwrite").json(path)
        write_manifest(spark, manifest, contract, file_hashes(spark, path))
    rows = spark.read.schema("surface string").json(path)
    return rows.agg(F.count("*").alias("sense_rows"), F.count_distinct("surface").alias("headwords")).first().asDict()


def missing_shards(expected: DataFrame, manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """The shards that a resumed run must write again: (name) expected and absent, or other than recorded.

    ``manifest`` and ``actual`` are (name, sha256) as recorded and as found.
    """
    good = manifest.join(actual, ["name", "sha256"], "left_semi")
    return expected.select("name").join(good, "name", "left_anti")


def write_preview(preview: DataFrame, path: str) -> None:
    """A preview of bounded length as one text file."""
    preview.orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header of sorted column names."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_bank(vectors: DataFrame, path: str, shard_rows: int = 50_000) -> None:
    """A vector bank: rows under ``shard_index``, so that a point read opens one shard."""
    s = H.shard_of(F.col("row_index"), shard_rows)
    rows = vectors.withColumn("_s", s).select("*", "_s.shard_index", "_s.local_row").drop("_s")
    rows.repartition("bank_name", "shard_index").sortWithinPartitions("row_index").write.partitionBy("bank_name", "shard_index").mode("overwrite").parquet(path)


def read_rows(bank: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vectors of wanted (bank_name, row_index); one that the bank lacks raises when it is read."""
    hit = wanted.join(bank.withColumn("_found", F.lit(True)), ["bank_name", "row_index"], "left")
    ok = F.coalesce("_found", F.raise_error(F.concat(F.lit("no such row: "), F.col("row_index").cast("string"))).cast("boolean"))
    return hit.withColumn("_found", ok).where("_found").drop("_found")


def checked_width(vectors: DataFrame, v: str, width: int) -> DataFrame:
    """``vectors``, raising at the first whose width differs."""
    return vectors.withColumn(v, F.when(F.size(v) == width, F.col(v)).otherwise(F.raise_error(F.lit(f"width {width} is expected")).cast(vectors.schema[v].dataType)))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, contract: dict, files: DataFrame) -> str:
    """Write the contract, its fingerprint and the files' hashes as one JSON object; returns the fingerprint."""
    mark = fingerprint(contract)
    rows = files.agg(F.sort_array(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256"))).alias("files"))
    rows.select(F.lit(json.dumps(contract, sort_keys=True)).alias("contract"), F.lit(mark).alias("fingerprint"), "files").coalesce(1).write.mode("overwrite").json(path)
    return mark


def manifest_problems(spark: SparkSession, manifest: str, path: str, contract: dict) -> DataFrame:
    """(name, recorded, actual) where files differ from their manifest, and one row if the contract does."""
    m = spark.read.schema("contract string, fingerprint string, files array<struct<name:string,length:bigint,sha256:string>>").json(manifest)
    recorded = m.select(F.explode("files").alias("f")).select("f.name", F.col("f.sha256").alias("recorded"))
    actual = file_hashes(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("actual"))
    differ = recorded.join(actual, "name", "full").where(~F.col("recorded").eqNullSafe(F.col("actual")))
    mark = fingerprint(contract)
    return differ.unionByName(m.where(F.col("fingerprint") != mark).select(F.lit("contract").alias("name"), F.col("fingerprint").alias("recorded"), F.lit(mark).alias("actual")))


def reuse_or_build(spark: SparkSession, manifest: str, path: str, contract: dict, build) -> DataFrame:
    """The table under ``path`` if its manifest holds, else what ``build()`` writes there anew."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(manifest)
    if not (at.getFileSystem(conf).exists(at) and manifest_problems(spark, manifest, path, contract).isEmpty()):
        build().write.mode("overwrite").parquet(path)
        write_manifest(spark, manifest, contract, file_hashes(spark, path))
    return spark.read.parquet(path)


def reproducible(rows: DataFrame, key: str, skip: int = 0, seed: int = 42) -> DataFrame:
    """A stream's order as a dense ``pos`` by seeded hash, without the rows already taken."""
    from ..operators.dictionary import numbered

    order = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    return numbered(order, ["_h", key], "pos").where(F.col("pos") >= skip).drop("_h")


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in ``order`` replaces those before."""
    best = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(best, [key, order]).dropDuplicates([key])


def windows(values: DataFrame, by: str, order: str, v: str, length: int) -> DataFrame:
    """Every run of ``length`` values with the value that follows: training windows of stride one."""
    w = Window.partitionBy(by).orderBy(order)
    df = values.withColumn("window", F.collect_list(v).over(w.rowsBetween(0, length - 1))).withColumn("target", F.lead(v, length).over(w))
    return df.where((F.size("window") == length) & F.col("target").isNotNull()).select(by, order, "window", "target")
