"""Queries of set operations, selectors, statistics and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import capacity as K
from ..operators import contracts as X
from ..operators import dictionary as D
from .catalog import literal, query, table

_WORD = literal(T.WORD)
_B = f"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, {_WORD})) AS w FROM benchmark)"
_C = f"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, {_WORD})) AS w FROM conversations)"


def _words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(T.words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()


@query(f"({_B}) UNION ({_C})")
def words_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "benchmark").union(_words(spark, sf_dir, "conversations")).distinct()


@query(f"({_B}) INTERSECT ({_C})")
def words_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "benchmark").join(_words(spark, sf_dir, "conversations"), "word", "left_semi")


@query(f"({_C}) EXCEPT ({_B})")
def words_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "conversations").join(_words(spark, sf_dir, "benchmark"), "word", "left_anti")


_NAMES = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'bigram_src_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.parquet' WHEN 1 THEN 'hashes_src_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.bin' ELSE 'note.txt' END AS name FROM part"


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("bigram_src_"), number, F.lit(".parquet"))).when(kind == 1, F.concat(F.lit("hashes_src_"), number, F.lit(".bin"))).otherwise("note.txt")
    return table(spark, sf_dir, "part").select("p_partkey", F.lit("src").alias("source"), name.alias("name"))


@query(f"SELECT p_partkey, CAST(nullif(regexp_extract(name, '_(\\d{{6}})\\.(parquet|bin)$', 1), '') AS INTEGER) AS sequence FROM ({_NAMES})")
def shard_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir).select("p_partkey", X.sequence_number(F.col("name")).alias("sequence"))


@query(f"SELECT name FROM ({_NAMES}) WHERE p_partkey % 3 <> 2 AND p_partkey > 50")
def uncommitted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = spark.createDataFrame([("src", 50)], "source string, committed int")
    return X.uncommitted(_shards(spark, sf_dir), committed).select("name")


_KEYS = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'embed.weight' ELSE 'model.layers.' || (p_partkey % 12) || CASE WHEN p_partkey % 2 = 0 THEN '.self_attn.q_proj.weight' ELSE '.mlp.up_proj.weight' END END AS k FROM part"


@query(f"SELECT p_partkey, CAST(nullif(regexp_extract(k, 'layers\\.(\\d+)\\.', 1), '') AS INTEGER) AS layer, coalesce(CAST(nullif(regexp_extract(k, 'layers\\.(\\d+)\\.', 1), '') AS INTEGER) IN (0, 4, 5, 6, 7), false) AS chosen, contains(k, '.q_proj.') AS query FROM ({_KEYS})")
def layer_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    key = F.when(p % 4 == 0, "embed.weight").otherwise(F.concat(F.lit("model.layers."), (p % 12).cast("string"), F.when(p % 2 == 0, ".self_attn.q_proj.weight").otherwise(".mlp.up_proj.weight")))
    df = table(spark, sf_dir, "part").select("p_partkey", key.alias("k")).withColumn("layer", X.layer_of(F.col("k")))
    return df.select("p_partkey", "layer", F.coalesce(X.selected_layers("0,4-7", F.col("layer")), F.lit(False)).alias("chosen"), X.has_module(F.col("k"), "q_proj").alias("query"))


@query("SELECT source, min(length(text)) AS minimum, max(length(text)) AS maximum, avg(length(text)) AS mean FROM documents GROUP BY source")
def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("source", F.length("text").cast("long").alias("n"))
    return X.length_statistics(df, "source", "n")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS place FROM conversations")
def length_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    listed = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "turn"))).alias("r"))
    return listed.select("conv_id", F.posexplode("r").alias("p", "x")).select("conv_id", "x.turn", (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT (s[(n + 1) // 2] + s[n // 2 + 1]) / 2 AS median, s[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95 FROM (SELECT list_sort(list(p_retailprice)) AS s, count(*) AS n FROM part)")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.latency(table(spark, sf_dir, "part"), "p_retailprice")


_HEX = "substr(lpad(to_hex({0}), 8, '0'), 7, 2) || substr(lpad(to_hex({0}), 8, '0'), 5, 2) || substr(lpad(to_hex({0}), 8, '0'), 3, 2) || substr(lpad(to_hex({0}), 8, '0'), 1, 2)"


@query(f"SELECT l_orderkey, l_linenumber, lower('03000000' || {' || '.join(_HEX.format(c) for c in ('l_partkey', 'l_suppkey', 'l_linenumber'))}) AS key FROM lineitem")
def tuple_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole storage keys, in hex."""
    key = H.tuple_key(F.array("l_partkey", "l_suppkey", F.col("l_linenumber").cast("long")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lower(F.hex(key)).alias("key"))


@query("SELECT p_brand AS source, count(*) AS sense_rows, count(DISTINCT lower(p_name)) AS unique_headwords FROM part GROUP BY p_brand")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.source_counts(_records(spark, sf_dir))[0]


@query("SELECT source, domain, n, CAST(rank AS INTEGER) AS rank FROM (SELECT p_brand AS source, d AS domain, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, d) AS rank FROM (SELECT p_brand, unnest(string_split(lower(p_type), ' ')) AS d FROM part) GROUP BY p_brand, d) WHERE rank <= 3")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.source_counts(_records(spark, sf_dir), 3)[1]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_name").alias("surface"), F.split(F.lower("p_type"), " ").alias("domains"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import last_written as keep

    return keep(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id")


def _constraints_sql() -> str:
    from .dictionary import _RECORDS

    rules = {
        "word_id is unique": "SELECT word_id FROM words GROUP BY 1 HAVING count(*) > 1",
        "normalized is unique": "SELECT normalized FROM words GROUP BY 1 HAVING count(*) > 1",
        "sense_row is unique": "SELECT sense_row FROM senses GROUP BY 1 HAVING count(*) > 1",
        "senses have words": "SELECT 1 FROM senses WHERE word_id NOT IN (SELECT word_id FROM words)",
        "edges have senses": "SELECT 1 FROM edges WHERE sense_row NOT IN (SELECT sense_row FROM senses)",
        "edges have words": "SELECT 1 FROM edges WHERE definition_word_id NOT IN (SELECT word_id FROM words)",
        "edge positions are unique": "SELECT 1 FROM edges GROUP BY sense_row, position HAVING count(*) > 1",
    }
    return f"WITH {_RECORDS} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS violations FROM ({q})" for r, q in rules.items())


@query(_constraints_sql())
def dictionary_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dictionary import _built

    return X.validate_dictionary(*_built(spark, sf_dir))
