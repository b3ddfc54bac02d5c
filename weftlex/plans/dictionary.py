"""Dictionary queries over a lexicon derived from the test tables.

Headwords are the distinct words of the benchmark items; a word is defined by
every item that it opens a sentence of.  N-gram words are those of all
conversations, of which the items share only some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import dictionary as D
from .catalog import literal, query, table

_WORD = literal(T.WORD)
_N = "replace(lower(trim({})), 'ß', 'ss')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records: (ordinal, word, gloss, pos, synset_id), one for each sentence's first word, some blank keys and repeats."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]+")).alias("i", "s"))
    items = items.select("item_id", "i", F.btrim("s").alias("gloss"), F.get(T.words(F.col("s")), F.lit(0)).alias("word")).where("word IS NOT NULL AND gloss <> ''")
    key = F.when(F.col("item_id") % 3 == 0, F.lit(" ")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("k"), F.col("item_id") % 7)).otherwise(F.concat_ws(":", "item_id", "i"))
    return items.select((F.col("item_id") * 1000 + F.col("i")).alias("ordinal"), "word", "gloss", F.lit("noun").alias("pos"), key.alias("synset_id"))


_RECORDS = f"""
i AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.\\n]+'), 1) - 1 AS i FROM benchmark),
r AS (SELECT item_id * 1000 + i AS ordinal, regexp_extract(s, {_WORD}) AS surface, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS definition, trim(s) AS raw,
  CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'k' || (item_id % 7) ELSE item_id || ':' || i END AS key FROM i WHERE regexp_extract(s, {_WORD}) <> '' AND trim(s) <> ''),
c AS (SELECT ordinal, surface, 'noun' AS part_of_speech, definition, 'custom' AS source, {_N.format('surface')} AS normalized,
  coalesce(key, 'sense_' || substr(sha256({_N.format('surface')} || chr(31) || 'noun' || chr(31) || raw), 1, 24)) AS source_sense_key FROM r),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_sense_key, normalized ORDER BY ordinal) AS rn FROM c) WHERE rn = 1),
u AS (SELECT ordinal, unnest(regexp_extract_all(definition, {_WORD})) AS definition_surface, generate_subscripts(regexp_extract_all(definition, {_WORD}), 1) - 1 AS position FROM s),
un AS (SELECT *, {_N.format('definition_surface')} AS n FROM u),
g AS (SELECT {{'c': conv_id, 't': turn}} AS ordinal, unnest(regexp_extract_all(text, {_WORD})) AS surface FROM conversations),
gn AS (SELECT g.*, {_N.format('surface')} AS normalized FROM g),
w0 AS (SELECT normalized, max_by(surface, ordinal) AS s1, NULL AS s2, NULL AS s3 FROM s GROUP BY 1 UNION ALL SELECT normalized, NULL, min(surface), NULL FROM (SELECT *, rank() OVER (PARTITION BY normalized ORDER BY ordinal, surface) AS k FROM gn) WHERE k = 1 GROUP BY 1
  UNION ALL SELECT n, NULL, NULL, first(definition_surface ORDER BY ordinal, position) FROM un GROUP BY 1),
words AS (SELECT row_number() OVER (ORDER BY normalized) - 1 AS word_id, coalesce(max(s1), max(s2), max(s3)) AS surface, normalized, max(s2) IS NOT NULL AS in_ngram_vocabulary FROM w0 GROUP BY normalized),
senses AS (SELECT row_number() OVER (ORDER BY word_id, source, source_sense_key, definition) - 1 AS sense_row, 'sense_' || substr(sha256(source || chr(31) || source_sense_key || chr(31) || s.normalized), 1, 24) AS sense_id, word_id, s.surface, s.normalized, part_of_speech, definition, source, source_sense_key, ordinal FROM s JOIN words USING (normalized)),
edges AS (SELECT sense_row, CAST(position AS INTEGER) AS position, definition_surface, w.word_id AS definition_word_id FROM un JOIN senses USING (ordinal) JOIN words w ON w.normalized = un.n)
"""


def _ngram_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, surface), one row for each spelling: of equal ordinals the least spelling comes first."""
    found = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.explode(T.words(F.col("text"))).alias("surface"))
    return found.groupBy("surface").agg(F.min("at").alias("at")).select(F.struct("at", "surface").alias("ordinal"), "surface")


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return D.build(D.candidates(records(spark, sf_dir)), _ngram_words(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT word_id, surface, normalized, in_ngram_vocabulary FROM words")
def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[0]


@query(f"WITH {_RECORDS} SELECT sense_row, sense_id, word_id, surface, normalized, part_of_speech, definition, source, source_sense_key FROM senses")
def lexicon_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[1].drop("examples")


@query(f"WITH {_RECORDS} SELECT sense_row, position, definition_surface, definition_word_id FROM edges")
def definition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[2]


@query(
    f"""WITH {_RECORDS}, f AS (SELECT word_id, in_ngram_vocabulary AS g, word_id IN (SELECT word_id FROM senses) AS s, word_id IN (SELECT definition_word_id FROM edges) AS d FROM words)
SELECT count(*) AS word_rows, count(*) FILTER (g) AS ngram_vocabulary_words, count(*) FILTER (g AND s) AS ngram_words_with_definition, count(*) FILTER (g AND NOT s) AS ngram_words_without_definition, count(*) FILTER (d) AS definition_word_nodes, count(*) FILTER (d AND s) AS definition_word_nodes_with_senses, count(*) FILTER (d AND NOT s) AS definition_word_nodes_as_links_only, (SELECT count(*) FROM senses) AS sense_rows, (SELECT count(*) FROM edges) AS definition_word_edges FROM f"""
)
def dictionary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dictionary_report(*_built(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT ordinal, surface, part_of_speech, definition, source, source_sense_key, normalized FROM c")
def record_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.candidates(records(spark, sf_dir)).drop("examples")


_FREQUENCY = f"SELECT {_N.format('w')} AS word, CAST(sum(greatest(coalesce(k, 1), 1)) AS BIGINT) AS frequency FROM (SELECT unnest(regexp_extract_all(text, {_WORD})) AS w, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE doc_id % 4 END AS k FROM documents) GROUP BY 1"
_HEADS = f"SELECT DISTINCT {_N.format('w')} AS word FROM (SELECT unnest(regexp_extract_all(text, {_WORD})) AS w FROM benchmark)"


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.expr("CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE doc_id % 4 END")
    return C.word_frequency(table(spark, sf_dir, "documents").select("text", weight.alias("k")), "text", "k")


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return found.select(T.normalize_word(F.col("w")).alias("word")).distinct()


@query(
    f"WITH f AS ({_FREQUENCY}), h AS ({_HEADS}), m AS (SELECT f.*, h.word IS NOT NULL AS d FROM f LEFT JOIN h USING (word)) SELECT count(*) AS unique_ngram_words, count(*) FILTER (d) AS defined_ngram_words, count(*) FILTER (NOT d) AS missing_ngram_words, count(*) FILTER (d) / count(*) AS type_coverage, CAST(sum(frequency) FILTER (d) AS BIGINT) / CAST(sum(frequency) AS BIGINT) AS frequency_weighted_coverage FROM m"
)
def lexicon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.coverage(_heads(spark, sf_dir), _frequency(spark, sf_dir))


@query(f"WITH f AS ({_FREQUENCY}), h AS ({_HEADS}) SELECT word, frequency FROM f WHERE word NOT IN (SELECT word FROM h) ORDER BY frequency DESC, word LIMIT 1000")
def missing_words_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.most_frequent_missing(_heads(spark, sf_dir), _frequency(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT n AS word, count(*) AS frequency FROM un WHERE n NOT IN (SELECT normalized FROM s) GROUP BY n ORDER BY frequency DESC, word LIMIT 1000")
def label_only_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.label_only_words(D.distinct_senses(D.candidates(records(spark, sf_dir))))


@query(
    f"WITH {_RECORDS} SELECT (SELECT count(DISTINCT normalized) FROM s) AS headwords, (SELECT count(*) FROM s) AS sense_rows, (SELECT count(*) FROM s) * {D.VECTOR_BYTES} AS vector_bytes, (SELECT count(*) FROM s) * {D.VECTOR_BYTES} / 1073741824.0::DOUBLE AS vector_gib, count(DISTINCT n) AS definition_word_nodes, count(*) AS definition_word_edges, count(DISTINCT n) FILTER (n IN (SELECT normalized FROM s)) AS definition_words_with_sense_payload, count(DISTINCT n) FILTER (n NOT IN (SELECT normalized FROM s)) AS definition_words_as_label_only_nodes FROM un"
)
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.storage_report(D.distinct_senses(D.candidates(records(spark, sf_dir))))


_PHRASE = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN ' ' || split_part(p_name, ' ', 1) || ' ' ELSE p_brand END"


@query(f"SELECT p_partkey, CASE WHEN len(regexp_extract_all(c, {_WORD})) = 1 AND regexp_extract(c, {_WORD}) = c THEN c END AS word FROM (SELECT p_partkey, trim(regexp_replace({_PHRASE}, '\\s+', ' ', 'g')) AS c FROM part)")
def single_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.single_word(F.expr(_PHRASE)).alias("word"))


@query("SELECT event_id, (event_type IN ('abbreviation', 'form-of') OR lower(event_type) IN ('click', 'view') AND user_id % 2 = 0) AS excluded FROM events")
def exclude_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.lower("event_type").isin("click", "view") & (F.col("user_id") % 2 == 0), F.array("event_type", F.lit(" Form-Of "))).otherwise(F.array("event_type"))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select("event_id", D.excluded_sense(tags, none, F.lit(None).cast("array<string>")).alias("excluded"))


_KEYS = "SELECT l_orderkey AS n, CAST(l_linenumber - 1 AS BIGINT) AS row_index FROM lineitem"


@query(f"SELECT n, count(*) AS rows, (count(*) = count(DISTINCT row_index) AND min(row_index) = 0 AND max(row_index) = count(*) - 1) AS contiguous FROM ({_KEYS}) GROUP BY n")
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("n"), (F.col("l_linenumber") - 1).cast("long").alias("row_index"))
    return D.contiguous(rows, "row_index", ["n"])


@query(
    "SELECT coalesce(a.k, b.k) AS path, a.h AS recorded, b.h AS actual FROM (SELECT s_suppkey AS k, sha256(s_name) AS h FROM supplier WHERE s_suppkey % 7 <> 0) a FULL JOIN (SELECT s_suppkey AS k, sha256(CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE s_name END) AS h FROM supplier WHERE s_suppkey % 11 <> 0) b USING (k) WHERE a.h IS DISTINCT FROM b.h"
)
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), "s_name")
    recorded = s.where("path % 7 <> 0").select("path", F.sha2("s_name", 256).alias("sha256"))
    actual = s.where("path % 11 <> 0").select("path", F.sha2(F.when(F.col("path") % 5 == 0, "x").otherwise(F.col("s_name")), 256).alias("sha256"))
    return D.contract_mismatches(recorded, actual)
