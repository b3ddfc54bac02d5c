"""Corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from .catalog import literal, query, table

TOP = 1000
BUDGETS = {"src0": 20_000, "src1": 5_000, "src2": 1_000}

_UNIT = literal(f"(?:{T.WORD})|{T.BOUNDARY}")
_WORD = literal(T.WORD)
_START = literal(T.WORD_START)
_U = f"SELECT doc_id, source, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM (SELECT doc_id, source, regexp_extract_all(text, {_UNIT}) AS u FROM documents)"


def _sql_ngrams(n: int) -> str:
    cols = ", ".join(f"lead(x, {k}) OVER w AS x{k}" for k in range(1, n))
    test = " AND ".join([f"regexp_matches(x, {_START})", *(f"regexp_matches(x{k}, {_START})" for k in range(1, n))])
    text = " || ' ' || ".join(["x", *(f"x{k}" for k in range(1, n))])
    return f"SELECT doc_id, source, {text} AS text FROM (SELECT doc_id, source, x, {cols} FROM ({_U}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {test}"


def _sql_top(n: int) -> str:
    return f"SELECT text, frequency, {n} AS n, rank FROM (SELECT text, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, text) AS rank FROM ({_sql_ngrams(n)}) GROUP BY text) WHERE rank <= {TOP}"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(_sql_top(2))
def ngram_top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_ngrams(_docs(spark, sf_dir), {2: TOP})


@query(_sql_top(3))
def ngram_top_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_ngrams(_docs(spark, sf_dir), {3: TOP})


@query(f"SELECT rank, rank || chr(9) || frequency || chr(9) || text AS line FROM ({_sql_top(2)}) WHERE rank <= 100")
def ngram_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preview(ngram_top_bigrams(spark, sf_dir))


@query(f"SELECT text, count(*) AS frequency FROM ({_sql_ngrams(2)}) GROUP BY text")
def partial_then_final_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    halves = [docs.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    return C.merged_counts(*(C.ngram_counts(h, 2) for h in halves))


_NORMAL = "replace(lower(trim({})), 'ß', 'ss')"


@query(f"SELECT {_NORMAL.format('w')} AS word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(text, {_WORD})) AS w FROM documents) GROUP BY 1")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_frequency(_docs(spark, sf_dir))


@query(
    f"""
WITH u AS ({_U}), s AS (SELECT doc_id, regexp_matches(x, {_START}) AS w, sum(CASE WHEN regexp_matches(x, {_START}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM u),
g AS (SELECT doc_id, seg, count(*) AS n FROM s WHERE w GROUP BY doc_id, seg)
SELECT d.doc_id, count(g.n) AS n_segments, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS n_words, coalesce(max(g.n), 0) AS longest FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""
)
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _docs(spark, sf_dir).select("doc_id", F.transform(T.segments(F.col("text")), F.size).alias("s"))
    return df.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_words"), F.coalesce(F.array_max("s"), F.lit(0)).cast("long").alias("longest"))


def _sql_clean(c: str) -> str:
    for a, b in T.JOINS:
        c = f"replace({c}, '{a}', '{b}')"
    for p, r in ((T.URL, " "), (T.FORMAT_COMMAND, " "), (T.COMMAND, r" \1 "), (T.CONTROL, " "), (T.SPACES, " ")):
        c = f"regexp_replace({c}, {literal(p)}, '{r}', 'g')"
    return f"trim({c})"


@query(f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text"), unescape=False).alias("cleaned"))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _sql_unescape(c: str) -> str:
    for a, b in _ENTITIES:
        c = f"replace({c}, {literal(a)}, {literal(b)})"
    return c


@query(f"SELECT page_id, sha256({_sql_clean(_sql_unescape('html'))}) AS cleaned_sha256, length({_sql_clean(_sql_unescape('html'))}) AS n_chars FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html"), closed=True).alias("c"))
    return df.select("page_id", F.sha2("c", 256).alias("cleaned_sha256"), F.length("c").cast("long").alias("n_chars"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup(_docs(spark, sf_dir).select("doc_id", "text"), ["doc_id"]).select("doc_id")


@query("SELECT source, doc_id AS pos FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup(_docs(spark, sf_dir).select("source", F.col("doc_id").alias("pos"), "text")).select("source", "pos")


def _sql_budget() -> str:
    parts, seen = [], []
    words = f"CAST(len(regexp_extract_all(text, {_WORD})) AS BIGINT)"
    for k, (source, budget) in enumerate(BUDGETS.items()):
        anti = "".join(f" AND text NOT IN (SELECT text FROM c{j})" for j in seen)
        parts.append(
            f"f{k} AS (SELECT source, pos, text, n_words FROM (SELECT source, doc_id AS pos, text, {words} AS n_words, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE source = '{source}') WHERE r = 1{anti}), "
            f"c{k} AS (SELECT *, least(n_words, {budget} - before) AS kept_words FROM (SELECT *, CAST(coalesce(sum(n_words) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM f{k}) WHERE before < {budget})"
        )
        seen.append(k)
    every = " UNION ALL ".join(f"SELECT source, pos, n_words, before, kept_words FROM c{k}" for k in seen)
    return f"WITH {', '.join(parts)} SELECT * FROM ({every})"


@query(_sql_budget())
def corpus_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("source", F.col("doc_id").alias("pos"), "text")
    return C.budget_cut(docs, BUDGETS).select("source", "pos", "n_words", "before", "kept_words")


_METRICS = f"""
WITH u AS ({_U}), d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents),
n1 AS (SELECT doc_id, count(*) AS c FROM u WHERE regexp_matches(x, {_START}) GROUP BY doc_id), n2 AS (SELECT doc_id, count(*) AS c FROM ({_sql_ngrams(2)}) GROUP BY doc_id), n3 AS (SELECT doc_id, count(*) AS c FROM ({_sql_ngrams(3)}) GROUP BY doc_id)
SELECT d.source, count(*) AS rows_seen, count(*) FILTER (r = 1 AND coalesce(n1.c, 0) > 0) AS documents_used, CAST(0 AS BIGINT) AS skipped_filter, count(*) FILTER (r = 1 AND coalesce(n1.c, 0) = 0) AS skipped_empty, count(*) FILTER (r > 1) AS skipped_duplicate,
CAST(coalesce(sum(n1.c) FILTER (r = 1), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(n2.c) FILTER (r = 1), 0) AS BIGINT) AS bigrams, CAST(coalesce(sum(n3.c) FILTER (r = 1), 0) AS BIGINT) AS trigrams
FROM d LEFT JOIN n1 USING (doc_id) LEFT JOIN n2 USING (doc_id) LEFT JOIN n3 USING (doc_id) GROUP BY d.source
"""


@query(_METRICS)
def corpus_source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.source_metrics(_docs(spark, sf_dir).select("source", F.col("doc_id").alias("pos"), "text", F.lit("used").alias("status")))


@query(
    f"SELECT count(*) AS sources, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('rows_seen', 'documents_used', 'skipped_filter', 'skipped_empty', 'skipped_duplicate', 'tokens', 'bigrams', 'trigrams'))} FROM ({_METRICS})"
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.totals(corpus_source_metrics(spark, sf_dir))


_CATEGORY = "CASE p_partkey % 5 WHEN 0 THEN 'physics.' || lower(p_brand) WHEN 1 THEN 'cs.LG math-ph' WHEN 2 THEN 'physicsx stat.ML' WHEN 3 THEN 'astro-ph' ELSE NULL END"


@query(f"SELECT p_partkey, list_bool_or(list_transform(string_split(coalesce({_CATEGORY}, ''), ' '), lambda x: x IN {T.EXACT_CATEGORIES} OR regexp_matches(x, '^({'|'.join(T.CATEGORY_PREFIXES)})($|\\.)'))) AS selected FROM part")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.category_selected(F.expr(_CATEGORY)).alias("selected"))


@query("SELECT p_partkey, trim(trim(coalesce(p_name, '')) || '. ' || trim(coalesce(p_type, ''))) AS text FROM part")
def title_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title_and_abstract(F.col("p_name"), F.col("p_type")).alias("text"))
