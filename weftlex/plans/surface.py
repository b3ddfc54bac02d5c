"""Surface-memory queries: banks from the documents' n-grams, probes from the benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import align as A
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import surface as S
from ..sources.scratch import scratch_folder
from .catalog import literal, query, table
from .corpus import _START, _WORD, _sql_ngrams

BANK = 2000
_FOLD = "lower(strip_accents({}))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase rows of both orders and a sense row for each distinct benchmark word.

    Stored, so that the documents are counted once however often a plan reads them.
    """
    top = C.top_ngrams(table(spark, sf_dir, "documents"), {2: BANK, 3: BANK})
    bank = F.when(F.col("n") == 2, "bigram").otherwise("trigram")
    phrases = top.select(F.lit("phrase").alias("memory_kind"), bank.alias("bank_name"), F.col("n").alias("word_order"), (F.col("rank") - 1).alias("row_index"), F.col("text").alias("surface_text"), "frequency", F.lit(None).cast("string").alias("sense_id"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("surface_text")).distinct()
    words = D.numbered(words, ["surface_text"], "row_index")
    senses = words.select(F.lit("sense").alias("memory_kind"), F.lit("dictionary").alias("bank_name"), F.lit(1).alias("word_order"), "row_index", "surface_text", F.lit(1).cast("long").alias("frequency"), F.concat(F.lit("s:"), F.col("surface_text")).alias("sense_id"))
    path, out = scratch_folder(spark, "records"), phrases.unionByName(senses)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _bank(n: int, name: str) -> str:
    return f"SELECT 'phrase' AS memory_kind, '{name}' AS bank_name, {n} AS word_order, rank - 1 AS row_index, text AS surface_text, frequency, NULL AS sense_id FROM (SELECT text, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, text) AS rank FROM ({_sql_ngrams(n)}) GROUP BY text) WHERE rank <= {BANK}"


_RECORDS = f"""rec AS ({_bank(2, 'bigram')} UNION ALL {_bank(3, 'trigram')} UNION ALL SELECT 'sense', 'dictionary', 1, row_number() OVER (ORDER BY w) - 1, w, 1, 's:' || w FROM (SELECT DISTINCT unnest(regexp_extract_all(text, {_WORD})) AS w FROM benchmark)),
adr AS (SELECT *, string_split({_FOLD.format('surface_text')}, ' ') AS words FROM rec)"""

_UNITS = literal(f"(?:{T.WORD})|{T.BOUNDARY}")
_PROBE = f"""
pu AS (SELECT item_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM (SELECT item_id, regexp_extract_all(text, {_UNITS}) AS u FROM benchmark)),
ps AS (SELECT item_id, {_FOLD.format('x')} AS word, regexp_matches(x, {_START}) AS isw, i, sum(CASE WHEN regexp_matches(x, {_START}) THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY i) AS sg FROM pu),
pp AS (SELECT item_id, CAST(dense_rank() OVER (PARTITION BY item_id ORDER BY sg) - 1 AS INTEGER) AS segment, CAST(row_number() OVER (PARTITION BY item_id, sg ORDER BY i) - 1 AS INTEGER) AS p, word,
  lag(word, 1) OVER (PARTITION BY item_id, sg ORDER BY i) AS l1, lag(word, 2) OVER (PARTITION BY item_id, sg ORDER BY i) AS l2 FROM ps WHERE isw),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_order, words ORDER BY frequency DESC, row_index) AS rn FROM adr WHERE word_order > 1) WHERE rn = 1),
hits AS (SELECT pp.item_id, pp.segment, pp.p, pp.word, CASE WHEN t.words IS NOT NULL THEN 3 WHEN b.words IS NOT NULL THEN 2 WHEN s.w IS NOT NULL THEN 1 END AS word_order, coalesce(t.row_index, b.row_index) AS row_index, coalesce(t.surface_text, b.surface_text) AS surface_text
  FROM pp LEFT JOIN win t ON t.word_order = 3 AND t.words = [l2, l1, word] LEFT JOIN win b ON b.word_order = 2 AND b.words = [l1, word] LEFT JOIN (SELECT DISTINCT words[1] AS w FROM adr WHERE word_order = 1) s ON s.w = word)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.positions(table(spark, sf_dir, "benchmark"), "item_id", T.canonical_words(T.segments(F.col("text"))))


@query(f"WITH {_RECORDS} SELECT memory_kind, bank_name, word_order, row_index, surface_text, frequency, sense_id, words FROM adr")
def address_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.address_table(records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT word_order, words, count(*) AS candidate_count, count(DISTINCT surface_text) AS surface_count, string_agg(row_index || '=' || surface_text, '|' ORDER BY frequency DESC, row_index) AS candidates FROM adr GROUP BY word_order, words HAVING count(DISTINCT surface_text) > 1")
def address_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.collisions(S.address_table(records(spark, sf_dir)).withColumn("own_order", F.col("word_order")).withColumnRenamed("own_order", "order_key"), ["order_key", "words"])
    return out.select(F.col("order_key").alias("word_order"), "words", "candidate_count", "surface_count", F.array_join(F.transform("candidates", lambda c: F.concat(c["row_index"].cast("string"), F.lit("="), c["surface_text"])), "|").alias("candidates"))


@query(f"WITH {_RECORDS}, k AS (SELECT substr(sha256(array_to_string(words, ' ')), 1, 3) AS d, words FROM adr) SELECT count(*) FILTER (n > 1) AS colliding_buckets, count(*) AS buckets FROM (SELECT d, count(DISTINCT words) AS n FROM k GROUP BY d)")
def hash_bucket_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bucket_collisions(S.address_table(records(spark, sf_dir)), F.substring(F.sha2(F.array_join("words", " "), 256), 1, 3), "words")


@query(f"WITH {_RECORDS}, {_PROBE} SELECT item_id, segment, p, word, word_order, row_index, surface_text FROM hits")
def resolve_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolve(_found(spark, sf_dir), S.address_table(records(spark, sf_dir)), "item_id")


@query(f"WITH {_RECORDS}, {_PROBE} SELECT item_id, segment, p, word, a.row_index AS sense_row, a.sense_id, a.frequency FROM hits JOIN adr a ON a.word_order = 1 AND a.words[1] = word WHERE hits.word_order = 1")
def resolve_all_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = S.address_table(records(spark, sf_dir))
    return S.all_senses(S.resolve(_found(spark, sf_dir), addresses, "item_id"), addresses, "item_id")


@query(
    f"""WITH {_RECORDS}, {_PROBE}, e AS (SELECT item_id, segment, p, a.word_order, a.row_index FROM pp JOIN adr a ON (a.word_order = 3 AND a.words = [l2, l1, word]) OR (a.word_order = 2 AND a.words = [l1, word]) OR (a.word_order = 1 AND a.words = [word]))
SELECT item_id, segment, p, word_order, row_index FROM (SELECT *, max(word_order) OVER (PARTITION BY item_id, segment, p) AS top FROM e) WHERE word_order < top"""
)
def resolve_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decomposition(_found(spark, sf_dir), S.address_table(records(spark, sf_dir)), "item_id")


def _codes(c):
    return F.transform(F.filter(F.split(F.lower(c), ""), lambda x: (x != "") & ~x.rlike(r"^\s$")), lambda x: F.ascii(x).cast("long"))


@query(
    f"""WITH rec AS ({_bank(2, 'bigram')} UNION ALL {_bank(3, 'trigram')}),
a AS (SELECT *, regexp_replace(lower(surface_text), '\\s', '', 'g') AS k FROM rec), t AS (SELECT item_id, regexp_replace(lower(text), '\\s', '', 'g') AS k FROM benchmark),
e AS (SELECT item_id, k, unnest(range(0, length(k))) AS "end" FROM t), s AS (SELECT item_id, "end", unnest(range(1, least((SELECT max(length(k)) FROM a), "end" + 1) + 1)) AS n, k FROM e),
h AS (SELECT s.item_id, s."end", s."end" - s.n + 1 AS start, a.word_order, a.row_index, row_number() OVER (PARTITION BY s.item_id, s."end" ORDER BY a.word_order DESC, a.frequency DESC, a.row_index, a.surface_text) AS r FROM s JOIN a ON a.k = substr(s.k, s."end" - s.n + 2, s.n))
SELECT item_id, CAST("end" AS INTEGER) AS "end", CAST(start AS INTEGER) AS start, word_order, row_index FROM h WHERE r = 1"""
)
def resolve_suffix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bank, spans of every length that it has."""
    addresses = S.boundary_variants(records(spark, sf_dir).where("word_order > 1"), _codes)
    tokens = table(spark, sf_dir, "benchmark").select("item_id", _codes(F.col("text")).alias("ids"))
    return S.resolve_suffixes(tokens, addresses, "item_id").drop("sense_id")


@query("WITH w AS (SELECT row_number() OVER (ORDER BY w) - 1 AS id, w FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark) WHERE w <> ''), k AS (SELECT id, lower(strip_accents(w)) AS k FROM w), f AS (SELECT k, row_number() OVER (ORDER BY min(id)) - 1 AS c FROM k GROUP BY k) SELECT id AS raw_token_id, c AS canonical_token_id, k AS canonical_key FROM k JOIN f USING (k)")
def token_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_projection(_vocabulary(spark, sf_dir))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("piece")).where("piece <> ''").distinct()
    return D.numbered(words, ["piece"], "token_id").select("token_id", "piece", F.col("piece").alias("decoded"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark) SELECT count(*) AS raw_vocab_size, count(DISTINCT lower(strip_accents(w))) AS effective_vocab_size, 1 - count(DISTINCT lower(strip_accents(w))) / count(*) AS reduction_fraction FROM w WHERE w <> ''")
def projection_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.projection_report(S.token_projection(_vocabulary(spark, sf_dir)))


@query(f"WITH {_RECORDS} SELECT bank_name, count(*) AS source_rows, max(len(words)) AS maximum_token_span FROM adr GROUP BY bank_name")
def bank_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spans(S.address_table(records(spark, sf_dir)).withColumn("token_length", F.size("words").cast("long")))


def _sql_hash(ids: str, order: int, head: str) -> str:
    out = f"((({H.SEED_BASE} + {order} * {H.SEED_ORDER} + {head} * {H.SEED_HEAD}) % {H.MODULUS})::BIGINT)"
    for k in range(order):
        out = f"(({out} * {H.MULTIPLIER} + {ids}[{k + 1}] + {(k + 1) * H.POSITION_STEP}) % {H.MODULUS})"
    return f"{out} % {H.TABLE_ROWS[order]}"


_LINES = "SELECT l_orderkey, l_linenumber, [l_partkey, l_suppkey] AS a2, [l_partkey, l_suppkey, l_orderkey] AS a3 FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, [{', '.join(_sql_hash('a2', 2, str(h)) for h in range(H.HASH_HEADS))}] AS hash2, [{', '.join(_sql_hash('a3', 3, str(h)) for h in range(H.HASH_HEADS))}] AS hash3 FROM ({_LINES})")
def hash_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", H.hash_addresses(F.array("l_partkey", "l_suppkey"), 2).alias("hash2"), H.hash_addresses(F.array("l_partkey", "l_suppkey", "l_orderkey"), 3).alias("hash3"))


@query(
    f"""WITH {_RECORDS}, {_PROBE}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY segment, p) - 1 AS ordinal FROM hits), i AS (SELECT item_id, ordinal, length(word) AS id, word_order, row_index FROM o),
t AS (SELECT *, [lag(id, 1) OVER w, id] AS s2, [lag(id, 2) OVER w, lag(id, 1) OVER w, id] AS s3 FROM i WINDOW w AS (PARTITION BY item_id ORDER BY ordinal))
SELECT item_id, CAST(ordinal AS INTEGER) AS "end", CASE WHEN word_order IS NULL THEN 0 ELSE 1 END AS memories, word_order AS best_order, row_index AS best_row,
CASE WHEN coalesce(word_order, 0) < 2 AND ordinal >= 1 THEN [{', '.join(_sql_hash('s2', 2, str(h)) for h in range(H.HASH_HEADS))}] END AS hash2, CASE WHEN coalesce(word_order, 0) < 2 AND ordinal >= 2 THEN [{', '.join(_sql_hash('s3', 3, str(h)) for h in range(H.HASH_HEADS))}] END AS hash3 FROM t"""
)
def memory_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token for each word here, its id the word's length."""
    from pyspark.sql import Window

    hits = S.resolve(_found(spark, sf_dir), S.address_table(records(spark, sf_dir)), "item_id")
    order = Window.partitionBy("item_id").orderBy("segment", "p")
    hits = hits.withColumn("ordinal", F.row_number().over(order) - 1)
    tokens = table(spark, sf_dir, "benchmark").select("item_id", F.transform(F.flatten(T.segments(F.col("text"))), F.length).cast("array<bigint>").alias("ids"))
    return S.memory_plan(tokens, hits.select("item_id", "ordinal", F.col("ordinal").alias("token_end")), hits, "item_id")


_CONV = "SELECT conv_id, turn, text FROM conversations"
_W = f"""s AS (SELECT conv_id * 1000 + turn AS k, text, regexp_split_to_array(text, {literal(T.WORD.replace('(?:', '(?:'))}) AS g, regexp_extract_all(text, {_WORD}) AS w FROM conversations),
x AS (SELECT k, text, unnest(w) AS surface, unnest(list_slice(list_transform(g, lambda y: length(y)), 1, len(w))) AS gl, unnest(range(0, len(w))) AS ordinal FROM s),
wd AS (SELECT k, text, surface, ordinal, sum(gl + length(surface)) OVER q - length(surface) AS st, sum(gl + length(surface)) OVER q AS en FROM x WINDOW q AS (PARTITION BY k ORDER BY ordinal)),
tok AS (SELECT k, c, i, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS pos FROM (SELECT k, substr(text, i + 1, 1) AS c, i FROM (SELECT k, text, unnest(range(0, length(text))) AS i FROM s)) WHERE NOT regexp_matches(c, '^\\s$'))"""


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")


@query(f"WITH {_W} SELECT wd.k, CAST(ordinal AS INTEGER) AS ordinal, surface, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS \"end\", min(pos) AS first_token, max(pos) AS last_token, count(*) AS n_tokens FROM wd JOIN tok ON tok.k = wd.k AND tok.i + 1 > st AND tok.i < en GROUP BY wd.k, ordinal, surface, st, en")
def token_word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.aligned(_conversations(spark, sf_dir), "k")
    return df.select("k", "ordinal", "surface", "start", "end", F.array_min("positions").cast("long").alias("first_token"), F.array_max("positions").cast("long").alias("last_token"), F.size("positions").cast("long").alias("n_tokens"))


@query(f"WITH {_W} SELECT wd.k, pos, CAST(ordinal AS INTEGER) AS ordinal FROM wd JOIN tok ON tok.k = wd.k AND tok.i + 1 > st AND tok.i < en")
def token_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _conversations(spark, sf_dir)
    tokens = df.select("k", F.explode(A.char_tokens(F.col("text"))).alias("t")).select("k", F.col("t.pos").cast("long").alias("pos"), "t.start", "t.end")
    words = df.select("k", F.explode(A.word_spans(F.col("text"))).alias("w")).select("k", "w.ordinal", "w.start", "w.end")
    return A.overlap_join(tokens, words, "k", 64)


@query(f"WITH {_W}, f AS (SELECT surface, min(k * 10000 + ordinal) AS o FROM wd GROUP BY surface) SELECT row_number() OVER (ORDER BY o, surface) AS word_id, surface, replace(lower(surface), 'ß', 'ss') AS normalized FROM f")
def word_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.word_units(_occurrences(spark, sf_dir))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _conversations(spark, sf_dir).select("k", F.posexplode(T.words(F.col("text"))).alias("o", "surface"))
    return found.select((F.col("k") * 10000 + F.col("o")).alias("ordinal"), "surface")


@query(
    f"""WITH {_W}, f AS (SELECT surface, min(k * 10000 + ordinal) AS o FROM wd GROUP BY surface), u AS (SELECT row_number() OVER (ORDER BY o, surface) AS word_id, surface FROM f)
SELECT word_id, unnest(['after_space', 'observed', 'standalone']) AS context_kind, length(surface) AS n_tokens, 1 AS forms FROM u"""
)
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = A.word_units(_occurrences(spark, sf_dir))
    seen = A.aligned(_conversations(spark, sf_dir), "k").select("surface", "token_ids", "relative_offsets")
    return A.word_forms(units, seen).groupBy("word_id", "context_kind").agg(F.max(F.size("token_ids")).cast("long").alias("n_tokens"), F.count("*").alias("forms"))


@query("SELECT conv_id, turn, CAST(sum(cut) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS batch FROM (SELECT conv_id, turn, CASE WHEN turn > (SELECT min(turn) FROM conversations c WHERE c.conv_id = d.conv_id) THEN 1 ELSE 0 END AS cut FROM conversations d)")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for one row a batch, each turn is its own; the tests cover wider limits."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return A.pack_batches(rows, "conv_id", "turn", "n", 1, 1 << 20).select("conv_id", "turn", "batch")


@query("SELECT o_orderkey AS row, o_orderkey // 1000 AS shard_index, o_orderkey % 1000 AS local_row FROM orders")
def shard_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), H.shard_of(F.col("o_orderkey"), 1000).alias("s"))
    return df.select("row", "s.shard_index", "s.local_row")
