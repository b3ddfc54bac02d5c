"""Queries of sinks read back, keys, contracts and inputs: what is written is what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..functions import vectors as V
from ..operators import align as A
from ..operators import contracts as X
from ..operators import corpus as C
from ..operators import geometry as G
from ..operators import layers as Y
from ..operators import subspace as S
from ..operators import surface as U
from ..sources import files, lexicons
from ..streaming import corpus as stream
from . import surface as own_surface
from .catalog import literal, query, table
from .corpus import _sql_top
from .dictionary import _RECORDS as _LEXICON
from .dictionary import _built
from .formats import _folder
from .surface import _RECORDS as _BANKS

_WORD = literal(T.WORD)
_r = lambda x: f"round({x}, 6) + 0.0"


def _file(spark: SparkSession, lines: DataFrame, folder: str, name: str) -> str:
    """One text file of the given name from a small table of lines (o, value), in order of o."""
    lines.orderBy("o").select("value").coalesce(1).write.text(f"{folder}/_{name}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{folder}/files"))
    part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/files/{name}"))
    return f"{folder}/files/{name}"


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || 'Concept:' AS text FROM benchmark WHERE trim(text) <> ''")
def definition_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("trim(text) <> ''").select("item_id", T.definition_text(F.col("text")).alias("text"))


@query(f"SELECT item_id, CAST(to_json(regexp_extract_all(text, {_WORD})[1:3]) AS VARCHAR) AS key FROM benchmark")
def word_tuple_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(T.words(F.col("text")), 1, 3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.decode(X.word_tuple_key(words), "UTF-8").alias("key"))


@query("SELECT l_orderkey, l_linenumber, [CAST(l_partkey AS BIGINT), CAST(l_suppkey AS BIGINT), CAST(l_linenumber AS BIGINT)] AS ids FROM lineitem")
def tuple_key_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    key = H.tuple_key(F.array("l_partkey", "l_suppkey", F.col("l_linenumber").cast("long")))
    return df.select("l_orderkey", "l_linenumber", key.alias("key")).select("l_orderkey", "l_linenumber", H.tuple_ids(F.col("key")).alias("ids"))


@query("""SELECT sha256('{"nations":' || (SELECT count(*) FROM nation) || ',"regions":["' || (SELECT string_agg(r_name, '","' ORDER BY r_regionkey) FROM region) || '"]}') AS fingerprint""")
def contract_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return spark.createDataFrame([(files.fingerprint({"regions": regions, "nations": table(spark, sf_dir, "nation").count()}),)], "fingerprint string")


@query("SELECT 'regions.txt' AS name, CAST(sum(length(r_name) + 1) AS BIGINT) AS length, sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS sha256 FROM region")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    _file(spark, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("o"), F.col("r_name").alias("value")), folder, "regions.txt")
    return files.file_hashes(spark, f"{folder}/files").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


_LE = "lpad(to_hex(c % 256), 2, '0') || lpad(to_hex(c // 256 % 256), 2, '0') || '0000'"


@query(f"WITH w AS (SELECT row_number() OVER (ORDER BY w) - 1 AS id, w FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark) WHERE w <> ''), k AS (SELECT id, lower(strip_accents(w)) AS k FROM w), f AS (SELECT k, row_number() OVER (ORDER BY min(id)) - 1 AS c FROM k GROUP BY k) SELECT sha256(CAST('fold-1' AS BLOB) || unhex('00') || unhex(string_agg({_LE}, '' ORDER BY id))) AS fingerprint FROM k JOIN f USING (k)")
def projection_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    projection = U.token_projection(own_surface._vocabulary(spark, sf_dir))
    return spark.createDataFrame([(X.projection_fingerprint(projection, "fold-1"),)], "fingerprint string")


@query("SELECT CAST(n AS INTEGER) AS n, CAST(16 * pow(16, n) AS BIGINT) AS rows FROM (SELECT unnest([1, 2, 3, 4]) AS n)")
def latent_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, H.table_rows(16, 16, n)) for n in (1, 2, 3, 4)], "n int, rows long")


@query("SELECT p_partkey, list_transform([p_size, -1, p_partkey % 60], lambda x: CASE WHEN x < 0 THEN CAST(x AS BIGINT) ELSE CAST(x // 2 AS BIGINT) END) AS ids FROM part")
def projected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids through a table of canonical ids; negative ones pass."""
    ids = F.array(F.col("p_size").cast("long"), F.lit(-1).cast("long"), (F.col("p_partkey") % 60).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", U.project(ids, F.array(*(F.lit(k // 2).cast("long") for k in range(64)))).alias("ids"))


@query(f"SELECT CAST(r AS INTEGER) AS rounds, e AS exponent, {_r('pow(4 * r, e)')} AS skip, {_r('pow(16 * r, -e)')} AS start FROM (SELECT unnest([1, 2, 3, 4]) AS r), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE]) AS e)")
def loop_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r, e, *map(float, G.deep_loop_gains(r, e))) for r in (1, 2, 3, 4) for e in (0.25, 0.5)]
    return spark.createDataFrame(rows, "rounds int, exponent double, skip double, start double").select("rounds", "exponent", V.tidy(F.col("skip")).alias("skip"), V.tidy(F.col("start")).alias("start"))


@query("SELECT 4 AS heads, '2,3' AS orders, CAST(1048576 AS BIGINT) AS rows_2, CAST(4194304 AS BIGINT) AS rows_3, CAST(2147483647 AS BIGINT) AS modulus, CAST(1000003 AS BIGINT) AS multiplier")
def hash_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.hash_contract()
    return spark.createDataFrame([(c["heads"], ",".join(map(str, c["orders"])), c["table_rows"]["2"], c["table_rows"]["3"], c["hash"]["modulus"], c["hash"]["multiplier"])], "heads int, orders string, rows_2 long, rows_3 long, modulus long, multiplier long")


_CASES = "SELECT p_partkey AS k, p_size - 2 AS width, p_partkey % 9 AS n, (p_partkey % 4) / 4.0::DOUBLE AS f FROM part"


@query(
    f"""WITH c AS ({_CASES}) SELECT k, rule FROM (SELECT k, unnest([CASE WHEN width < 1 THEN 'width is positive' END, CASE WHEN n < 1 THEN 'nearest is positive' END, CASE WHEN n < 1 THEN 'skill_top is positive' END, CASE WHEN n > 5 THEN 'skills hold their top' END,
CASE WHEN n - 2 < 0 THEN 'directions are not negative' END, CASE WHEN n - 2 <> 0 AND n % 2 < 1 THEN 'directions need a top' END, CASE WHEN n > 6 THEN 'the nearest fit the window' END, CASE WHEN f <= 0 THEN 'the exponent is positive' END, CASE WHEN width % 4 <> 0 THEN 'the width holds whole routes' END,
CASE WHEN n = 7 THEN 'every order has a table' END, CASE WHEN n - 1 < 1 THEN 'orders are positive' END, CASE WHEN n < 1 THEN 'tables have rows' END, CASE WHEN f <> 0.25 THEN 'memory has a quarter' END, CASE WHEN f NOT IN (0.25, 0.5) THEN 'the loop exponent is known' END]) AS rule FROM c) WHERE rule IS NOT NULL"""
)
def broken_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that made-up settings break."""
    n, f = F.col("p_partkey") % 9, (F.col("p_partkey") % 4) / 4.0
    fixed = {c: F.lit(8) for c in "vocabulary memory_width length rounds skill_rank experts expert_width branches expert_top heads chunk".split()}
    own = {"k": F.col("p_partkey"), "width": F.col("p_size") - 2, "window": F.lit(6), "nearest": n, "skills": F.lit(5), "skill_top": n, "directions": n - 2, "direction_top": n % 2, "exponent": f, "bits": F.lit(4)}
    more = {"orders": F.when(n == 7, F.array(F.lit(2))).otherwise(F.array(n - 1, F.lit(3))), "table_rows": F.array(n, F.lit(9)), "memory_fraction": f, "loop_exponent": f}
    return X.broken_rules(table(spark, sf_dir, "part").select(*(c.alias(name) for name, c in (fixed | own | more).items())), "k")


@query("SELECT 32 AS width, 4 AS bits_per_route, 3 AS nearest, 8 AS window")
def known_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from a mapping with names that are none."""
    s = X.Settings.of({"width": 32, "nearest": 3, "colour": "red", "latent_orders": [2, 3]})
    return spark.createDataFrame([(s.width, s.bits_per_route, s.nearest, s.window)], "width int, bits_per_route int, nearest int, window int")


@query(f"SELECT * FROM ({_sql_top(2)}) WHERE rank <= 50")
def ranked_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked table as JSON lines, then the first ranks of what is read back."""
    folder = _folder(spark)
    files.write_ranked(C.top_ngrams(table(spark, sf_dir, "documents"), {2: 100}), folder)
    return files.top_rows(files.read_jsonl(spark, folder, files.NGRAM), 2, 50)


@query("SELECT conv_id, turn, text FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one line each, blank lines between them."""
    folder = _folder(spark)
    lines = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("j"))
    lines.select(F.explode(F.array("j", F.lit(""))).alias("value")).write.text(folder)
    return files.read_jsonl(spark, folder, "conv_id bigint, turn bigint, text string").select("conv_id", F.col("turn").cast(table(spark, sf_dir, "conversations").schema["turn"].dataType).alias("turn"), "text")


@query("SELECT n_name AS surface, n_comment AS gloss, CASE WHEN n_nationkey % 2 = 0 THEN 'custom' ELSE 'named' END AS source FROM (SELECT *, 'a nation of region ' || n_regionkey AS n_comment FROM nation)")
def definition_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition records, their source the file's stem where they name none."""
    folder = _folder(spark)
    record = F.to_json(F.struct(F.col("n_name").alias("surface"), F.concat(F.lit("a nation of region "), "n_regionkey").alias("gloss"), F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise("named").alias("source")))
    path = _file(spark, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("o"), record.alias("value")), folder, "custom.jsonl")
    return files.read_definitions(spark, path).select("surface", "gloss", "source")


@query("SELECT n_name AS text FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT unnest(['one line', 'two'])")
def text_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file, a field of JSON lines, and literals."""
    folder = _folder(spark)
    lines = _file(spark, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("o"), F.col("n_name").alias("value")), folder, "n.txt")
    objects = _file(spark, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("o"), F.to_json(F.struct(F.col("r_name").alias("t"))).alias("value")), folder, "r.jsonl")
    return files.read_lines(spark, [lines], ["one line", "two"]).unionByName(files.read_lines(spark, [objects], field="t"))


@query("SELECT n_comment, n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, 'n_comment,n_name,n_nationkey' AS header FROM (SELECT *, 'of ' || n_regionkey AS n_comment FROM nation)")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in sorted order under a header."""
    folder = _folder(spark)
    files.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("of "), "n_regionkey").alias("n_comment")), folder)
    df = spark.read.option("header", True).csv(folder)
    return df.select("n_comment", "n_name", F.col("n_nationkey").cast("long").alias("n_nationkey"), F.lit(",".join(df.columns)).alias("header"))


@query(f"WITH {_LEXICON} SELECT word_id, surface, normalized, CAST(NULL AS BIGINT) AS sense_row, NULL AS definition FROM words UNION ALL SELECT word_id, surface, normalized, sense_row, definition FROM senses")
def inventory_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and senses as JSON lines, read back."""
    folder = _folder(spark)
    words, senses, _ = _built(spark, sf_dir)
    X.write_inventory(words, senses, folder)
    w = files.read_jsonl(spark, f"{folder}/words", "word_id bigint, surface string, normalized string")
    s = files.read_jsonl(spark, f"{folder}/senses", "word_id bigint, surface string, normalized string, sense_row bigint, definition string")
    return w.withColumns({"sense_row": F.lit(None).cast("long"), "definition": F.lit(None).cast("string")}).unionByName(s)


@query(f"WITH {_LEXICON} SELECT sense_row, sense_id, word_id, w.surface, w.normalized, definition FROM senses JOIN words w USING (word_id)")
def dictionary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's tables, written once their constraints hold, and the senses joined to their words from them."""
    folder = _folder(spark)
    X.write_dictionary(*_built(spark, sf_dir), folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return X.dictionary_records(read("senses"), read("words")).select("sense_row", "sense_id", "word_id", "surface", "normalized", "definition")


@query(f"WITH {_LEXICON} SELECT sense_id, sense_row, sense_row // 7 AS shard_index, sense_row % 7 AS local_row FROM senses")
def sense_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    files.write_sense_lookup(_built(spark, sf_dir)[1], folder, 7)
    return spark.read.parquet(folder)


_SURFACES = "string_agg(row_index || '=' || surface_text, '|' ORDER BY frequency DESC, row_index)"


@query(f"WITH {_BANKS} SELECT word_order, words, count(*) AS candidate_count, {_SURFACES} AS candidates FROM adr GROUP BY word_order, words HAVING count(DISTINCT surface_text) > 1")
def collision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as JSON lines with nested candidates, read back."""
    folder = _folder(spark)
    addresses = U.address_table(own_surface.records(spark, sf_dir)).withColumn("order_key", F.col("word_order"))
    files.write_collisions(U.collisions(addresses, ["order_key", "words"]), folder)
    df = files.read_jsonl(spark, folder, "order_key int, words array<string>, candidate_count bigint, candidates array<struct<row_index:bigint,surface_text:string>>")
    return df.select(F.col("order_key").alias("word_order"), "words", "candidate_count", F.array_join(F.transform("candidates", lambda c: F.concat(c["row_index"].cast("string"), F.lit("="), c["surface_text"])), "|").alias("candidates"))


@query(f"SELECT text, frequency, n, rank, rank - 1 AS row_index FROM ({_sql_top(2)} UNION ALL {_sql_top(3)}) WHERE rank <= 200")
def phrase_key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase keys in a folder for each order, read back and checked."""
    folder, docs = _folder(spark), table(spark, sf_dir, "documents")
    keys = C.top_ngrams(docs, {2: 200, 3: 200}).withColumn("row_index", F.col("rank") - 1)
    keys.write.parquet(f"{folder}/ranked")  # the ranges of the sort are sampled from these few rows, not from all documents
    files.write_phrase_keys(spark.read.schema(keys.schema).parquet(f"{folder}/ranked"), f"{folder}/keys")
    read = files.read_jsonl(spark, f"{folder}/keys", files.KEYS).select("text", "frequency", "n", "rank", "row_index")
    return X.checked_keys(read.where("n = 2"), 2).unionByName(X.checked_keys(read.where("n = 3"), 3))


@query(f"SELECT a.vec_id, {_r('list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)))')} AS a, {_r('list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * 2))')} AS b FROM embeddings a")
def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources' vectors of the same anchors, paired."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = X.anchor_pairs(e, e.select("vec_id", F.transform("v", lambda x: x * 2).alias("v")), "vec_id", "v")
    return pairs.select("vec_id", V.tidy(V.total(F.col("a"))).alias("a"), V.tidy(V.total(F.col("b"))).alias("b"))


@query("SELECT p_partkey // 2 AS token_id, min(p_name) AS token_piece, min_by('t:' || p_name, p_name) AS decoded_text, min_by(p_partkey % 5 = 0, p_name) AS is_special FROM (SELECT *, p_name || '#' || p_partkey AS n2 FROM part) GROUP BY 1".replace("p_name)", "n2)").replace("|| p_name", "|| n2"))
def vocabulary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each id: of several pieces the least."""
    piece = F.concat("p_name", F.lit("#"), "p_partkey")
    pieces = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 2).alias("token_id"), piece.alias("token_piece"), F.concat(F.lit("t:"), piece).alias("decoded_text"), (F.col("p_partkey") % 5 == 0).alias("is_special"))
    return A.vocabulary_table(pieces).drop("decoded_bytes")


@query("SELECT r_name AS name, CAST(r_regionkey + 1 AS INTEGER) AS rows, 3 AS columns, CAST(3 * (r_regionkey + 1) * r_regionkey AS DOUBLE) AS total FROM region")
def parameter_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays from a table of rows, checked for presence and shape."""
    each = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey", F.explode(F.sequence(F.lit(0), F.col("r_regionkey").cast("int"))).alias("row"))
    p = Y.parameters(each.select("name", "row", F.array_repeat(F.col("r_regionkey").cast("double"), 3).alias("values")))
    Y.need(p, **{k: (None, 3) for k in p})
    return spark.createDataFrame([(k, *v.shape, float(v.sum())) for k, v in p.items()], "name string, rows int, columns int, total double")


@query("SELECT word AS surface, ['plain ' || item_id, 'object ' || item_id, 'english ' || item_id] AS examples, ['art', 'zoology'] AS domains, '1' AS source_version, 'https://example.org' AS source_page, 'CC0' AS license_name FROM (SELECT item_id, regexp_extract(text, " + _WORD + ") AS word FROM benchmark)")
def wiki_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples that are strings or objects, sorted distinct domains, and where a record is from."""
    folder = _folder(spark)
    word, item = F.get(T.words(F.col("text")), F.lit(0)), F.col("item_id").cast("string")
    q = lambda s: F.concat(F.lit('"' + s + ' '), item, F.lit('"'))
    examples = F.concat(F.lit("["), q("plain"), F.lit(',{"text":'), q("object"), F.lit('},{"english":'), q("english"), F.lit("}]"))
    value = F.concat(F.lit('{"word":"'), word, F.lit('","lang_code":"en","pos":"noun","pageid":"1","senses":[{"glosses":["a gloss"],"topics":["Zoology","art"],"categories":["ART"],"examples":'), examples, F.lit("}]}"))
    table(spark, sf_dir, "benchmark").select(value.alias("value")).write.text(folder)
    spec = lexicons.Source("fixture", "wiki_jsonl", "1", "https://example.org", "CC0")
    return lexicons.read_source(spark, folder, spec).select("surface", "examples", "domains", "source_version", "source_page", "license_name")


@query("SELECT * FROM (VALUES ('open_english_wordnet_plus', 'lexicon_xml', '2025+'), ('english_wiktionary', 'wiki_jsonl', '2026-07-06'), ('mesh_descriptors', 'headings_xml', '2026'), ('mesh_supplementary_concepts', 'headings_xml', '2026')) t(source_id, parser, version)")
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.catalog(spark, list(lexicons.SOURCES)).select("source_id", "parser", "version")


@query(f"SELECT DISTINCT regexp_extract(text, {_WORD}) AS surface, 'a word' AS definition, 'noun' AS part_of_speech FROM benchmark")
def reviewed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "benchmark").select(F.get(T.words(F.col("text")), F.lit(0)).alias("headword")).distinct()
    rows = first.select(F.xxhash64("headword").alias("ordinal"), "headword", F.lit(" a  word ").alias("meaning"), F.lit("noun").alias("pos"))
    return lexicons.reviewed_supplement(rows, lexicons.Source("reviewed", "", "1")).select("surface", "definition", "part_of_speech")


@query(f"SELECT count(*) AS sense_rows, count(DISTINCT word) AS headwords, true AS kept FROM (SELECT regexp_extract(text, {_WORD}) AS word FROM benchmark)")
def compiled_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw lexicon compiled to JSON lines with a manifest; compiled again, its files are kept."""
    folder = _folder(spark)
    word = F.get(T.words(F.col("text")), F.lit(0))
    entry = F.struct(word.alias("word"), F.lit("en").alias("lang_code"), F.lit("noun").alias("pos"), F.col("item_id").cast("string").alias("pageid"), F.array(F.struct(F.array(F.lit("a gloss")).alias("glosses"))).alias("senses"))
    table(spark, sf_dir, "benchmark").select(entry.alias("e")).select("e.*").write.json(f"{folder}/raw")
    spec = lexicons.Source("fixture", "wiki_jsonl", "1")
    first = files.compile_source(spark, f"{folder}/raw", f"{folder}/out", spec)
    names = lambda: sorted(r.path for r in files.file_hashes(spark, f"{folder}/out").select("path").collect())
    before = names()
    again = files.compile_source(spark, f"{folder}/raw", f"{folder}/out", spec)
    return spark.createDataFrame([(again["sense_rows"], again["headwords"], first == again and before == names())], "sense_rows long, headwords long, kept boolean")


@query("SELECT * FROM (VALUES ('as written', CAST(0 AS BIGINT)), ('written anew', 2), ('other contract', 1)) t(state, problems)")
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's manifest holds, then not: one file gone and one new, or another contract."""
    folder, rows = _folder(spark), table(spark, sf_dir, "region").coalesce(1)
    write = lambda: rows.write.mode("overwrite").parquet(f"{folder}/t")
    problems = lambda contract: files.manifest_problems(spark, f"{folder}/m", f"{folder}/t", contract).count()
    write()
    files.write_manifest(spark, f"{folder}/m", {"a": 1}, files.file_hashes(spark, f"{folder}/t"))
    out = [("as written", problems({"a": 1})), ("other contract", problems({"a": 2}))]
    write()
    return spark.createDataFrame([*out, ("written anew", problems({"a": 1}))], "state string, problems long")


@query("SELECT count(*) AS rows, 1 AS builds FROM nation")
def artifact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is built once and reused while its manifest holds."""
    folder, builds = _folder(spark), []

    def build() -> DataFrame:
        builds.append(1)
        return table(spark, sf_dir, "nation")

    for _ in range(3):
        found = files.reuse_or_build(spark, f"{folder}/m", f"{folder}/t", {"n": 1}, build)
    return spark.createDataFrame([(found.count(), len(builds))], "rows long, builds int")


@query("SELECT 'shard-' || p_partkey AS name FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def shards_to_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that are absent, or whose digest is not the recorded one."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("shard-"), "p_partkey").alias("name"))
    sha = lambda c: F.sha2(c.cast("string"), 256).alias("sha256")
    found = p.where("p_partkey % 3 <> 0").select("name", sha(F.when(F.col("p_partkey") % 5 == 0, F.lit("other")).otherwise(F.col("name"))))
    return files.missing_shards(p, p.select("name", sha(F.col("name"))), found)


@query("SELECT * FROM (VALUES ('same settings', true), ('other settings', false)) t(attempt, accepted)")
def bound_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's state goes on under the settings that it was begun with only."""
    folder, out = _folder(spark), []
    stream.bind(spark, folder, {"n": 2})
    for attempt, settings in (("same settings", {"n": 2}), ("other settings", {"n": 3})):
        try:
            stream.bind(spark, folder, settings)
            out.append((attempt, True))
        except ValueError:
            out.append((attempt, False))
    return spark.createDataFrame(out, "attempt string, accepted boolean")


@query("SELECT 'below budget: ' || string_agg(r_name || ' ' || n || ' of ' || 6, ', ' ORDER BY r_name) AS message FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) WHERE n < 6")
def budget_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that ended below their budgets are named once what there is has been stored."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("source")).agg(F.count("*").alias("tokens"))
    try:
        stream.require_budget(n, {r.source: 6 for r in n.collect()})
        message = ""
    except RuntimeError as e:
        message = str(e)
    return spark.createDataFrame([(message,)], "message string")


@query(f"WITH w AS (SELECT unnest(regexp_extract_all(text, {_WORD})) AS surface, item_id FROM benchmark) SELECT count(DISTINCT surface) AS words, CAST(count(DISTINCT surface) AS BIGINT) AS ids, CAST(count(DISTINCT surface) AS BIGINT) AS last FROM w")
def appended_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word units of a stream whose second batch repeats the first: ids go on densely and no word comes twice."""
    folder, items = _folder(spark), table(spark, sf_dir, "benchmark").select("item_id", "text")
    for k in (0, 1):
        (items.where("item_id % 2 = 0") if k == 0 else items).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        docs = stream.document_stream(spark, f"{folder}/in", "item_id bigint, text string")
        stream.append_word_units(docs, f"{folder}/out", f"{folder}/state", "item_id").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.agg(F.count_distinct("surface").alias("words"), F.count_distinct("word_id").alias("ids"), F.max("word_id").alias("last"))


@query("SELECT item_id, CAST(e AS INTEGER) AS \"end\", CAST(len(list_filter([1, 2, 3], lambda k: k <= 3 AND (e % 2 = 0) AND (k < 3 OR item_id % 2 = 0))) AS BIGINT) AS memories, CASE WHEN e % 2 = 0 THEN CASE WHEN item_id % 2 = 0 THEN 3 ELSE 2 END END AS best_order, CASE WHEN e % 2 = 0 THEN CAST(CASE WHEN item_id % 2 = 0 THEN 3 ELSE 2 END * 100 + item_id AS BIGINT) END AS best_row, e % 2 = 1 AND e >= 1 AS hashed FROM (SELECT item_id, unnest(range(0, 6)) AS e FROM benchmark)")
def shared_word_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several words end in one token: all are attached, the best is of the highest order; hashes where none ends."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    tokens = items.select("item_id", F.array(*(F.lit(k).cast("long") for k in range(6))).alias("ids"))
    each = items.select("item_id", F.explode(F.array(*(F.struct(F.lit(3 * e + k).alias("ordinal"), F.lit(2 * e).alias("token_end"), F.lit(k + 1).alias("word_order")) for e in range(3) for k in range(3)))).alias("w")).select("item_id", "w.*")
    each = each.where("word_order < 3 OR item_id % 2 = 0")
    resolved = each.select("item_id", "ordinal", "word_order", (F.col("word_order") * 100 + F.col("item_id")).cast("long").alias("row_index"))
    out = U.memory_plan(tokens, each.select("item_id", "ordinal", "token_end"), resolved, "item_id")
    return out.select("item_id", "end", "memories", "best_order", "best_row", F.col("hash2").isNotNull().alias("hashed"))


_UNITS64 = "list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12))"


@query(f"WITH v AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT {_UNITS64} AS u FROM v), x AS (SELECT i, avg(u[i]) AS m, avg(u[i] * u[i]) AS d FROM (SELECT u, unnest(range(1, 65)) AS i FROM u) GROUP BY i) SELECT CAST(64 AS BIGINT) AS components, true AS orthonormal, true AS descending, {_r('sum(d - m * m)')} AS trace, 1.0::DOUBLE AS explained FROM x")
def pca_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basis written by component and read back: orthonormal, in order, its eigenvalues sum to the total variance."""
    folder = _folder(spark)
    v = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    files.write_basis(S.balanced_pca(S.moments(v, "v", 64), 64), folder)
    c = spark.read.parquet(folder)
    other = c.select(F.col("component").alias("o"), F.col("components").alias("w"))
    pairs = c.join(F.broadcast(other), F.col("o") <= F.col("component")).select((F.col("o") == F.col("component")).cast("double").alias("want"), V.dot(F.col("components"), F.col("w")).alias("got"))
    ortho = pairs.agg((F.max(F.abs(F.col("want") - F.col("got"))) < 1e-9).alias("orthonormal"))
    falling = c.join(F.broadcast(c.select((F.col("component") - 1).alias("component"), F.col("eigenvalues").alias("next"))), "component").agg((F.min(F.col("eigenvalues") - F.col("next")) >= -1e-15).alias("descending"))
    return c.agg(F.count("*").alias("components"), V.tidy(F.sum("eigenvalues")).alias("trace"), V.tidy(F.sum("ratio")).alias("explained")).join(F.broadcast(ortho)).join(F.broadcast(falling))


@query("WITH v AS (SELECT vec_id FROM embeddings) SELECT count(*) AS rows, CAST(0 AS BIGINT) AS out_of_range, true AS keeps_energy, true AS whole_is_exact FROM v")
def pca_projection_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of rank 8, 32 and 64 reconstructions: within their range, higher on average with more rank, one at full rank."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    m, out = S.moments(v, "v", 64), None
    for rank in (8, 32, 64):
        own = S.project(v, S.balanced_pca(m, rank), "v").select("vec_id", F.col("cosine").alias(f"c{rank}"))
        out = own if out is None else out.join(own, "vec_id")
    inside = F.greatest(*(F.abs(f"c{r}") for r in (8, 32, 64))) <= 1 + 1e-9
    return out.agg(F.count("*").alias("rows"), F.sum((~inside).cast("long")).alias("out_of_range"), ((F.avg("c8") <= F.avg("c32")) & (F.avg("c32") <= F.avg("c64"))).alias("keeps_energy"), (F.min("c64") > 1 - 1e-9).alias("whole_is_exact"))
