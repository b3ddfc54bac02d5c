"""Queries of file formats and streams: fixtures are written from the test tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dictionary as D
from ..sources import files, lexicons, ordered, store
from ..sources.scratch import scratch_folder
from ..streaming import corpus as stream
from .catalog import literal, query, table
from .corpus import _sql_ngrams


def _folder(spark: SparkSession) -> str:
    return scratch_folder(spark, "formats")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(T.words(F.col("text")), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", word.alias("word"), F.regexp_replace("text", r"\s+", " ").alias("gloss"))


_ITEMS = f"i AS (SELECT item_id, regexp_extract(text, {literal(T.WORD)}) AS word, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS gloss FROM benchmark)"
_ESCAPE = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def _escaped(c: str):
    out = F.col(c)
    for a, b in _ESCAPE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _write_xml(elements: DataFrame, path: str, compression: str = "none") -> None:
    """One well-formed file for each hundred items of ``elements(item_id, value)``."""
    docs = elements.groupBy(F.floor(F.col("item_id") / 100).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("v"))
    docs.select("part", F.concat(F.lit("<Root>"), "v", F.lit("</Root>")).alias("value")).write.partitionBy("part").option("compression", compression).text(path)


SPEC = lexicons.Source("fixture", "lexicon_xml", "2024-01-01")


@query(f"WITH {_ITEMS} SELECT word AS surface, 'n' AS part_of_speech, gloss AS definition, 'fixture:2024-01-01' AS source, 's' || item_id AS source_sense_key FROM i WHERE item_id % 3 <> 0")
def wordnet_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one word and of two, the latter left out."""
    path = _folder(spark)
    item = F.col("item_id").cast("string")
    form = F.when(F.col("item_id") % 3 == 0, F.concat(_escaped("word"), F.lit(" twice"))).otherwise(_escaped("word"))
    entry = F.concat(F.lit('<LexicalEntry id="e'), item, F.lit('"><Lemma writtenForm="'), form, F.lit('" partOfSpeech="n"/><Sense id="s'), item, F.lit('" synset="y'), item, F.lit('"/></LexicalEntry>'))
    synset = F.concat(F.lit('<Synset id="y'), item, F.lit('"><Definition>'), _escaped("gloss"), F.lit("</Definition><Example>x</Example></Synset>"))
    _write_xml(_items(spark, sf_dir).select("item_id", F.concat(entry, synset).alias("value")), path, "gzip")
    return lexicons.read_lexicon_xml(spark, path, SPEC).select("surface", "part_of_speech", "definition", "source", "source_sense_key")


@query(f"WITH {_ITEMS} SELECT word AS surface, gloss AS definition, CASE WHEN item_id % 2 = 0 THEN 'id' || item_id ELSE item_id || ':noun:0:' || substr(sha256(concat_ws(chr(31), replace(lower(word), 'ß', 'ss'), 'noun', '0', gloss)), 1, 24) END AS source_sense_key FROM i WHERE item_id % 5 <> 0 AND item_id % 7 <> 0")
def wiktextract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer senses and other languages are left out; keys are given or derived."""
    path = _folder(spark)
    sense = F.struct(
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("id"), "item_id")).alias("id"),
        F.array(F.lit("first"), F.col("gloss")).alias("glosses"),
        F.when(F.col("item_id") % 5 == 0, F.array(F.struct(F.lit("other").alias("word")))).alias("form_of"),
        F.array(F.struct(F.lit("an example").alias("text"))).alias("examples"),
        F.array(F.lit("Zoology"), F.lit("art")).alias("topics"),
    )
    rows = _items(spark, sf_dir).select("word", F.when(F.col("item_id") % 7 == 0, "fr").otherwise("en").alias("lang_code"), F.lit("noun").alias("pos"), F.col("item_id").alias("pageid"), F.array(sense).alias("senses"))
    rows.write.option("compression", "gzip").json(path)
    return lexicons.read_wiki_jsonl(spark, path, lexicons.Source("fixture", "wiki_jsonl", "1")).select("surface", "definition", "source_sense_key")


@query(f"WITH {_ITEMS} SELECT word AS surface, gloss AS definition, 'D' || item_id || ':C' || item_id || ':T' || item_id AS source_sense_key FROM i WHERE item_id % 4 <> 0")
def mesh_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts without a scope note and terms of two words are left out."""
    path = _folder(spark)
    item = F.col("item_id").cast("string")
    note = F.when(F.col("item_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<ScopeNote>"), _escaped("gloss"), F.lit("</ScopeNote>")))
    terms = F.concat(F.lit("<TermList><Term><TermUI>T"), item, F.lit("</TermUI><String>"), _escaped("word"), F.lit("</String></Term><Term><TermUI>U</TermUI><String>two words</String></Term></TermList>"))
    record = F.concat(F.lit("<DescriptorRecord><DescriptorUI>D"), item, F.lit("</DescriptorUI><ConceptList><Concept><ConceptUI>C"), item, F.lit("</ConceptUI>"), note, terms, F.lit("</Concept></ConceptList></DescriptorRecord>"))
    _write_xml(_items(spark, sf_dir).select("item_id", record.alias("value")), path)
    return lexicons.read_headings_xml(spark, path, lexicons.Source("fixture", "headings_xml", "1")).select("surface", "definition", "source_sense_key")


@query("SELECT count(DISTINCT text) AS documents, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text)")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of one batch; of equal texts the smallest id counts, whichever row came first."""
    path = _folder(spark)
    docs = stream.document_stream(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, text string")
    stream.write_once(stream.deduplicated(docs).select("digest"), f"{path}/out", f"{path}/state").awaitTermination()
    kept = spark.read.parquet(f"{path}/out")
    ids = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id").join(kept, "digest").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return ids.agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids"))


@query(f"SELECT text, count(*) AS frequency FROM ({_sql_ngrams(2)}) GROUP BY text")
def stream_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    docs = stream.document_stream(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, text string")
    stream.partial_counts(docs, 2, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("text").agg(F.sum("frequency").alias("frequency"))


@query("SELECT vec_id AS row_index, vec_id // 100 AS shard_index, vec_id % 100 AS local_row FROM embeddings")
def vector_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    e = table(spark, sf_dir, "embeddings").select(F.lit("bank").alias("bank_name"), F.col("vec_id").alias("row_index"), "embedding")
    files.write_bank(files.checked_width(e, "embedding", 64), path, 100)
    wanted = e.select("bank_name", "row_index")
    return files.read_rows(spark.read.parquet(path), wanted).select("row_index", F.col("shard_index").cast("long").alias("shard_index"), "local_row")


@query("SELECT user_id, event_id, list_transform([event_id, n1, n2], lambda x: x) AS window, t AS target FROM (SELECT user_id, event_id, lead(event_id, 1) OVER w AS n1, lead(event_id, 2) OVER w AS n2, lead(event_id, 3) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE t IS NOT NULL")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.windows(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id", 3)


@query("SELECT s_suppkey, regexp_extract(h, 'dated\\s+(\\d{4}-\\d{2}-\\d{2})', 1) AS snapshot FROM (SELECT s_suppkey, '<p>Extracted from the wiki dump of ' || s_name || ', dated 2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') || '</p>' AS h FROM supplier)")
def snapshot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<p>Extracted from the wiki dump of "), "s_name", F.lit(", dated 2024-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit("</p>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.snapshot_date(page).alias("snapshot"))


def _sql_order(total: str, buffer: str) -> str:
    """Positions of a buffer-shuffled stream: a row leaves its slot when the next one enters it, the last ones in a drawn order."""
    slot = f"CASE WHEN n < {buffer} THEN n ELSE {ordered.mixed_sql(f'n - {buffer}', ordered.SEED)} % {buffer} END"
    drawn = f"row_number() OVER (ORDER BY ({ordered.mixed_sql(f'slot + {total} - {buffer}', ordered.SEED)}), slot) - 1 + {total} - {buffer}"
    return f"""z AS (SELECT count(*) AS total, least(count(*), {ordered.BUFFER}) AS buffer FROM documents), r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents),
s AS (SELECT doc_id, text, n, total, buffer, {slot} AS slot FROM r, z), g AS (SELECT *, lead(n - buffer) OVER (PARTITION BY slot ORDER BY n) AS gone FROM s),
l AS (SELECT doc_id, text, CAST({drawn} AS BIGINT) AS pos FROM g WHERE gone IS NULL), placed AS (SELECT doc_id, text, gone AS pos FROM g WHERE gone IS NOT NULL UNION ALL SELECT doc_id, text, pos FROM l)"""


@query(f"WITH {_sql_order('total', 'buffer')} SELECT pos, doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM placed")
def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the shuffle buffer, 25,000 a batch, the offset a row count."""
    out = ordered.ordered_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], _folder(spark))
    return out.select("pos", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query(f"SELECT text, count(*) AS frequency FROM ({_sql_ngrams(2)}) GROUP BY text")
def checkpointed_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams from partials of bounded size, one set for each checkpoint of the shuffled stream."""
    return stream.checkpointed_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], 2, _folder(spark))


@query("SELECT q.vec_id AS query_id, e.vec_id AS row_index, q.label, array_to_string(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(CAST(floor(CAST(e.embedding[i] AS DOUBLE) * 1048576) AS BIGINT) AS VARCHAR)), ',') AS vector FROM embeddings q JOIN embeddings e ON e.vec_id = (q.vec_id * 7919) % (SELECT max(vec_id) + 1 FROM embeddings)")
def store_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of a sharded store is asked for once, in no order, through a cache of shards checked by digest."""
    path, e = _folder(spark), table(spark, sf_dir, "embeddings")
    width = 64
    rows = files.checked_width(e, "embedding", width).select(F.col("vec_id").alias("row_index"), store.packed_floats("embedding").alias("record"))
    store.write_shards(rows, path, 4 * width, 1_000)
    above = e.agg((F.max("vec_id") + 1).alias("above"))  # one row
    wanted = e.join(F.broadcast(above)).select(F.col("vec_id").alias("query_id"), "label", ((F.col("vec_id") * 7919) % F.col("above")).alias("row_index"))
    found = store.read_at(spark, path, wanted, "row_index")
    scaled = F.transform(store.unpacked_floats("record"), lambda x: F.floor(x.cast("double") * 1_048_576).cast("string"))
    return found.select("query_id", "row_index", "label", F.array_join(scaled, ",").alias("vector"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r, md5(coalesce(text, '')) AS d FROM documents) WHERE r = 1 AND d NOT IN (SELECT md5(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)")
def digest_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the even documents as fixed-width shards; of the others those that no shard holds, one of each text."""
    path = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("record"))
    seen = D.numbered(docs.where("doc_id % 2 = 0").select("record").distinct(), ["record"], "row_index")
    store.write_shards(seen, path, 16, 50_000)
    fresh = docs.join(store.read_records(spark, path, 16), "record", "left_anti")
    return fresh.groupBy("record").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
