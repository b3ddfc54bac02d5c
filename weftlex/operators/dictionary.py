"""Dictionary operators: sense candidates to words, senses and the definition-word graph, with reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The field names under which sources give a sense's parts, by preference.
SURFACE = ("surface", "word", "lemma", "headword")
DEFINITION = ("definition", "gloss", "meaning")
PART_OF_SPEECH = ("part_of_speech", "pos")
SENSE_KEY = ("source_sense_key", "sense_key", "synset_id", "id")
#: Bytes of one stored vector: its width times two.
VECTOR_BYTES = 2048 * 2
#: Rows numbered by one task.
NUMBER_ROWS = 250_000


def normalized(values: DataFrame, col: str, name: str = "normalized") -> DataFrame:
    """Adds ``name``, the normal form of ``col``, computed once for each distinct value."""
    known = values.select(col).distinct().withColumn(name, T.normalize_word(F.col(col)))
    return values.join(known, col)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds a dense number in the order of the columns, which identify a row.

    Rows are dealt by range; each range's count gives its first number, and a
    window within the range the rest.  No task sees all rows.
    """
    parts = max(1, -(-df.count() // NUMBER_ROWS))
    if parts == 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1 + start).cast("long"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.persist()
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_low"))
    before = Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    own = Window.partitionBy("_part").orderBy(*order)
    return ranged.join(starts, "_part").withColumn(name, (F.col("_start") + F.row_number().over(own) - 1 + start).cast("long")).drop("_part", "_start")


def candidates(records: DataFrame, default_source: str = "custom", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, surface, part_of_speech, definition, source, source_sense_key, examples, normalized).

    Aliased fields are taken by preference, blank ones count as missing; a
    record without a surface or a definition raises.  A missing key is derived
    from the content.
    """
    have = set(records.columns)
    pick = lambda names: T.first_present(*(F.col(n) for n in names if n in have)) if have & set(names) else F.lit(None).cast("string")
    need = lambda c, what: F.coalesce(c, F.raise_error(F.concat(F.lit(f"definition record without {what}: "), F.col(ordinal).cast("string"))).cast("string"))
    examples = F.filter(F.transform("examples", F.btrim), lambda x: x != "") if "examples" in have else F.array().cast("array<string>")
    df = records.select(
        F.col(ordinal).cast("long").alias("ordinal"),
        need(pick(SURFACE), "a word").alias("raw_surface"),
        F.coalesce(pick(PART_OF_SPEECH), F.lit("")).alias("part_of_speech"),
        need(pick(DEFINITION), "a definition").alias("raw_definition"),
        F.coalesce(pick(("source",)), F.lit(default_source)).alias("source"),
        pick(SENSE_KEY).alias("key"),
        F.coalesce(examples, F.array().cast("array<string>")).alias("examples"),
    )
    df = normalized(df, "raw_surface")
    key = F.coalesce("key", T.stable_identifier("sense", F.col("normalized"), F.col("part_of_speech"), F.col("raw_definition")))
    return df.select("ordinal", F.col("raw_surface").alias("surface"), "part_of_speech", T.collapse(F.col("raw_definition")).alias("definition"), "source", key.alias("source_sense_key"), "examples", "normalized")


def distinct_senses(found: DataFrame) -> DataFrame:
    """The first candidate of each (source, key, normalized word)."""
    keys = ["source", "source_sense_key", "normalized"]
    return found.join(found.groupBy(*keys).agg(F.min("ordinal").alias("ordinal")), [*keys, "ordinal"])


def build(found: DataFrame, ngram_words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, senses, definition_word_edges) from candidates and ``ngram_words(ordinal, surface)``.

    words(word_id, surface, normalized, in_ngram_vocabulary): ids dense over the
    sorted normal forms; the surface is that of the last candidate, else of the
    first n-gram word, else of the first definition word.
    senses: rows dense over (word_id, source, key, definition).
    edges(sense_row, position, definition_surface, definition_word_id): the words
    of each definition in order.
    """
    senses = distinct_senses(found)
    used = senses.select("ordinal", F.posexplode(T.words(F.col("definition"))).alias("position", "definition_surface"))
    used = normalized(used, "definition_surface", "n")
    inside = normalized(ngram_words.select("ordinal", "surface"), "surface")

    by_sense = senses.groupBy("normalized").agg(F.max_by("surface", "ordinal").alias("s1"))
    by_ngram = inside.groupBy("normalized").agg(F.min_by("surface", "ordinal").alias("s2"))
    by_use = used.groupBy(F.col("n").alias("normalized")).agg(F.min_by("definition_surface", F.struct("ordinal", "position")).alias("s3"))
    words = by_sense.join(by_ngram, "normalized", "full").join(by_use, "normalized", "full")
    words = words.select(F.coalesce("s1", "s2", "s3").alias("surface"), "normalized", F.col("s2").isNotNull().alias("in_ngram_vocabulary"))
    words = numbered(words, ["normalized"], "word_id").select("word_id", "surface", "normalized", "in_ngram_vocabulary")

    ids = words.select("normalized", "word_id")
    rows = numbered(senses.join(ids, "normalized"), ["word_id", "source", "source_sense_key", "definition"], "sense_row")
    rows = rows.withColumn("sense_id", T.stable_identifier("sense", F.col("source"), F.col("source_sense_key"), F.col("normalized")))
    rows = rows.select("sense_row", "sense_id", "word_id", "surface", "normalized", "part_of_speech", "definition", "source", "source_sense_key", "examples", "ordinal")
    edges = used.join(rows.select("ordinal", "sense_row"), "ordinal").join(ids.select(F.col("normalized").alias("n"), F.col("word_id").alias("definition_word_id")), "n")
    return words, rows.drop("ordinal"), edges.select("sense_row", "position", "definition_surface", "definition_word_id")


def dictionary_report(words: DataFrame, senses: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts over a built dictionary."""
    flags = words.select("word_id", "in_ngram_vocabulary")
    flags = flags.join(senses.select("word_id").distinct().withColumn("s", F.lit(True)), "word_id", "left")
    flags = flags.join(edges.select(F.col("definition_word_id").alias("word_id")).distinct().withColumn("d", F.lit(True)), "word_id", "left")
    sense, node, inside = F.col("s").isNotNull(), F.col("d").isNotNull(), F.col("in_ngram_vocabulary")
    left = flags.agg(
        F.count("*").alias("word_rows"),
        F.count_if(inside).alias("ngram_vocabulary_words"),
        F.count_if(inside & sense).alias("ngram_words_with_definition"),
        F.count_if(inside & ~sense).alias("ngram_words_without_definition"),
        F.count_if(node).alias("definition_word_nodes"),
        F.count_if(node & sense).alias("definition_word_nodes_with_senses"),
        F.count_if(node & ~sense).alias("definition_word_nodes_as_links_only"),
    )
    # one row each
    return left.join(senses.agg(F.count("*").alias("sense_rows"))).join(edges.agg(F.count("*").alias("definition_word_edges")))


def coverage(headwords: DataFrame, frequency: DataFrame) -> DataFrame:
    """One row: how many of ``frequency(word, frequency)`` are ``headwords(word)``, by type and by weight; 1.0 if none."""
    marked = frequency.join(headwords.select("word").distinct().withColumn("d", F.lit(True)), "word", "left")
    has = F.col("d").isNotNull()
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    out = marked.agg(F.count("*").alias("n"), F.count_if(has).alias("d"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(has, F.col("frequency"))), F.lit(0)).alias("c"))
    return out.select(F.col("n").alias("unique_ngram_words"), F.col("d").alias("defined_ngram_words"), (F.col("n") - F.col("d")).alias("missing_ngram_words"), share(F.col("d"), F.col("n")).alias("type_coverage"), share(F.col("c"), F.col("w")).alias("frequency_weighted_coverage"))


def most_frequent_missing(headwords: DataFrame, frequency: DataFrame, k: int = 1000) -> DataFrame:
    """(word, frequency): the k most frequent words that are no headword."""
    return frequency.join(headwords.select("word").distinct(), "word", "left_anti").orderBy(F.desc("frequency"), "word").limit(k)


def definition_word_counts(senses: DataFrame) -> DataFrame:
    """(word, frequency) over the definitions' words."""
    used = senses.select(F.explode(T.words(F.col("definition"))).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    return normalized(used, "w", "word").groupBy("word").agg(F.sum("k").alias("frequency"))


def storage_report(senses: DataFrame, vector_bytes: int = VECTOR_BYTES) -> DataFrame:
    """One row: size of the sense payload and of its word graph, from ``senses(surface, definition)``."""
    heads = normalized(senses.select("surface"), "surface", "word").select("word").distinct()
    used = definition_word_counts(senses).join(heads.withColumn("h", F.lit(True)), "word", "left")
    left = used.agg(F.count("*").alias("definition_word_nodes"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("definition_word_edges"), F.count_if(F.col("h").isNotNull()).alias("definition_words_with_sense_payload"), F.count_if(F.col("h").isNull()).alias("definition_words_as_label_only_nodes"))
    rows = senses.agg(F.count("*").alias("sense_rows")).withColumn("vector_bytes", F.col("sense_rows") * vector_bytes)
    return heads.agg(F.count("*").alias("headwords")).join(rows).join(left).withColumn("vector_gib", F.col("vector_bytes") / F.lit(float(1 << 30)))


def label_only_words(senses: DataFrame, k: int = 1000) -> DataFrame:
    """(word, frequency): the k most used definition words that have no sense of their own."""
    heads = normalized(senses.select("surface"), "surface", "word")
    return most_frequent_missing(heads, definition_word_counts(senses), k)


def source_counts(records: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """(per-source sense rows and headwords, per-source k most frequent domains) of canonical records."""
    rows = normalized(records, "surface")
    counts = rows.groupBy("source").agg(F.count("*").alias("sense_rows"), F.count_distinct("normalized").alias("unique_headwords"))
    domains = records.select("source", F.explode("domains").alias("domain")).groupBy("source", "domain").agg(F.count("*").alias("n"))
    top = Window.partitionBy("source").orderBy(F.desc("n"), "domain")
    return counts, domains.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def contiguous(df: DataFrame, number: str, by: list[str] | None = None, start: int = 0) -> DataFrame:
    """Per group: whether the numbers are dense from ``start`` (count, least, largest, all distinct)."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    out = grouped.agg(F.count("*").alias("rows"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.count_distinct(number).alias("d"))
    ok = (F.col("rows") == F.col("d")) & (F.col("lo") == start) & (F.col("hi") == F.col("rows") + start - 1)
    return out.select(*(by or []), "rows", F.coalesce(ok, F.col("rows") == 0).alias("contiguous"))


def contract_mismatches(recorded: DataFrame, actual: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """Rows of a full outer join on the key where recorded and actual values differ or one is missing."""
    a, b = recorded.select(key, F.col(value).alias("recorded")), actual.select(key, F.col(value).alias("actual"))
    return a.join(b, key, "full").where(~F.col("recorded").eqNullSafe(F.col("actual")))


def literal_words(spark: SparkSession, found: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(found)), "ordinal long, surface string")


def excluded_sense(tags: Column, form_of: Column, alt_of: Column) -> Column:
    """Whether a sense is only a pointer to another word or has an excluded tag."""
    tagged = F.arrays_overlap(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.btrim(t))), F.array(*map(F.lit, EXCLUDED_TAGS)))
    return tagged | (F.coalesce(F.size(form_of), F.lit(0)) > 0) | (F.coalesce(F.size(alt_of), F.lit(0)) > 0)


# Tags of senses that define no word of their own.
EXCLUDED_TAGS = ("abbreviation", "alt-of", "alternative", "character", "form-of", "misspelling", "no-gloss", "romanization", "translation-hub")
