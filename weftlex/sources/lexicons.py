"""Dictionary sources: lexicon XML, extracted wiki JSON lines, subject-heading XML, and their catalog.

Each parser is a function from a path and a source row to canonical records;
``PARSERS`` finds them by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.dictionary import excluded_sense

# Fixed value: the columns of a canonical record, in order.
RECORD = "surface string, part_of_speech string, definition string, source string, source_sense_key string, examples array<string>, domains array<string>, source_version string, source_page string, license_name string, license_url string"


@dataclass(frozen=True)
class Source:
    source_id: str
    parser: str
    version: str
    page: str = ""
    license_name: str = ""
    license_url: str = ""


# The public lexicons that dictionaries are compiled from.
SOURCES: tuple[Source, ...] = (
    Source("open_english_wordnet_plus", "lexicon_xml", "2025+", "https://en-word.net/downloads", "WordNet License + CC BY 4.0", "https://github.com/globalwordnet/english-wordnet/blob/main/LICENSE.md"),
    Source("english_wiktionary", "wiki_jsonl", "2026-07-06", "https://kaikki.org/dictionary/rawdata.html", "CC BY-SA 4.0 + GFDL", "https://en.wiktionary.org/wiki/Wiktionary:Copyrights"),
    Source("mesh_descriptors", "headings_xml", "2026", "https://www.nlm.nih.gov/databases/download/mesh.html", "NLM MeSH Terms and Conditions", "https://www.nlm.nih.gov/databases/download/terms_and_conditions_mesh.html"),
    Source("mesh_supplementary_concepts", "headings_xml", "2026", "https://www.nlm.nih.gov/databases/download/mesh.html", "NLM MeSH Terms and Conditions", "https://www.nlm.nih.gov/databases/download/terms_and_conditions_mesh.html"),
)


def catalog(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The sources as a small table."""
    return spark.createDataFrame([(s.source_id, s.parser, s.version, s.page, s.license_name, s.license_url) for s in sources], "source_id string, parser string, version string, source_page string, license_name string, license_url string")


def _canonical(df: DataFrame, spec: Source, surface: Column, pos: Column, definition: Column, key: Column, examples: Column | None = None, domains: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    tidy = lambda a: F.filter(F.transform(F.coalesce(a, none), T.collapse), lambda x: x != "")
    df = df.select(
        surface.alias("surface"),
        F.coalesce(pos, F.lit("")).alias("part_of_speech"),
        T.collapse(definition).alias("definition"),
        F.lit(f"{spec.source_id}:{spec.version}").alias("source"),
        key.alias("source_sense_key"),
        (tidy(examples) if examples is not None else none).alias("examples"),
        (F.array_sort(F.array_distinct(F.transform(tidy(domains), lambda x: F.lower(x)))) if domains is not None else none).alias("domains"),
        F.lit(spec.version).alias("source_version"),
        F.lit(spec.page).alias("source_page"),
        F.lit(spec.license_name).alias("license_name"),
        F.lit(spec.license_url).alias("license_url"),
    )
    return df.where("surface IS NOT NULL AND definition <> ''")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("mode", "FAILFAST").schema(schema).load(path)


def read_lexicon_xml(spark: SparkSession, path: str, spec: Source) -> DataFrame:
    """One record for each sense of a single-word lexical entry whose synset has a definition."""
    entries = _xml(spark, path, "LexicalEntry", "_id string, Lemma struct<_writtenForm:string,_lemma:string,_partOfSpeech:string>, Sense array<struct<_id:string,_synset:string>>")
    synsets = _xml(spark, path, "Synset", "_id string, Definition array<string>, Example array<string>")
    first = F.get(F.filter(F.transform("Definition", T.collapse), lambda x: x != ""), F.lit(0))
    defined = synsets.select(F.col("_id").alias("synset"), first.alias("definition"), F.col("Example").alias("examples")).where("synset <> '' AND definition IS NOT NULL")
    surface = T.single_word(F.coalesce("Lemma._writtenForm", "Lemma._lemma"))
    senses = entries.select(F.coalesce("_id", surface).alias("entry"), surface.alias("surface"), F.col("Lemma._partOfSpeech").alias("pos"), F.explode("Sense").alias("s"))
    senses = senses.where("surface IS NOT NULL").select("entry", "surface", "pos", F.col("s._id").alias("sense"), F.col("s._synset").alias("synset"))
    both = senses.join(defined, "synset")
    key = F.coalesce(F.nullif("sense", F.lit("")), F.concat_ws(":", "entry", "synset"))
    return _canonical(both, spec, F.col("surface"), F.col("pos"), F.col("definition"), key, F.col("examples"))


_WIKI = "word string, lang_code string, pos string, pageid string, id string, etymology_number int, senses array<struct<id:string,senseid:string,glosses:array<string>,tags:array<string>,topics:array<string>,categories:array<string>,examples:array<string>,form_of:array<string>,alt_of:array<string>>>"


def read_wiki_jsonl(spark: SparkSession, path: str, spec: Source, language: str = "en") -> DataFrame:
    """One record for each defining sense of a single-word entry of one language.

    Nested values that come as text or as objects are read as text and told
    apart by their first character.  The last gloss defines; a sense that only
    points to another word, or has an excluded tag, is left out.
    """
    df = spark.read.schema(_WIKI).option("mode", "FAILFAST").json(path).where(F.col("lang_code") == language)
    df = df.select(T.single_word(F.col("word")).alias("surface"), F.btrim(F.coalesce("pos", F.lit(""))).alias("pos"), F.coalesce("pageid", "id", F.lit("")).alias("page"), F.coalesce("etymology_number", F.lit(0)).alias("etymology"), F.posexplode("senses").alias("i", "s"))
    df = df.where("surface IS NOT NULL").where(~excluded_sense(F.col("s.tags"), F.col("s.form_of"), F.col("s.alt_of")))
    gloss = F.element_at(F.filter(F.transform("s.glosses", T.collapse), lambda x: x != ""), -1)
    df = df.where(F.size(F.filter(F.transform("s.glosses", T.collapse), lambda x: x != "")) > 0).withColumn("definition", gloss)
    text = lambda e: F.when(F.startswith(F.ltrim(e), F.lit("{")), F.coalesce(F.nullif(F.get_json_object(e, "$.text"), F.lit("")), F.get_json_object(e, "$.english"))).otherwise(e)
    examples = F.filter(F.transform(F.coalesce("s.examples", F.array().cast("array<string>")), text), lambda x: x.isNotNull())
    lowered = F.replace(F.lower("surface"), F.lit("ß"), F.lit("ss"))
    digest = F.substring(F.sha2(F.concat_ws(T.UNIT, lowered, "pos", F.col("etymology").cast("string"), "definition"), 256), 1, 24)
    derived = F.concat(F.col("page"), F.lit(":"), F.col("pos"), F.lit(":"), F.col("i").cast("string"), F.lit(":"), digest)
    key = F.coalesce(F.nullif(F.col("s.id"), F.lit("")), F.nullif(F.col("s.senseid"), F.lit("")), derived)
    none = F.array().cast("array<string>")
    return _canonical(df, spec, F.col("surface"), F.col("pos"), F.col("definition"), key, examples, F.concat(F.coalesce("s.topics", none), F.coalesce("s.categories", none)))


_CONCEPTS = "ConceptList struct<Concept:array<struct<ConceptUI:string,ScopeNote:string,TermList:struct<Term:array<struct<TermUI:string,String:string>>>>>>"
_HEADINGS = (("DescriptorRecord", "DescriptorUI"), ("SupplementalRecord", "SupplementalRecordUI"), ("QualifierRecord", "QualifierUI"))


def read_headings_xml(spark: SparkSession, path: str, spec: Source) -> DataFrame:
    """One record for each single-word term of a concept that has a scope note, over three kinds of headings."""
    out = None
    for tag, ui in _HEADINGS:
        df = _xml(spark, path, tag, f"{ui} string, {_CONCEPTS}").select(F.coalesce(F.col(ui), F.lit("")).alias("record"), F.explode("ConceptList.Concept").alias("c"))
        df = df.where("trim(c.ScopeNote) <> ''").select("record", F.coalesce("c.ConceptUI", F.lit("")).alias("concept"), F.col("c.ScopeNote").alias("note"), F.explode("c.TermList.Term").alias("t"))
        surface = T.single_word(F.col("t.String"))
        joined = F.concat_ws(":", *(F.nullif(F.btrim(x), F.lit("")) for x in (F.col("record"), F.col("concept"), F.col("t.TermUI"))))
        key = F.coalesce(F.nullif(joined, F.lit("")), F.substring(F.sha2(F.concat_ws(T.UNIT, surface, T.collapse(F.col("note"))), 256), 1, 24))
        part = _canonical(df, spec, surface, F.lit("noun"), F.col("note"), key)
        out = part if out is None else out.unionByName(part)
    return out


PARSERS: dict[str, Callable[[SparkSession, str, Source], DataFrame]] = {"lexicon_xml": read_lexicon_xml, "wiki_jsonl": read_wiki_jsonl, "headings_xml": read_headings_xml}


def read_source(spark: SparkSession, path: str, spec: Source) -> DataFrame:
    """Canonical records by the source's parser; an unknown parser raises."""
    if spec.parser not in PARSERS:
        raise ValueError(f"unknown parser: {spec.parser}")
    return PARSERS[spec.parser](spark, path, spec)


def reviewed_supplement(records: DataFrame, spec: Source) -> DataFrame:
    """Canonical records of a reviewed list; a headword that is not one word raises."""
    from ..operators.dictionary import candidates

    found = candidates(records, spec.source_id)
    surface = F.coalesce(T.single_word(F.col("surface")), F.raise_error(F.concat(F.lit("not one word: "), F.col("surface"))).cast("string"))
    return _canonical(found, spec, surface, F.col("part_of_speech"), F.col("definition"), F.col("source_sense_key"), F.col("examples"))


def verify_snapshot(page: DataFrame, column: str, spec: Source) -> None:
    """Raise unless the page says that its dump is of the source's version."""
    found = page.select(T.snapshot_date(F.col(column)).alias("d")).where("d <> ''").first()
    if found is None or found.d != spec.version:
        raise RuntimeError(f"snapshot is {found.d if found else 'unknown'}, {spec.version} is expected")
