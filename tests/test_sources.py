"""Readers, writers, manifests and streams on temporary files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftlex.sources import files, lexicons
from weftlex.streaming import corpus as stream


def test_lexicon_xml(spark, tmp_path):
    xml = """<?xml version="1.0"?><LexicalResource xmlns:dc="http://purl.org/dc/elements/1.1/"><Lexicon>
<LexicalEntry id="e1"><Lemma writtenForm="fox" partOfSpeech="n"/><Sense id="s1" synset="y1"/><Sense id="s2" synset="none"/></LexicalEntry>
<LexicalEntry id="e2"><Lemma writtenForm="red fox" partOfSpeech="n"/><Sense id="s3" synset="y1"/></LexicalEntry>
<Synset id="y1"><Definition>a  small
 canine</Definition><Example>the fox ran</Example></Synset></Lexicon></LexicalResource>"""
    with gzip.open(tmp_path / "x.xml.gz", "wt") as f:
        f.write(xml)
    (r,) = lexicons.read_source(spark, str(tmp_path / "x.xml.gz"), lexicons.Source("lex", "lexicon_xml", "2024")).collect()
    assert (r.surface, r.part_of_speech, r.definition, r.source, r.source_sense_key, r.examples) == ("fox", "n", "a small canine", "lex:2024", "s1", ["the fox ran"])


def test_wiki_jsonl(spark, tmp_path):
    rows = [
        {"word": "fox", "lang_code": "en", "pos": "noun", "pageid": 7, "senses": [{"glosses": ["animal", "a canine"], "topics": ["Zoology", "art"], "examples": [{"text": "a fox"}, "plain"]}, {"glosses": ["x"], "form_of": [{"word": "y"}]}, {"glosses": [" "]}, {"glosses": ["z"], "tags": ["Misspelling"]}]},
        {"word": "renard", "lang_code": "fr", "senses": [{"glosses": ["fox"]}]},
        {"word": "two words", "lang_code": "en", "senses": [{"glosses": ["x"]}]},
    ]
    with gzip.open(tmp_path / "w.jsonl.gz", "wt") as f:
        f.write("\n\n".join(json.dumps(r) for r in rows))
    (r,) = lexicons.read_wiki_jsonl(spark, str(tmp_path / "w.jsonl.gz"), lexicons.Source("w", "wiki_jsonl", "1")).collect()
    assert (r.surface, r.definition, r.domains, r.examples) == ("fox", "a canine", ["art", "zoology"], ["a fox", "plain"])
    assert r.source_sense_key.startswith("7:noun:0:")


def test_headings_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text("""<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><ConceptList><Concept><ConceptUI>M1</ConceptUI><ScopeNote> a note </ScopeNote><TermList><Term><TermUI>T1</TermUI><String>Fever</String></Term><Term><TermUI>T2</TermUI><String>High Fever</String></Term></TermList></Concept><Concept><ConceptUI>M2</ConceptUI><TermList><Term><TermUI>T3</TermUI><String>Heat</String></Term></TermList></Concept></ConceptList></DescriptorRecord></Set>""")
    (r,) = lexicons.read_headings_xml(spark, str(tmp_path / "m.xml"), lexicons.Source("m", "headings_xml", "1")).collect()
    assert (r.surface, r.definition, r.source_sense_key) == ("Fever", "a note", "D1:M1:T1")


def test_unknown_parser_and_snapshot(spark):
    spec = lexicons.Source("x", "nothing", "2024-02-03")
    with pytest.raises(ValueError):
        lexicons.read_source(spark, "/none", spec)
    page = spark.createDataFrame([("Extracted from the\nenwiktionary dump <b>dated 2024-02-03</b>",)], "html string")
    lexicons.verify_snapshot(page, "html", spec)
    with pytest.raises(RuntimeError):
        lexicons.verify_snapshot(page, "html", lexicons.Source("x", "n", "2020-01-01"))


def test_supplement(spark):
    rows = spark.createDataFrame([(0, "fox", "noun", "an animal", "k1"), (1, "fox", "verb", "to trick", "k2")], "ordinal long, word string, pos string, definition string, sense_key string")
    spec = lexicons.Source("reviewed", "x", "1")
    assert {r.source_sense_key for r in lexicons.reviewed_supplement(rows, spec).collect()} == {"k1", "k2"}
    with pytest.raises(PySparkException):
        lexicons.reviewed_supplement(rows.withColumn("word", F.lit("two words")), spec).collect()


def test_jsonl_and_lines(spark, tmp_path):
    (tmp_path / "mine.jsonl").write_text('{"word": "a", "gloss": "b"}\n\n{"word": "c", "gloss": "d", "source": "s"}\n')
    got = files.read_definitions(spark, str(tmp_path / "mine.jsonl")).orderBy("ordinal").collect()
    assert [r.source for r in got] == ["mine", "s"]
    both = files.read_lines(spark, [str(tmp_path / "mine.jsonl")], ["x"], "word")
    assert sorted(r.text for r in both.collect()) == ["a", "c", "x"]
    (tmp_path / "bad.jsonl").write_text("not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "word string").collect()


def test_ranked_files(spark, tmp_path):
    ranked = spark.createDataFrame([("b c", 3, 2, 1), ("é f", 1, 2, 2)], files.NGRAM)
    files.write_ranked(ranked, str(tmp_path / "r"))
    back = spark.read.schema(files.NGRAM).json(str(tmp_path / "r"))
    assert sorted(back.select(*ranked.columns).collect()) == sorted(ranked.collect())
    assert files.top_rows(ranked, 2, 2).count() == 2
    with pytest.raises(ValueError):
        files.top_rows(ranked, 2, 3)


def test_bank(spark, tmp_path):
    bank = spark.createDataFrame([("b", i, [float(i)] * 2) for i in range(5)], "bank_name string, row_index long, v array<double>")
    files.write_bank(bank, str(tmp_path / "bank"), 2)
    back = spark.read.parquet(str(tmp_path / "bank"))
    want = spark.createDataFrame([("b", 2)], "bank_name string, row_index long")
    r = files.read_rows(back, want).first()
    assert (r.shard_index, r.local_row, r.v) == (1, 0, [2.0, 2.0])
    with pytest.raises(PySparkException):
        files.read_rows(back, spark.createDataFrame([("b", 9)], "bank_name string, row_index long")).collect()
    with pytest.raises(PySparkException):
        files.checked_width(bank, "v", 3).collect()


def test_manifest_and_reuse(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert files.reuse_or_build(spark, str(tmp_path / "m"), str(tmp_path / "d"), {"v": 1}, build).count() == 5
    assert len(calls) == 1
    files.reuse_or_build(spark, str(tmp_path / "m"), str(tmp_path / "d"), {"v": 2}, build)
    assert len(calls) == 2
    (tmp_path / "d" / "part-more").write_bytes(b"x")
    assert not files.manifest_problems(spark, str(tmp_path / "m"), str(tmp_path / "d"), {"v": 2}).isEmpty()


def test_order_and_upserts(spark):
    order = [r.id for r in files.reproducible(spark.range(20), "id").orderBy("pos").collect()]
    again = [r.id for r in files.reproducible(spark.range(20), "id", skip=5).orderBy("pos").collect()]
    assert sorted(order) == list(range(20)) and again == order[5:]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in files.last_written(rows, "k", "o").collect()} == {"a": "y", "b": "z"}


def test_streams_resume(spark, tmp_path):
    src, schema = tmp_path / "in", "doc_id bigint, text string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    add([(1, "a b a b"), (2, "x y"), (3, "x y")])
    for turn in range(2):
        docs = stream.document_stream(spark, str(src), schema)
        stream.write_once(stream.deduplicated(docs), str(tmp_path / "out"), str(tmp_path / "ck1")).awaitTermination()
        stream.partial_counts(docs, 2, str(tmp_path / "counts"), str(tmp_path / "ck2")).awaitTermination()
        stream.append_word_units(docs, str(tmp_path / "units"), str(tmp_path / "ck3"), "doc_id").awaitTermination()
        if turn == 0:
            add([(4, "x y"), (5, "c a b")])
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a b a b", "c a b", "x y"]
    counts = {r.text: r.n for r in spark.read.parquet(str(tmp_path / "counts")).groupBy("text").agg(F.sum("frequency").alias("n")).collect()}
    assert counts == {"a b": 3, "b a": 1, "x y": 3, "c a": 1}
    units = {r.surface: r.word_id for r in spark.read.parquet(str(tmp_path / "units")).collect()}
    assert units == {"a": 1, "b": 2, "x": 3, "y": 4, "c": 5}


def test_state_is_bound(spark, tmp_path):
    stream.bind(spark, f"file://{tmp_path}/s", {"n": 2})
    stream.bind(spark, f"file://{tmp_path}/s", {"n": 2})
    with pytest.raises(ValueError):
        stream.bind(spark, f"file://{tmp_path}/s", {"n": 3})
    with pytest.raises(RuntimeError):
        stream.require_budget(spark.createDataFrame([("a", 3)], "source string, tokens long"), {"a": 5})
