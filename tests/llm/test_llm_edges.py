"""Nulls, empty and long texts, repeats, clashing columns and empty tables for every operator."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from weftlex.llm import bpe, jaccard_join, licences, line_rules, pii, quality, queries, secrets, sharding, tiling, warc

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 40_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "en", "s", 27), (2, None, None, None, None), (3, "", "en", "s", 0), (4, LONG, "en", "s", len(LONG)), (5, "one two three four five six", "en", "s", 27), (5, "one two three four five six", "en", "s", 27), (None, "x", "en", "s", 1), (6, " \n\t ", "en", "s", 4), (7, "a" * 300_000, "fr", "s", 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("id", "n", "sig", "toks", "bucket", "item", "h", "size", "words", "lines", "digest", "unit", "licence", "tok", "rep", "pivot", "spans", "count")
    return df.withColumns({c: F.lit("clash") for c in names})


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_pii_edges(docs):
    got = by_id(pii.find_pii(docs))
    assert len(got) == 9 and all(r["spans"] == "" and r["n_email"] == 0 for r in got)
    assert len({r["base_sha256"] for r in got}) == 1
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == 9


def test_sharding_edges(docs):
    got = by_id(sharding.shard(docs, 4))
    assert len(got) == 9 and got[1]["size"] == 16 and got[1]["text_crc32"] == 0
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_licence_edges(docs):
    got = by_id(licences.scan(docs))
    assert len(got) == 9 and all(r["licences"] == "" and r["whole_licence"] is None for r in got)


def test_secret_edges(docs):
    got = by_id(secrets.find_secrets(docs))
    assert len(got) == 9 and got[1]["spans"] == "" and {r["n_assign"] for r in got} == {0}


def test_tiling_edges(spark, docs):
    items = spark.createDataFrame([(1, "three four five six seven eight nine"), (2, None), (3, "tiny item"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in tiling.contaminated(docs, items).collect())
    assert got == [(1, 4), (1, 5), (5, 4), (5, 4), (5, 5), (5, 5)]
    left = tiling.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == 6
    assert tiling.contaminated(docs, items.limit(0)).count() == 0


def test_jaccard_edges(docs):
    got = by_id(jaccard_join.jaccard_components(docs))
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (5, 1), (6, 6), (7, 7), (None, None)]
    assert [r["n_shingles"] for r in got] == [2, 0, 0, 8, 2, 2, 0, 1, 1]
    kept = by_id(jaccard_join.keep_one(docs))
    assert [r["doc_id"] for r in kept] == [1, 2, 3, 4, 6, 7, None] and set(kept[0]) == set(docs.columns)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = by_id(quality.classify(docs, labels))
    assert len(got) == 9 and all(r["kept"] and r["score"] is None for r in got)  # one class only: nothing to learn
    assert quality.keep_good(docs, labels).count() == 9


def test_rule_edges(docs):
    got = by_id(line_rules.apply_rules(docs, with_text=True))
    assert len(got) == 9 and got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[3]["n_words"] == got[3]["n_repeat_words"] == 320_000


def test_bpe_edges(docs):
    got = by_id(bpe.encode(docs))
    assert len(got) == 9 and got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["ids"] == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id IN (1, 4, 7)"))).collect()}
    assert back[4] == LONG and back[7] == "a" * 300_000 and back[1] == "one two three four five six"


def test_warc_edges(spark):
    big = "<p>" + "é" * 200_000
    pages = spark.createDataFrame([(1, "http://a/", big, "x"), (2, None, None, "x"), (3, "http://b\r\n/", big, "x"), (9, "u", "", "x"), (4, "u", "short", "x"), (5, "u", "short", "x"), (None, "u", "lost", "x")], "page_id long, url string, html string, body string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 9]
    assert (got[3].record_type, got[3].refers_to, got[1].record_type, got[1].refers_to) == ("response", None, "revisit", 3)
    assert got[1].payload_bytes == got[3].payload_bytes == len(big.encode()) and got[2].payload_bytes == 0
    assert got[4].record_type == got[5].record_type == "response"


def test_warc_has_a_record_for_each_row(spark, tmp_path):
    a, b, c = "<p>" + "a" * 120_000, "<p>" + "b" * 120_000, "<p>" + "c" * 90_000
    rows = [(1, "u", a), (1, "u", b), (1, "v", b), (1, "u", c), (2, "u", a), (3, "u", "x"), (3, "u", "x"), (3, "u", "y"), (4, "u", b), (4, "u", b), (None, "u", a), (None, "u", "lost"), (None, "u", "lost"), (None, "u", c + "c"), (0, "u", c)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op7_warc(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.SQL["op7_warc"])
    key = lambda r: tuple(map(str, r))
    assert len(want.fetchall()) == len(rows)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_warc_payload_digest_is_verified(spark):
    body = b"x" * 5000
    rows = [warc._row(f, b) for f, b in warc.parse(b"".join(warc.records(1, "u", body, None, "0" * 40, segment=1000)))]
    df = spark.createDataFrame([(r[4], r[5], r[6], bytearray(r[7]), r[3]) for r in rows], "origin string, segment int, total long, block binary, digest string")
    with pytest.raises(Exception, match="stated"):
        warc.reassembled(df).collect()


@pytest.mark.parametrize("run", [pii.find_pii, sharding.shard, licences.scan, secrets.find_secrets, jaccard_join.jaccard_components, line_rules.apply_rules, bpe.encode, pii.redact, jaccard_join.keep_one])
def test_empty_table(run, docs):
    assert run(docs.limit(0)).count() == 0


def test_empty_tables_of_two(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs.limit(0), labels).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
