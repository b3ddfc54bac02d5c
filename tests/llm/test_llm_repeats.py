"""Repeated and null ids, and texts wrapped at any width."""

from __future__ import annotations

import textwrap

import pytest
from conftest import rows_of

from weftlex.llm import licences, sharding, warc


def test_equal_rows_of_one_id_are_split_among_shards(spark):
    rows = [(7, "one text that comes again and again")] * 4000 + [(None, "another of no id")] * 2000 + [(i, f"text {i} of its own words") for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = {r.shard: (r["sum(size)"], r["count(1)"], r["max(slot)"], r["count(DISTINCT slot)"]) for r in got.groupBy("shard").agg({"size": "sum"}).join(got.groupBy("shard").agg({"*": "count", "slot": "max"}), "shard").join(got.selectExpr("shard", "slot").distinct().groupBy("shard").agg({"slot": "count"}).withColumnRenamed("count(slot)", "count(DISTINCT slot)"), "shard").collect()}
    mean = sum(s[0] for s in sizes.values()) / 40
    assert len(sizes) == 40 and sum(s[1] for s in sizes.values()) == 8000
    assert max(s[0] for s in sizes.values()) < 1.2 * mean and min(s[0] for s in sizes.values()) > 0.8 * mean
    assert all(n == last + 1 == places for _, n, last, places in sizes.values())


def test_null_page_ids_keep_their_record_types(spark):
    long, other = "x" * 2000, "y" * 1500
    rows = [(None, "u", "short"), (None, "u", None), (1, "u", long), (9, "v", long), (None, "w", long), (None, "w", other), (None, "w", other), (9, "v", long), (3, "a", "z" * 1000), (4, "b", "z" * 1000)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), null_ids=True).collect()
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got)
    assert found == sorted(
        [(0, 5, "response", 0), (0, 0, "response", 0), (1, 2000, "revisit", 9), (9, 2000, "response", 0), (9, 2000, "response", 0), (0, 2000, "revisit", 9)]
        + [(0, 1500, "response", 0)] * 2
        + [(3, 1000, "revisit", 4), (4, 1000, "response", 0)]
    )


def test_null_page_ids_in_sql(spark, tmp_path, same_as_sql):
    rows = [(None, "u", "short"), (1, "u", "x" * 2000), (9, "v", "x" * 2000), (None, "w", "x" * 2000), (None, "w", "y" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    names = sorted(warc.round_trip(pages, null_ids=True).columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({warc.SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in warc.round_trip(pages, null_ids=True).select(*names).collect())


@pytest.mark.parametrize("notice", ["Copyright (c) 2019 Some Person", "Copyright 2019 Some Person. All rights reserved.", "© Some Person"])
def test_licences_wrapped_at_any_width(spark, notice):
    docs = []
    for name, title, text in [(n, t[0], x) for n, x, t in licences._TITLED if t]:
        for width in range(50, 91):
            whole = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            docs.append((name, width, f"{title}\n\n{notice}\n\n{whole}"))
    rows = spark.createDataFrame([(i, d[2]) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.whole_licence for r in licences.scan(rows).collect()}
    assert [(d[0], d[1]) for i, d in enumerate(docs) if got[i] != d[0]] == []
