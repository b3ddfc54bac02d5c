"""Tables that are folders of files, and pages with open character references."""

from __future__ import annotations

import pytest

from weftlex import plans
from weftlex.functions import text as T

from conftest import sql_rows, rows_of


@pytest.mark.parametrize("name", ["stream_dedup", "stream_ngram_counts"])
def test_streams_read_a_table_of_several_files(name, spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES[name](spark, str(tmp_path))
    assert rows_of(got) == sql_rows(plans.SQL[name], sf_dir, got.columns)


def test_open_references_stay_text_in_pages(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(0, "a&amp</title> b"), (1, "x &ampy; &copy 1 &#38 &amp;lt;"), (2, "&lt;p&gt; &#39;q&#x27; &quot;r&quot; &amp;&amp;"), (3, "&nosuch; &&;")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    cleaned = {r.page_id: r.c for r in df.select("page_id", T.clean_text(F.col("html"), closed=True).alias("c")).collect()}
    assert cleaned == {0: "a&amp</title> b", 1: "x &ampy; &copy 1 &#38 &lt;", 2: "<p> 'q' \"r\" &&", 3: "&nosuch; &&;"}
    spark.read.parquet(f"{tmp_path}/p").write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = plans.QUERIES["clean_pages"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(plans.SQL["clean_pages"]).fetchall())


def test_alignment_gives_words_in_bounded_batches(spark):
    import pyarrow as pa
    from weftlex.operators import align

    class Docs:
        schema = spark.createDataFrame([], "id long, text string").schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    run = align.aligned(Docs(), "id")
    texts = ["one two three"] * 5000 + [None, "last"]
    out = list(run(iter([pa.record_batch({"id": list(range(len(texts))), "text": texts})])))
    assert max(b.num_rows for b in out) <= 4200 and sum(b.num_rows for b in out) == 15001
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["surface"] for r in rows[3:6]] == ["one", "two", "three"] and rows[-1]["id"] == 5001 and rows[5]["id"] == 1
