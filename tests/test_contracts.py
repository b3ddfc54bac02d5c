"""Contracts, selectors, settings and the download utility."""

from __future__ import annotations

import hashlib
import http.server
import struct
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftlex.operators import contracts as X
from weftlex.sources import files
from weftlex.sources.download import download


def test_checked_keys(spark):
    good = spark.createDataFrame([(2, 0), (2, 1)], "n int, row_index long")
    assert X.checked_keys(good, 2).count() == 2
    for bad in (good.withColumn("n", F.lit(3)), good.withColumn("row_index", F.col("row_index") + 1)):
        with pytest.raises(ValueError):
            X.checked_keys(bad, 2)


def test_dictionary_constraints(spark, tmp_path):
    words = spark.createDataFrame([(0, "a", "a"), (1, "b", "b")], "word_id long, surface string, normalized string")
    senses = spark.createDataFrame([(0, 0, "def")], "sense_row long, word_id long, definition string")
    edges = spark.createDataFrame([(0, 0, 1)], "sense_row long, position int, definition_word_id long")
    X.write_dictionary(words, senses, edges, str(tmp_path / "d"))
    X.write_inventory(words, senses, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "words")).count() == 2
    assert X.dictionary_records(senses, words).first().surface == "a"
    with pytest.raises(ValueError, match="edges have words"):
        X.write_dictionary(words, senses, edges.withColumn("definition_word_id", F.lit(9)), str(tmp_path / "e"))


def test_index_table_is_bucketed(spark):
    rows = spark.createDataFrame([(2, "a b", 0)], "word_order int, k string, row_index long")
    X.write_index(rows, "weftlex_index_test", ["word_order", "k"], 4)
    plan = spark.table("weftlex_index_test").join(spark.table("weftlex_index_test"), ["word_order", "k"])
    assert plan.count() == 1
    spark.sql("DROP TABLE weftlex_index_test")


def test_anchor_pairs(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, v array<double>")
    assert X.anchor_pairs(a, a, "id", "v").count() == 2
    with pytest.raises(PySparkException):
        X.anchor_pairs(a, a.where("id = 1"), "id", "v").collect()


def test_digests_and_fingerprints(spark):
    r = spark.range(1).select(X.tuple_hash(F.encode(F.lit("x"), "UTF-8"), b"p").alias("h"), X.word_tuple_key(F.array(F.lit("a"), F.lit("é"))).alias("k")).first()
    assert bytes(r.h) == hashlib.blake2b(b"x", digest_size=16, person=b"p").digest()
    assert bytes(r.k).decode() == '["a","é"]'
    p = spark.createDataFrame([(1, 0), (0, 0), (2, 1)], "raw_token_id long, canonical_token_id long")
    assert X.projection_fingerprint(p, "v1") == hashlib.sha256(b"v1\0" + struct.pack("<3I", 0, 0, 1)).hexdigest()
    one = X.vocabulary_fingerprint({"a": 0, "b": 1}, "t")
    assert one == X.vocabulary_fingerprint({"b": 1, "a": 0}, "t") != X.vocabulary_fingerprint({"b": 1, "a": 0}, "t", [1])


def test_tokenizer_contract(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "vocab.txt").write_text("a b")
    made = X.tokenizer_contract({"id": "chars"}, lambda s: [ord(c) for c in s], ["ab"], files.file_hashes(spark, str(tmp_path / "f")))
    assert made["samples"]["ab"] == {"bos": [97, 98], "internal": [32, 97, 98]}
    X.validate_contract(spark, made, str(tmp_path / "f"))
    with pytest.raises(ValueError):
        X.validate_contract(spark, made | {"id": "other"})
    (tmp_path / "f" / ".vocab.txt.crc").unlink(missing_ok=True)
    (tmp_path / "f" / "vocab.txt").write_text("changed")
    with pytest.raises(ValueError):
        X.validate_contract(spark, made, str(tmp_path / "f"))


def test_settings():
    s = X.Settings.of({"width": 32, "hash_rows": [8, 16], "unknown": 1})
    assert s.width == 32 and s.hash_rows == (8, 16)
    for bad in ({"width": 63}, {"rounds": 0}, {"nearest": 9}, {"hash_rows": [1]}):
        with pytest.raises(ValueError):
            X.Settings.of(bad)


def test_layer_choice(spark):
    df = spark.createDataFrame([("m.layers.3.q_proj.w",), ("layer.12.up",), ("embed",)], "k string").withColumn("l", X.layer_of(F.col("k")))
    got = df.select("l", X.selected_layers(" 1, 3-4 ", F.col("l")).alias("a"), X.selected_layers("all", F.col("l")).alias("b"), X.has_module(F.col("k"), "q_proj").alias("m")).collect()
    assert [tuple(r) for r in got] == [(3, True, True, True), (12, False, True, False), (None, None, False, False)]


def test_download_resumes(tmp_path):
    data = bytes(range(256)) * 400
    cut = {"on": True}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = int((self.headers.get("Range") or "bytes=0-").split("=")[1].split("-")[0])
            self.send_response(206 if at else 200)
            self.send_header("Content-Length", str(len(data) - at))
            self.end_headers()
            body = data[at:]
            self.wfile.write(body[: len(body) // 2] if cut.pop("on", False) else body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out = download(f"http://127.0.0.1:{server.server_port}/x", str(tmp_path / "x"), wait=0.01)
    server.shutdown()
    assert open(out, "rb").read() == data and not (tmp_path / "x.part").exists()
