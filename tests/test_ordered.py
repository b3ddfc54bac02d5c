"""The buffer-shuffled stream, counts by checkpoints, and the record store."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftlex.sources import ordered, store
from weftlex.streaming import corpus as stream


def plain(total: int, buffer: int, seed: int):
    """The shuffle as a loop over rows with a buffer in memory."""
    held, steps = list(range(min(buffer, total))), max(0, total - buffer)
    buffer = len(held)
    for i in range(steps):
        s = ordered.mixed(i, seed) % buffer
        yield held[s]
        held[s] = buffer + i
    for s in sorted(range(buffer), key=lambda s: (ordered.mixed(steps + s, seed), s)):
        yield held[s]


@pytest.mark.parametrize("total,buffer", [(0, 5), (1, 5), (5, 5), (6, 5), (500, 1), (3000, 64), (3000, 5000)])
def test_positions_equal_a_loop(total, buffer):
    want = list(plain(total, buffer, 42))
    assert sorted(want) == list(range(total))
    assert ordered.rows_at(0, total, total, buffer).tolist() == want
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = sorted(rng.integers(0, total + 1, 2).tolist())
        assert ordered.rows_at(a, b, total, buffer).tolist() == want[a:b]


def test_seed_and_spread():
    a, b = ordered.rows_at(0, 50_000, 50_000, 10_000, 1), ordered.rows_at(0, 50_000, 50_000, 10_000, 2)
    assert (a != b).mean() > 0.9
    held = np.bincount(ordered.mixed(np.arange(100_000, dtype=np.int64), 42) % 100, minlength=100)
    assert held.min() > 800 and held.max() < 1200
    assert ordered.mixed(123_456_789_012, 7) == ordered.mixed(np.array([123_456_789_012]), 7)[0]


def test_whole_table_form(spark):
    for total, buffer in ((1, 4), (300, 16), (10, 100)):
        got = ordered.buffer_order(spark.range(total), "id", total, buffer).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(total)) and [r.id for r in got] == list(plain(total, buffer, 42))


def test_broken_off_and_resumed(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    path = f"file://{tmp_path}/order"
    total = ordered.write_order(docs, ["k"], path, block_rows=128, partitions=7)
    calls = []

    def save(batch, batch_id):
        calls.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        if calls == [0, 1, 2]:
            raise RuntimeError("lost")

    run = lambda: ordered.run_in_order(spark, path, total, f"{path}/state", save, rows=150, buffer=100, block_rows=128)
    with pytest.raises(Exception, match="lost"):
        run()
    assert ordered.progress(spark, f"{path}/state").agg(F.max("rows_seen")).first()[0] == 300
    run()
    run()
    assert calls == [0, 1, 2, 2, 3, 4, 5, 6]
    got = spark.read.parquet(f"{path}/out").orderBy("pos").collect()
    assert [r.k for r in got] == list(plain(1000, 100, 42)) and [r.pos for r in got] == list(range(1000))
    assert all(r.text == f"t{r.k}" for r in got) and {r.batch for r in got if r.pos < 150} == {0}


def test_empty_and_null_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "")], "k long, text string")
    got = ordered.ordered_rows(rows, ["k"], f"file://{tmp_path}/a").collect()
    assert sorted((r.k, r.text) for r in got) == [(1, None), (2, "")]
    assert ordered.ordered_rows(rows.limit(0), ["k"], f"file://{tmp_path}/b").collect() == []


def test_checkpointed_counts(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30))) for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(texts, "k long, text string")
    want = {}
    for _, t in texts:
        ws = (t or "").split()
        for pair in zip(ws, ws[1:]):
            want[" ".join(pair)] = want.get(" ".join(pair), 0) + 1
    path = f"file://{tmp_path}/c"
    for _ in range(2):  # the second run finds all done and counts nothing again
        got = stream.checkpointed_counts(docs, ["k"], 2, path, rows=60, keys=50, buffer=20)
        assert {r.text: r.frequency for r in got.collect()} == want
    parts = glob.glob(f"{tmp_path}/c/partials/batch=*/*.parquet")
    assert len({p.split("batch=")[1].split("/")[0] for p in parts}) == 4
    assert 0 < max(pq.read_metadata(p).num_rows for p in parts) <= 50
    with pytest.raises(ValueError):
        stream.checkpointed_counts(docs, ["k"], 3, path, rows=60, keys=50, buffer=20)


def test_checkpoints_deal_their_documents_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "DEALT_ROWS", 10, raising=False)
    docs = spark.range(400).select(F.col("id").alias("k"), F.concat_ws(" ", *(F.concat(F.lit(f"w{j}x"), F.col("id") % 37) for j in range(11))).alias("text"))
    got = stream.checkpointed_counts(docs.repartition(1), ["k"], 2, f"file://{tmp_path}/c", rows=100, buffer=20)
    assert got.agg(F.sum("frequency")).first()[0] == 4000 and got.count() == 370
    for batch in range(4):  # each of four tasks has counted 25 documents: n-grams are not shuffled for a checkpoint
        parts = glob.glob(f"{tmp_path}/c/partials/batch={batch}/*.parquet")
        assert [sum(pq.read_table(p, columns=["frequency"])["frequency"].to_pylist()) for p in parts] == [250] * 4
    assert not glob.glob(f"{tmp_path}/c/order/blocks") and not glob.glob(f"{tmp_path}/c/order/sorted")  # stored once, and dropped


def test_a_batch_reads_only_its_files(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("k"))
    path, read = f"file://{tmp_path}/order", []
    total = ordered.write_order(docs, ["k"], path, block_rows=50, partitions=4)

    def save(batch, batch_id):
        read.append(len(batch.inputFiles()))
        assert batch.count() == 100

    ordered.run_in_order(spark, path, total, f"{path}/state", save, rows=100, buffer=20, block_rows=50)
    assert len(glob.glob(f"{tmp_path}/order/sorted/*.parquet")) >= 40 and len(read) == 20 and max(read) <= 10


def test_equal_and_null_keys_over_several_files(spark, tmp_path):
    rows = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    path = f"file://{tmp_path}/order"
    assert ordered.write_order(rows, ["k"], path, block_rows=7, partitions=3) == 300
    ordered.run_in_order(spark, path, 300, f"{path}/state", lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out/batch={i}"), rows=70, buffer=1)
    got = spark.read.parquet(f"{path}/out").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(300)) and sorted(r.v for r in got) == list(range(300))
    assert [r.k for r in got] == [None] * 100 + [1] * 100 + [2] * 100  # a buffer of one keeps the order


def _records(spark, n: int):
    return spark.range(n).select(F.col("id").alias("row_index"), F.unhex(F.md5(F.col("id").cast("string"))).alias("record"))


def test_point_reads(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert store.write_shards(_records(spark, 1050), path, 16, 100).count() == 11
    hot = spark.range(3000).select(F.col("id").alias("q"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1050).alias("at"))
    got = store.read_at(spark, path, hot, "at")
    assert got.where(F.lower(F.hex("record")) != F.md5(F.col("at").cast("string"))).isEmpty() and got.count() == 3000
    for bad in ("2000", "1050", "-1", "CAST(NULL AS BIGINT)"):
        with pytest.raises(Exception, match="no such row"):
            store.read_at(spark, path, spark.range(1).select(F.expr(bad).cast("long").alias("at")), "at").collect()
    data = bytearray((tmp_path / "s" / store.shard_name(3)).read_bytes())
    data[5] ^= 1
    (tmp_path / "s" / store.shard_name(3)).write_bytes(bytes(data))
    assert store.read_at(spark, path, spark.createDataFrame([(5,)], "at long"), "at").count() == 1
    with pytest.raises(Exception, match="not the bytes"):
        store.read_at(spark, path, spark.createDataFrame([(301,)], "at long"), "at").collect()


def test_shards_are_opened_once_a_task(spark, tmp_path):
    path, log = f"file://{tmp_path}/s", str(tmp_path / "opened")
    store.write_shards(_records(spark, 400), path, 16, 100)

    def noting(p: str) -> bytes:
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()} {p}\n")
        return store.load_bytes(p)

    wanted = spark.range(2000).select(((F.col("id") * 7) % 400).alias("at"))
    parts = store.read_at(spark, path, wanted, "at", noting).withColumn("p", F.spark_partition_id()).collect()
    touched = {(r.p, r["at"] // 100) for r in parts}
    assert len(open(log).read().splitlines()) == len(touched)


def test_cache_forgets_the_oldest():
    import hashlib

    data = {k: k.encode() for k in "abc"}
    cache = store.ShardCache(data.__getitem__, 2)
    for k in "abacab":
        assert cache.get(k, hashlib.sha256(data[k]).hexdigest()) == data[k]
    assert cache.loads == 4  # a, b, c in b's place, b in c's


def test_writer_refuses(spark, tmp_path):
    one = lambda rows: spark.createDataFrame(rows, "row_index long, record binary")
    for rows, what in (([(0, b"abc")], "bytes"), ([(0, None)], "bytes"), ([(0, b"ab"), (2, b"ab")], "missing"), ([(0, b"ab"), (0, b"ab")], "twice"), ([(1, b"ab")], "missing")):
        with pytest.raises(Exception, match=what):
            store.write_shards(one(rows), f"file://{tmp_path}/x", 2, 10)
    with pytest.raises(ValueError):
        store.write_shards(one([(0, b"ab"), (10, b"ab")]), f"file://{tmp_path}/y", 2, 10)
    assert not glob.glob(f"{tmp_path}/x/*.tmp")


def test_fixed_width_read(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    store.write_shards(_records(spark, 25), path, 16, 10)
    got = store.read_records(spark, path, 16)
    assert got.count() == 25 and got.exceptAll(_records(spark, 25).select("record")).isEmpty()
    (tmp_path / "d" / "shard-00000009.bin").write_bytes(b"0" * 17)
    with pytest.raises(Exception, match="cut inside"):
        store.read_records(spark, path, 16).collect()
