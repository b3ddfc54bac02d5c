"""The most frequent n-grams by hash buckets: the same as counting all of them."""

from __future__ import annotations

import random

import pytest

from weftlex import plans
from weftlex.operators import corpus, frequent


def _odd(spark, rows: int = 300):
    rng = random.Random(3)
    parts = ["a", "B", "ß", "é", "é", "́", "́'a", "1", "x9", "'", "’", "-", "‑", "a'b", "a--b", "c-́d", " ", "  ", "\t", "\x0b", "\x1c", "\x85", "　", ".", ",", "\x01", "\x00", "𝒳", "語", "ः", "_", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(rows)]
    return spark.createDataFrame([(t,) for t in [*texts, "", None, " ", "one", "a b c " * 40]], "text string")


@pytest.mark.parametrize("block", [frequent.BLOCK, 50])
def test_words_and_segments_are_those_of_the_patterns(spark, monkeypatch, block):
    monkeypatch.setattr(frequent, "BLOCK", block)
    docs = _odd(spark)
    every = {n: frequent.bucket_totals(docs, [n])[n] >= 0 for n in (1, 2, 3)}
    got = {(r.n, r.text, r.frequency) for r in frequent.counts_in(docs, every).collect()}
    want = {(n, r.text, r.frequency) for n in every for r in corpus.ngram_counts(docs, n).collect()}
    assert got == want and len(want) > 500


@pytest.mark.parametrize("guess", [None, 1, 10**9])
def test_top_is_exact_however_the_bound_is_guessed(spark, sf_dir, monkeypatch, guess):
    if guess:
        monkeypatch.setattr(frequent, "_guess", lambda totals, k: guess)
    monkeypatch.setattr(frequent, "HELD", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    docs = docs.unionByName(spark.createDataFrame([("zz yy " * 5000 + ". " * 3,)], "text string"))
    got = sorted(map(tuple, corpus.top_ngrams(docs, {2: 150, 3: 70}).collect()))
    want = [r for n, k in ((2, 150), (3, 70)) for r in corpus.top_ranked(corpus.ngram_counts(docs, n), n, k).collect()]
    assert got == sorted(map(tuple, want)) and len(got) == 220


def test_fewer_ngrams_than_wanted(spark):
    docs = spark.createDataFrame([("a b a b",), ("c",), (None,)], "text string")
    assert sorted(map(tuple, corpus.top_ngrams(docs, {2: 10, 3: 10}).collect())) == [("a b", 2, 2, 1), ("a b a", 1, 3, 1), ("b a", 1, 2, 2), ("b a b", 1, 3, 2)]
    assert corpus.top_ngrams(docs.limit(0), {2: 3}).count() == 0


def test_rare_ngrams_are_not_shuffled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    totals = frequent.bucket_totals(docs, [2])[2]
    kept = frequent.counts_in(docs, {2: totals >= frequent._guess(totals, 100)}).count()
    assert 100 <= kept < corpus.ngram_counts(docs, 2).count() / 20


@pytest.mark.parametrize("name", ["ngram_top_bigrams", "phrase_key_files", "bank_spans"])
def test_queries_make_no_string_of_each_ngram(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "documents.parquet" not in plan and "regexp_extract_all" not in plan.lower()
