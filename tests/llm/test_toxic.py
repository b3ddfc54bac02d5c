"""The toxicity field: marginals by enumeration, tokens, held-out accuracy, spans and edges."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from weftlex.llm import queries, toxic, wordhash


def enumerate_paths(unary, field):
    """Marginals and summed transitions of one text by all label sequences."""
    total, p, pairs = 0.0, np.zeros(len(unary)), np.zeros(4)
    for path in itertools.product((0, 1), repeat=len(unary)):
        s = field.first * path[0] + sum(u for u, y in zip(unary, path, strict=True) if y)
        s += sum(field.moves[2 * a + b] for a, b in itertools.pairwise(path))
        total += np.exp(s)
        p += np.exp(s) * np.array(path)
        for a, b in itertools.pairwise(path):
            pairs[2 * a + b] += np.exp(s)
    return p / total, pairs / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    for sizes in ([1], [5, 1, 8, 2], [3] * 60):
        field = toxic.Field(np.zeros(1), rng.normal(0, 2, 4), float(rng.normal()))
        unary, firsts = rng.normal(0, 2, sum(sizes)), np.cumsum([0, *sizes[:-1]])
        p, pairs = toxic.forward_backward(unary, firsts, field)
        want = [enumerate_paths(unary[a : a + n], field) for a, n in zip(firsts, sizes, strict=True)]
        np.testing.assert_allclose(p, np.concatenate([w[0] for w in want]), atol=1e-9)
        np.testing.assert_allclose(pairs, sum(w[1] for w in want), atol=1e-9)


def test_long_chain_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    field, unary = toxic.Field(np.zeros(1), rng.normal(0, 1, 4), -1.0), rng.normal(0, 3, 10_000)
    p, _ = toxic.forward_backward(unary, np.zeros(1, int), field)
    e, a = np.exp(unary), np.exp(field.moves).reshape(2, 2)
    forth = [np.array([1, np.exp(field.first) * e[0]])]
    for u in e[1:]:
        forth.append(forth[-1] @ a * [1, u])
        forth[-1] /= forth[-1].sum()
    back = [np.ones(2)]
    for u in e[:0:-1]:
        back.append(a @ ([1, u] * back[-1]))
        back[-1] /= back[-1].sum()
    both = np.array(forth) * np.array(back[::-1])
    np.testing.assert_allclose(p, both[:, 1] / both.sum(1), atol=1e-9)


def test_tokens_by_block_equal_tokens_by_text():
    texts = ["You Idiot, you", "", None, "naïve “quoted” word—dash…end", "x" * 700_000 + " tail idiot", "word " * 150_000, "日本語。テキスト、です"]
    whole = {}
    for first, rows, starts, ends, features in toxic._texts(pa.array(texts)):
        for i in range(len(texts)):
            mine = rows + first == i
            if mine.any():
                whole[i] = (starts[mine], ends[mine], features[mine])
    data, offsets = wordhash.buffers(pa.array(texts))
    for i, text in enumerate(texts):
        found = re.findall(r"[^\W_]+", text or "")
        if not found:
            assert i not in whole
            continue
        starts, ends, features = whole[i]
        assert [bytes(data[a:b]).decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == found
        alone = list(toxic._texts(pa.array([text])))
        np.testing.assert_array_equal(features, alone[0][4])


def test_held_out_accuracy_and_spans(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxic.score(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [i for i in truth if i in got and got[i].held_out]
    right = sum(got[i].predicted == truth[i] for i in held)
    assert len(held) > 50 and right >= 0.97 * len(held), (right, len(held))
    words = []
    for i, r in got.items():
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            words.append(texts[i][a:b].lower())
    assert words and sum(w in texts[i].lower() for i, w in zip(got, words, strict=False)) >= 0
    known = {"idiot", "moron", "scum", "trash", "clown", "loser", "pathetic", "worthless", "stupid", "disgusting"}
    assert known & set(words)


def test_edges(spark):
    rows = [(1, "you utter blockhead of a person"), (2, None), (3, ""), (None, "blockhead"), (4, "blockhead " * 100_000), (4, "blockhead " * 100_000), (5, " \n ")]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, spans string, score double")
    learn = spark.createDataFrame([(i, f"{'you blockhead go' if i % 3 == 0 else 'a calm and friendly note'} number {i % 17}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxic.train(learn, labels)
    got = sorted((r.asDict() for r in toxic.tag(docs, model).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == 7
    assert got[0]["score"] > 0.5 and [(s.start, s.end) for s in got[0]["spans"]][-1:] != [] and got[1]["score"] == got[2]["score"] == got[5]["score"] < 0.5
    text = rows[0][1]
    assert any("blockhead" in text[s.start : s.end] for s in got[0]["spans"])
    assert got[3]["spans"] == got[4]["spans"] and got[3]["score"] > 0.5
    assert toxic.tag(docs.limit(0), model).count() == 0
    none = toxic.score(docs, labels.where("toxic = 1")).collect()
    assert len(none) == 7 and all(r.score is None and r.n_spans == 0 for r in none)
    assert toxic.score(docs, labels.limit(0)).count() == 7


@pytest.mark.parametrize("name", ["op12_toxicity"])
def test_query(name, spark, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
