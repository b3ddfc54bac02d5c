"""What the methods add: uncommon forms, entire licences, reordered and short passages, cuts inside words, repeats and nulls."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftlex.llm import bpe, jaccard_join, licences, line_rules, pii, quality, queries, secrets, tiling, wordhash

DOCS = "doc_id long, text string"

# written by hand, in forms and sentences that the templates of the samples do not have
PERSONAL = (
    ("email", "Reach me at jane dot doe (at) university (dot) edu please"),
    ("email", "e-mail: j.smith [at] example [dot] org"),
    ("email", "Kontakt: info(at)firma.de"),
    ("email", "Write to bob @ mail.example.com soon"),
    ("ip", "Server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is down"),
    ("ip", "blocked host 192[.]168[.]4[.]20 yesterday"),
    ("card", "Visa card 4111.1111.1111.1111 exp 09/27"),
    ("card", "credit card: 5500/0000/0000/0004"),
    ("phone", "Call (415) 555-2671 after six"),
    ("phone", "mobile 0044 207 946 0958"),
    ("phone", "phone: 415-555-2671"),
)
HARMLESS = ("the order 4111.1111.1111.1112 was shipped", "time 10:20:30:40 elapsed", "invoice no. 2024-555-1234", "isbn 978-316-148410", "version 10 . 20 . 30 . 400", "we looked at things. Then we left")


def test_personal_data_in_uncommon_forms():
    found = [[s[2] for s in pii.method_spans(t, pii.base_spans(t))] for _, t in PERSONAL]
    assert [f for f, (k, _) in zip(found, PERSONAL, strict=True) if f != [k]] == []
    assert [t for t in HARMLESS if pii.method_spans(t, pii.base_spans(t))] == []


def test_spans_of_many_matches_do_not_overlap():
    t = " call (415) 555-2671 and a.b@c.de" * 3000
    base = pii.base_spans(t)
    more = pii.method_spans(t, base)
    every = sorted(base + more)
    assert len(base) == 3000 and len(more) == 3000 and all(a[1] <= b[0] for a, b in zip(every, every[1:], strict=False))


def test_secrets_in_ordinary_text(spark):
    rows = [(0, "key ghp_16C7e42F292c6912E7710c838347Ae178B4a here"), (1, "id 550e8400-e29b-41d4-a716-446655440000 end"), (2, "see node_modules/react-dom/cjs/react-dom.development18"), (3, "benutzer_konto_adresse_liste_12")]
    rows += [(10, " ".join(f"{hashlib.md5(str(i).encode()).hexdigest()} ghp_16C7e42F292c6912E7710c8{i:04d}" for i in range(300)))]
    got = {r.doc_id: (r.n_hex, r.n_markov) for r in secrets.find_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: (0, 1), 1: (0, 0), 2: (0, 0), 3: (0, 0), 10: (300, 300)}


def test_entire_licences(spark):
    texts = {name: text for name, text, _ in licences._TITLED}
    rows = [(1, "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + texts["MIT"].upper()), (2, texts["BSD-3-Clause"].replace("license", "licence"))]
    rows += [(3, "About this project\n\nIt does things.\n\n" + texts["Zlib"] + "\n\nThe end."), (4, "\n\n".join(reversed(texts["Zlib"].split("\n\n")))), (5, texts["Unlicense"] + "\n\n" + texts["ISC"]), (6, None), (7, "")]
    got = {r.doc_id: (r.whole_licence, r.licences, r.n_included) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    # the copyright line is a paragraph that does not count, so the text under its title is found twice
    assert got[1][0] == "MIT" and "MIT" in got[1][1].split(",") and got[1][2] >= 1
    assert got[2][0] == "BSD-3-Clause" and got[3][0] is None and "Zlib" in got[3][1].split(",") and got[3][2] == 1
    assert "Zlib" not in got[4][1].split(",") and {"ISC", "Unlicense"} <= set(got[5][1].split(",")) and got[5][2] == 2
    assert got[6] == got[7] == (None, "", 0)


def test_lines_of_several_languages(spark):
    good = "Diese Zeile ist ein ganz gewöhnlicher Satz mit einem Ende."
    bad = ["Startseite", "Lire la suite »", "Iniciar sesión", "Alle Rechte vorbehalten, Firma", "Nous utilisons la politique de cookies", "Home | News | Sport | Kontakt | Impressum", "https://example.org/a/b/c https://example.org/d"]
    rows = [(k, f"{good}\n{x}") for k, x in enumerate(bad)] + [(100, good), (101, "Ein Satz mit https://example.org/a und vielen Worten danach, die mehr sind als der Verweis.")]
    got = {r.doc_id: r.n_lost_lines for r in line_rules.apply_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {k: 1 for k in range(len(bad))} | {100: 0, 101: 0}


def test_searched_tiles_mark_as_much_as_listed_ones(monkeypatch):
    rng = random.Random(8)
    for _ in range(120):
        doc, item = (wordhash.mix(np.array([rng.randrange(3) for _ in range(n)], np.uint64) + np.uint64(1)) for n in (60, 25))
        runs = set(wordhash.windows(item, 3).tolist())
        at = np.array([i for i, w in enumerate(wordhash.windows(doc, 3).tolist()) if w in runs], int)
        listed, searched = tiling.tiles(doc, item, at, 3), tiling._searched_tiles(doc, item, 3)
        lengths = [k for _, _, k in searched]
        assert lengths == sorted(lengths, reverse=True) and all((item[a : a + k] == doc[b : b + k]).all() for a, b, k in searched)
        assert max(lengths, default=0) == max((k for _, _, k in listed), default=0)
        assert abs(sum(lengths) - sum(k for _, _, k in listed)) <= 4  # ties may fall another way
    one = np.full(20_000, 7, np.uint64)
    assert sum(k for _, _, k in tiling.tiles(one, one[:500], np.arange(19_996), 5)) == 500


def test_short_and_unspaced_items(spark):
    items = spark.createDataFrame([(1, "Quite Short"), (2, "机器学习模型评估"), (3, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "this is quite, short."), (2, "quite not short"), (3, "前言机器学习模型评估后记"), (None, "quite short"), (None, "clean"), (4, None), (5, "")], DOCS)
    assert {(r.doc_id, r.item_id) for r in tiling.contaminated(docs, items).collect()} == {(1, 1), (3, 2), (None, 1)}
    kept = tiling.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(2, "quite not short"), (None, "clean"), (4, None), (5, "")]))
    assert tiling.decontaminate(docs.limit(0), items).count() == 0 and tiling.decontaminate(docs, items.limit(0)).count() == 7


def test_cuts_inside_words():
    c = bpe.Codec(bpe.default_vocabulary())
    assert all(c.fragments("".join(p)) for p in ("xqzj", "wordxqzjword"))
    rng = random.Random(2)
    parts = [*"abcxqzjvw0189#$%&()-_.,;:!?'\"", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "×", "漢", "字", "한", "\xa0", " ", "<|endoftext|>"]
    cut = 0
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 40)))
        cut += len(c.fragments(t))
        assert [int(x) for f in c.encode(t) for x in f[1].split(",")] == c.tokenizer.encode(t, add_special_tokens=False).ids
    assert cut > 4000


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_bpe_query_equals_the_library(spark, sf_dir, size, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = bpe.Codec(bpe.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    if size == 64:  # texts that are windows of a block each, cut where fragments end
        monkeypatch.setattr(bpe, "BLOCK_BYTES", size)
        for t in [*texts.values()][:40] + ["x" * 500, "<|endoftext|>" * 30, "é" * 300, ("ab " * 40 + "<|endoftext|>") * 5]:
            raw = np.frombuffer(t.encode(), np.uint8)
            ids = [i for *_, data, starts in bpe._windows(c, raw, np.array([0, len(raw)])) for e in c.encode_block(data, starts, True)[3].to_pylist() for i in e]
            assert ids == c.tokenizer.encode(t, add_special_tokens=False).ids
        return
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.QUERIES["op10_bpe"](spark, sf_dir).collect():
        want = c.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want))), sha(c.tokenizer.decode(want, skip_special_tokens=False)))


def test_one_of_each_group_without_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a), (3, a + " more"), (3, b), (None, a), (None, b.upper()), (None, "alone x"), (None, "alone X"), (9, ""), (9, ""), (7, None), (8, "some other text of its own here"), (8, "some other text of its own here")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = jaccard_join.keep_one(docs)
    got = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    alone = [x for x in got if "alone" in x]
    assert kept.columns == docs.columns and len(alone) == 1
    assert sorted(set(got) - set(alone)) == sorted({str((3, a + " more")), str((3, b)), str((9, "")), str((7, None)), str((8, "some other text of its own here"))}) and len(got) == 7
    found = jaccard_join.jaccard_components(docs).collect()
    assert {r.component_id for r in found if r.doc_id in (5, 3)} == {3} and len(found) == len(rows)
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["3", "3", "None", "None"]


def test_models_do_not_depend_on_the_order_of_repeats(spark):
    docs = spark.createDataFrame([(i % 40, f"{'good text here' if i % 2 else '### $$$ ###'} {i} " * (1 + i % 3), "en", "s", 10) for i in range(160)], DOCS + ", lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int")
    one, two = (quality.train(d, labels) for d in (docs.repartition(3), docs.orderBy("text")))
    assert all(np.array_equal(x.w, y.w) for x, y in zip(one, two, strict=True))


def test_stages_on_awkward_rows(spark, sf_dir):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "one text of the awkward kind", 1), (1, "one text of the awkward kind", 1), (2, None, 2), (None, "", None), (None, None, None), (3, "", 3), (4, long, 4), (5, "x" * 200_000, 5)]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], DOCS + ", n_chars long, lang string, source string").withColumns({c: F.col("doc_id") for c in ("k", "mark", "id", "row", "j", "sig", "spans")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() <= len(rows) and stage(spark, docs.limit(0), sf_dir).count() == 0
        if name != "encoding":
            assert out.columns == docs.columns
