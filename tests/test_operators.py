"""Operators on small inputs with known results."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftlex.functions import hashing as H
from weftlex.functions import text as T
from weftlex.functions import vectors as V
from weftlex.operators import align, capacity, corpus, dictionary, geometry, latent, layers, routing, subspace, surface


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_segments(spark):
    r = one(spark, a=T.segments(F.lit("Red fox runs. It stops")), b=T.segments(F.lit("a well-known dog's tail")), c=T.segments(F.lit("")), d=T.segments(F.lit("x\u00a0y\u2003z")))
    assert r.a == [["Red", "fox", "runs"], ["It", "stops"]]
    assert r.b == [["a", "well-known", "dog's", "tail"]]
    assert r.c == [] and r.d == [["x", "y", "z"]]


def test_ngrams_stop_at_boundaries(spark):
    u = T.units(F.lit("a b c, d e"))
    r = one(spark, n2=T.ngrams(u, 2), n3=T.ngrams(u, 3), none=T.ngrams(T.units(F.lit("")), 3))
    assert r.n2 == ["a b", "b c", "d e"] and r.n3 == ["a b c"] and r.none == []


def test_clean_text(spark):
    r = one(spark, a=T.clean_text(F.lit("A &amp; B @-@ C http://x.y/z \\textbf{bold} \\alpha\x07 end")), b=T.clean_text(F.lit(None).cast("string")))
    assert r.a == "A & B-C bf{bold} alpha end" and r.b == ""  # the first listed command that fits is cut: \\text of \\textbf


def test_normal_forms(spark):
    df = spark.createDataFrame([(" Straße ",), ("ﬁne",), ("Éa\t b",), (" \t",), (None,)], "s string")
    got = df.select(T.normalize_word(F.col("s")).alias("n"), T.canonical_token_text(F.col("s")).alias("c")).collect()
    assert [r.n for r in got] == ["strasse", "fine", "éa\t b", "", None]
    assert [r.c for r in got] == ["straße", "fine", "ea b", " ", None]


def test_single_word_and_identifier(spark):
    r = one(spark, a=T.single_word(F.lit(" co-op ")), b=T.single_word(F.lit("two words")), c=T.single_word(F.lit("x.")), i=T.stable_identifier("sense", F.lit("a"), F.lit(None).cast("string")))
    assert r.a == "co-op" and r.b is None and r.c is None
    assert r.i.startswith("sense_") and len(r.i) == 30


def test_categories(spark):
    df = spark.createDataFrame([("cs.LG hep-th",), ("physics.optics",), ("physicsx.a",), (None,), ("astro-ph",)], "c string")
    assert [r[0] for r in df.select(T.category_selected(F.col("c"))).collect()] == [True, True, False, False, True]


def test_hash_and_bits(spark):
    def plain(ids, order, head, rows):
        s = (1_000_033 + order * 10_007 + head * 1_000_037) % 2_147_483_647
        for i, x in enumerate(ids):
            s = (s * 1_000_003 + x + (i + 1) * 97) % 2_147_483_647
        return s % rows

    r = one(spark, h=H.hash_addresses(F.array(F.lit(7), F.lit(4_000_000_000)), 2), short=H.hash_addresses(F.array(F.lit(7)), 2), a=H.pack_bits(F.array(*map(F.lit, [0, 1, 0, 1]))), b=H.pack_bits(F.array(*map(F.lit, [1, 1, 1, 1]))), k=H.tuple_key(F.array(F.lit(1), F.lit(258))))
    assert r.h == [plain([7, 4_000_000_000], 2, h, 1_048_576) for h in range(4)] and len(set(r.h)) == 4
    assert r.short is None and (r.a, r.b) == (10, 15)
    assert bytes(r.k) == (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (258).to_bytes(4, "little")
    assert H.table_rows(512, 16, 2) == 131_072 and H.table_rows(512, 16, 3) == 2_097_152


def test_latent_addresses(spark):
    df = spark.createDataFrame([(0, t, [1.0 if t >> b & 1 else -1.0 for b in range(4)]) for t in range(3)], "seq int, t int, v array<double>")
    got = {r.t: r.address for r in latent.addresses(df, "seq", "t", "v", 2, 2).where("route = 0").collect()}
    assert got == {0: None, 1: 0 + 1 * 4, 2: 1 + 2 * 4}


def test_budget_inside_a_segment_and_across_sources(spark):
    rows = [("a", 0, "one two three"), ("a", 1, "four five. six"), ("a", 2, "late text"), ("b", 0, "late text"), ("b", 1, "one two three"), ("b", 2, "new")]
    out = corpus.budget_cut(spark.createDataFrame(rows, "source string, pos long, text string"), {"a": 4, "b": 10})
    got = {(r.source, r.pos): (r.kept_words, r.cut) for r in out.withColumn("cut", corpus.cut_words(out)).collect()}
    assert got[("a", 0)][0] == 3 and got[("a", 1)] == (1, [["four"]])
    assert ("a", 2) not in got  # past the budget: never read, so it suppresses nothing
    assert ("b", 0) in got and ("b", 1) not in got and ("b", 2) in got


def test_prefix_sum_over_blocks(spark):
    df = spark.range(50).select(F.lit("s").alias("source"), F.col("id").alias("pos"), F.lit(2).alias("x"))
    assert {r.pos: r.before for r in corpus.running_before(df, "x", rows=7).collect()} == {i: 2 * i for i in range(50)}


def test_numbering_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "NUMBER_ROWS", 7)
    df = spark.range(40).select((F.col("id") * 13 % 41).alias("k"))
    got = sorted((r.k, r.n) for r in dictionary.numbered(df, ["k"], "n").collect())
    assert [n for _, n in got] == list(range(40))


def test_polysemy_and_promotion(spark):
    rows = [(0, "Bank", "A river side", "noun", "k1"), (1, "bank", "A money house", "noun", "k2"), (2, "bank", "repeat of a key", "noun", "k2")]
    records = spark.createDataFrame(rows, "ordinal long, word string, gloss string, pos string, sense_key string")
    words, senses, edges = dictionary.build(dictionary.candidates(records), dictionary.literal_words(spark, ["money", "Bank"]))
    w = {r.normalized: r for r in words.collect()}
    s = senses.orderBy("sense_row").collect()
    assert len(s) == 2 and len({r.word_id for r in s}) == 1 and len({r.sense_id for r in s}) == 2
    assert w["bank"].surface == "bank" and w["river"].surface == "river" and w["bank"].in_ngram_vocabulary
    assert [r.word_id for r in sorted(w.values(), key=lambda r: r.normalized)] == list(range(len(w)))
    assert edges.count() == 6
    report = dictionary.dictionary_report(words, senses, edges).first()
    assert (report.ngram_vocabulary_words, report.ngram_words_without_definition, report.definition_word_edges) == (2, 1, 6)


def test_candidates_need_a_word(spark):
    bad = spark.createDataFrame([(0, " ", "gloss")], "ordinal long, word string, gloss string")
    with pytest.raises(PySparkException):
        dictionary.candidates(bad).collect()


def test_coverage(spark):
    heads = spark.createDataFrame([("red",), ("fox",)], "word string")
    freq = corpus.word_frequency(spark.createDataFrame([("red fox", 10), ("red hen", 5)], "text string, k int"), "text", "k")
    r = dictionary.coverage(heads, freq).first()
    assert (r.unique_ngram_words, r.defined_ngram_words, r.missing_ngram_words) == (3, 2, 1)
    assert math.isclose(r.frequency_weighted_coverage, 25 / 30)
    none = dictionary.coverage(heads, freq.limit(0)).first()
    assert none.type_coverage == none.frequency_weighted_coverage == 1.0


def test_storage(spark):
    r = dictionary.storage_report(spark.createDataFrame([("a", "b c"), ("a", "c"), ("c", "a d")], "surface string, definition string")).first()
    assert (r.sense_rows, r.headwords, r.vector_bytes) == (3, 2, 3 * 4096)
    assert r.definition_words_as_label_only_nodes == 2


_BANK = "memory_kind string, bank_name string, word_order int, row_index long, surface_text string, frequency long, sense_id string"


def _bank(spark):
    return spark.createDataFrame([("phrase", "bigram", 2, 0, "red fox", 9, None), ("phrase", "bigram", 2, 1, "Red Fóx", 9, None), ("phrase", "trigram", 3, 0, "the red fox", 4, None), ("sense", "dictionary", 1, 0, "fox", 1, "s1"), ("sense", "dictionary", 1, 1, "Fox", 1, "s2")], _BANK)


def test_resolution_order_and_senses(spark):
    a = surface.address_table(_bank(spark))
    docs = spark.createDataFrame([(1, "The red fox"), (2, "a red fox"), (3, "red, fox"), (4, "hen")], "id long, text string")
    found = surface.positions(docs, "id", T.canonical_words(T.segments(F.col("text"))))
    got = {(r.id, r.segment, r.p): (r.word_order, r.row_index) for r in surface.resolve(found, a, "id").collect()}
    assert got[(1, 0, 2)] == (3, 0) and got[(2, 0, 2)] == (2, 0)
    assert got[(3, 1, 0)] == (1, None) and got[(4, 0, 0)] == (None, None)
    senses = surface.all_senses(surface.resolve(found, a, "id"), a, "id").collect()
    assert sorted(r.sense_id for r in senses) == ["s1", "s2"]
    under = surface.decomposition(found, a, "id").where("id = 1 AND p = 2").collect()
    assert sorted((r.word_order, r.row_index) for r in under) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    hit = surface.collisions(a.withColumn("k", F.col("word_order")), ["k", "words"]).where("k = 2").first()
    assert (hit.candidate_count, hit.surface_count, [c.row_index for c in hit.candidates]) == (2, 2, [0, 1])


def test_address_of_wrong_order_raises(spark):
    bad = spark.createDataFrame([("phrase", "bigram", 2, 0, "three word text", 1, None)], _BANK)
    with pytest.raises(PySparkException):
        surface.address_table(bad).collect()


def test_router_prefers_word_order_over_token_length(spark):
    schema = "boundary_mode string, token_ids array<bigint>, word_order int, row_index long, frequency long, surface_text string, sense_id string"
    rows = [("internal", [1, 2], 2, 5, 9, "b", None), ("internal", [9, 8, 1, 2], 1, 6, 99, "long", "s"), ("bos", [2], 1, 7, 1, "x", "s1"), ("internal", [2], 1, 8, 1, "x", "s2"), ("internal", [2], 1, 9, 1, "x", "s3")]
    tokens = spark.createDataFrame([(1, [0, 9, 8, 1, 2]), (2, [2]), (3, [5, 2]), (4, [])], "id long, ids array<bigint>")
    got = {}
    for r in surface.resolve_suffixes(tokens, spark.createDataFrame(rows, schema), "id", 4).collect():
        got.setdefault((r.id, r.end), []).append(r.row_index)
    assert got[(1, 4)] == [5] and got[(2, 0)] == [7] and sorted(got[(3, 1)]) == [8, 9]


@pytest.mark.parametrize("block_keys,broadcast", [(100_000, 200_000), (7, 0)])
def test_suffixes_by_automaton_equal_slices(spark, monkeypatch, block_keys, broadcast):
    import random

    monkeypatch.setattr(surface, "BROADCAST_ADDRESSES", broadcast)
    monkeypatch.setattr(surface, "HIT_ROWS", 5)
    rng = random.Random(3)
    schema = "boundary_mode string, token_ids array<bigint>, word_order int, row_index long, frequency long, surface_text string, sense_id string"
    rows = [(rng.choice(["bos", "internal"]), [rng.randint(0, 2) for _ in range(rng.randint(1, 4))], rng.randint(1, 3), k, rng.randint(1, 3), "x", f"s{k}") for k in range(60)]
    rows += [("bos", [], 2, 100, 1, "x", None), ("bos", [1, None], 3, 101, 1, "x", None)]
    texts = [(i, [rng.randint(0, 2) for _ in range(rng.randint(0, 12))]) for i in range(20)] + [(20, None), (21, [1, None, 1]), (None, [0, 1])]
    want = []
    for i, ids in texts:
        for end in range(len(ids or [])):
            hits = [r for r in rows[:60] if len(r[1]) <= end + 1 and ids[end + 1 - len(r[1]) : end + 1] == r[1] and r[0] == ("bos" if len(r[1]) == end + 1 else "internal")]
            hits.sort(key=lambda r: (-r[2], -r[4], r[3]))
            want += [(i, end, end + 1 - len(r[1]), r[2], r[3], r[6]) for k, r in enumerate(hits) if r[2] == hits[0][2] and (r[2] == 1 or k == 0)]
    tokens = spark.createDataFrame(texts, "id long, ids array<bigint>")
    got = surface.resolve_suffixes(tokens, spark.createDataFrame(rows, schema), "id", block_keys=block_keys)
    order = lambda r: tuple(-1 if x is None else x for x in r[:5])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert surface.resolve_suffixes(tokens, spark.createDataFrame([], schema), "id").collect() == []


def test_plan_falls_back_on_a_miss(spark):
    tokens = spark.createDataFrame([(1, [10, 11, 12])], "id long, ids array<bigint>")
    ends = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 2)], "id long, ordinal int, token_end int")
    hits = spark.createDataFrame([(1, 0, None, None), (1, 1, 1, None), (1, 2, 2, 4)], "id long, ordinal int, word_order int, row_index long")
    got = {r.end: r for r in surface.memory_plan(tokens, ends, hits, "id").collect()}
    assert got[0].memories == 0 and got[0].hash2 is None and got[1].hash2 is not None and got[1].hash3 is None
    assert (got[2].memories, got[2].best_order, got[2].best_row, got[2].hash2) == (2, 2, 4, None)


def test_projection(spark):
    vocab = spark.createDataFrame([(0, "A", "A"), (1, "Ġa", " a"), (2, "á", "á"), (3, ",", ","), (4, ".", "."), (5, "\\xff", "�"), (6, "\t", "\t"), (7, " ", " ")], "token_id int, piece string, decoded string")
    got = {r.raw_token_id: r.canonical_token_id for r in surface.token_projection(vocab).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] != got[4] and got[6] == got[7]
    table = F.array(*map(F.lit, [5, 6]))
    assert spark.range(1).select(surface.project(F.array(F.lit(1), F.lit(-1)), table)).first()[0] == [6, -1]
    with pytest.raises(PySparkException):
        spark.range(1).select(surface.project(F.array(F.lit(2)), table)).collect()


def test_word_units_are_stable(spark):
    first = align.word_units(spark.createDataFrame([(0, "Fox"), (1, "fox"), (2, "co-op's")], "ordinal long, surface string"))
    rows = sorted(first.collect())
    assert [(r.word_id, r.normalized) for r in rows] == [(1, "fox"), (2, "fox"), (3, "co-op's")]
    more = align.word_units(spark.createDataFrame([(0, "hen"), (1, "Fox")], "ordinal long, surface string"), first)
    assert {r.surface: r.word_id for r in more.collect()} == {"Fox": 1, "fox": 2, "co-op's": 3, "hen": 4}


def test_alignment(spark):
    got = align.aligned(spark.createDataFrame([(1, "ab, c"), (2, ""), (3, None)], "id long, text string"), "id").collect()
    assert [(r.surface, r.start, r.end, r.positions) for r in sorted(got, key=lambda r: r.ordinal)] == [("ab", 0, 2, [0, 1]), ("c", 4, 5, [3])]


def test_batches(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([3, 4, 9, 2, 2, 2])], "g int, o int, n int")
    got = sorted((r.o, r.batch) for r in align.pack_batches(rows, "g", "o", "n", 3, 10).collect())
    assert [b for _, b in got] == [0, 0, 1, 2, 2, 2]


def test_pool_signs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [([0.9, 0.1, 0.0, 0.0], 1.0, True), ([0.0, 1.0, 0.0, 0.0], 1.0, False)])], "id int, q array<double>, a array<struct<v:array<double>,evidence:double,supported:boolean>>")
    p = geometry.contract_pool(df, ["id"], "q", "a").first().pool
    assert p.coefficients[0] > 0 > p.coefficients[1] and p.attraction > 0 and p.repulsion > 0 and math.isfinite(p.residual)
    with pytest.raises(PySparkException):
        geometry.contract_pool(df.withColumn("a", F.slice("a", 2, 1)), ["id"], "q", "a").collect()


def test_causality(spark):
    base = np.random.default_rng(0).normal(size=(4, 4))
    other = base.copy()
    other[3] += 5

    def run(x):
        df = spark.createDataFrame([(0, t, v.tolist()) for t, v in enumerate(x)], "s int, t int, v array<double>")
        return {r.t: r.pool.movement for r in geometry.harmonic_causal(df, "s", "t", "v", 2, 2).collect()}

    a, b = run(base), run(other)
    assert all(np.allclose(a[t], b[t]) for t in range(3)) and not np.allclose(a[3], b[3])
    assert np.allclose(a[0], 0)


def test_field_prefers_the_nearest(spark):
    df = spark.createDataFrame([([0.0, 0.0], [(0, [0.1, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0])]), ([1.0, 1.0], [])], "h array<double>, s array<struct<row:int,v:array<double>>>")
    full, none = (r.f for r in df.select(geometry.definition_field(F.col("h"), F.col("s")).alias("f")).collect())
    assert full.weights[0] > full.weights[1] > full.weights[2] > 0 and math.isclose(sum(full.weights), 1, abs_tol=1e-4)
    assert none.weights == [] and none.movement == [0.0, 0.0]


def test_locality_loss_of_itself(spark):
    pts = spark.createDataFrame([(i, [float(i & 1), float(i >> 1)]) for i in range(4)], "id int, v array<double>")
    r = geometry.locality_loss(pts.withColumn("p", F.col("v")), "id", "p", "v", 2).first()
    assert max(r.point_loss, r.locality_loss, r.total_loss) < 1e-8


def test_vocabulary_scores(spark):
    rng = np.random.default_rng(1)
    h, v = rng.normal(size=(3, 8)), rng.normal(size=(11, 8))
    states = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "id int, v array<double>")
    vocab = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "token_id int, v array<double>")
    got = np.zeros((3, 11))
    for r in geometry.vocabulary_scores(states, vocab, ["id"], "v", block=4).collect():
        got[r.id, r.token_id] = r.score
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(got, -((unit(h)[:, None] - unit(v)[None]) ** 2).sum(-1) / 8)


def test_expert_routing(spark):
    experts = spark.createDataFrame([("e1", "solve", [3, 1], ["c1"], 5), ("e2", "prove", [1], ["c1", "c2"], 9), ("e3", None, [7], [], 0)], "expert_id string, task_relation string, skill_ids array<int>, concept_ids array<string>, success_count long")
    asks = spark.createDataFrame([(1, "solve", [1, 3], ["c1"]), (2, None, [99], [])], "request_id int, task_relation string, skill_ids array<int>, concept_ids array<string>")
    got = routing.route_experts(experts, asks).orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.expert_id) for r in got] == [(1, "e1"), (1, "e2")]
    assert got[0].skills == [1, 3] and got[0].task_match and not got[1].task_match


def test_signed_top_k(spark):
    r = spark.range(1).select(V.signed_top_k(F.array(*map(F.lit, [0.1, -0.6, 0.3])), 2).alias("t")).first().t
    assert [x["index"] for x in r] == [1, 2] and math.isclose(r[0].weight, -0.6 / 0.9, rel_tol=1e-4)


def test_capacity(spark):
    r = capacity.expert_geometry(spark, 592_896, 9_216, 64, 1, experts=(9, 9), hidden=(512, 512)).first()
    assert (r.experts, r.hidden_width, r.exact, r.total_compute) == (9, 512, True, 3 * 592_896)
    assert capacity.expert_geometry(spark, 10, 30, 64, 1).first().experts == 0
    with pytest.raises(ValueError):
        capacity.expert_geometry(spark, 10, 1, 0, 1)
    led = capacity.ledger(spark.createDataFrame([("memory", 1), ("compute", 3), ("shared", 9)], "kind string, n long")).first()
    assert led.exact_split and led.memory_fraction == 0.25
    with pytest.raises(PySparkException):
        capacity.ledger(spark.createDataFrame([("shared", 9)], "kind string, n long")).collect()
    t = capacity.latency(spark.createDataFrame([(float(i),) for i in range(20)], "ms double"), "ms").first()
    assert (t.median, t.p95) == (9.5, 18.0)


def test_low_rank_recovery(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 16)) + 0.2
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "source int, v array<double>")
    m = subspace.moments(df, "v", 16, "source")
    basis = subspace.balanced_pca(m, 4)
    assert subspace.project(df, basis, "v").agg(F.avg("cosine")).first()[0] > 0.99
    with pytest.raises(ValueError):
        subspace.balanced_pca(m, 17)


def test_rank_selection(spark):
    flat = spark.createDataFrame([(i + 1, 0.06 if i < 16 else 0.0) for i in range(64)], "rank int, ratio double")
    assert subspace.select_rank(flat).first().rank == 16
    slow = spark.createDataFrame([(i + 1, 1 / 32 if i < 32 else 0.0) for i in range(64)], "rank int, ratio double")
    assert subspace.select_rank(slow).first().rank == 32
    short = subspace.select_rank(spark.createDataFrame([(i + 1, 0.001) for i in range(64)], "rank int, ratio double")).first()
    assert short.rank == 64 and not short.reached


def test_shared_basis_and_residual(spark):
    rng = np.random.default_rng(3)
    ub, ua, mb, ma = rng.normal(size=(12, 3)), rng.normal(size=(10, 3)), rng.normal(size=12), rng.normal(size=10)
    rows = [("op", f"t{i}", (mb[:, None] + ub @ rng.normal(size=(3, 2))).tolist(), (ma[:, None] + ua @ rng.normal(size=(3, 2))).T.tolist()) for i in range(5)]
    adapters = spark.createDataFrame(rows, "operator string, task_id string, beta array<array<double>>, alpha array<array<double>>")
    basis = subspace.shared_basis(adapters, 3)
    assert max(r.error for r in subspace.adapter_coefficients(adapters, basis).collect()) < 1e-5
    q = np.linalg.qr(rng.normal(size=(6, 2)))[0].T
    one_basis = spark.createDataFrame([(q.tolist(),)], "components array<array<double>>")
    r = subspace.residual(spark.createDataFrame([(rng.normal(size=6).tolist(),)], "v array<double>"), one_basis, "v").first()
    assert np.abs(q @ np.array(r.residual)).max() < 1e-9


def test_unfoldings_and_factor_pairs(spark):
    rng = np.random.default_rng(4)
    keys = [("a%d" % i, "base_model.model.layers.3.q_proj.lora_%s.weight" % k, k, rng.normal(size=(2, 5) if k == "A" else (4, 2)).tolist(), 4.0, 2) for i in range(3) for k in "AB"]
    deltas = subspace.lora_deltas(spark.createDataFrame(keys, "adapter string, key string, kind string, rows array<array<double>>, alpha double, r int"))
    first = deltas.where("adapter = 'a0'").first()
    a, b = np.array(keys[0][3]), np.array(keys[1][3])
    assert np.allclose(np.array(first.rows), 2 * b @ a) and (first.layer, first.module) == (3, "q_proj")
    out = subspace.unfold_groups(deltas, [1, 9], [0.5, 1.1]).collect()
    assert {r.mode for r in out} == {"adapter_task", "output", "input_hidden"} and all(r.status == "ok" for r in out)
    few = subspace.unfold_groups(deltas.where("adapter = 'a0'"), [1], [0.5]).first()
    assert few.status == "skipped_few"


def test_layers():
    rng = np.random.default_rng(5)
    h = rng.normal(size=(6, 8))
    p = {"address": np.eye(8), "key": rng.normal(size=(8, 8)), "key_bias": np.zeros((1, 8)), "value": rng.normal(size=(8, 8)), "value_bias": np.zeros((1, 8)), "conv": rng.normal(size=(8, 4)), "conv_bias": np.zeros((1, 8)), "gate": np.array([[0.5]])}
    p |= {f"table{n}": rng.normal(size=(2 * 16**n, 4)) for n in (2, 3)}
    out = layers.latent_memory(h, p, 4)
    changed = h.copy()
    changed[5] += 3
    assert out.shape == h.shape and np.allclose(layers.latent_memory(changed, p, 4)[:5], out[:5])
    assert np.allclose(out[0], h[0] + np.tanh(0.5) * 0)  # nothing is recalled before two symbols
    with pytest.raises(ValueError):
        layers.latent_memory(h, p, 4, forced={2: np.full((6, 2), 10**6)})
    q = {"hash2": np.ones((4, 3)), "hash_projection2": np.eye(3), "hash_gate2": np.array([[1.0]])}
    assert np.allclose(layers.hash_memory({2: np.array([[0, -1], [-1, -1]])}, q), [[np.tanh(1)] * 3, [0] * 3])
    e = {"adjacency": np.array([[1, 0], [0, 1]]), "expert_anchor": rng.normal(size=(2, 8))}
    for k in range(2):
        e |= {f"expert{k}.0.content": rng.normal(size=(5, 8)), f"expert{k}.0.content_bias": np.zeros((1, 5)), f"expert{k}.0.gate": rng.normal(size=(5, 8)), f"expert{k}.0.gate_bias": np.zeros((1, 5)), f"expert{k}.0.output": rng.normal(size=(8, 5)), f"expert{k}.0.evidence": rng.normal(size=(1, 8))}
    none = np.zeros((6, 2), bool)
    assert np.allclose(layers.experts(h, none, e, 1, 1), 0)
    assert not np.allclose(layers.experts(h, ~none, e, 1, 1), 0)
    with pytest.raises(KeyError):
        layers.need({}, x=(1,))


def test_recurrent_layer_over_sequences(spark):
    states = spark.createDataFrame([(s, t, [float(s + t), 1.0, 2.0, 3.0]) for s in range(2) for t in range(3)], "s int, t int, v array<double>")
    out = layers.recurrent(states, "s", "t", "v", [lambda h: 0.1 * h], 2).collect()
    assert len(out) == 6 and all(math.isclose(sum(x * x for x in r.v) / 4, 1, abs_tol=1e-3) for r in out)


def test_relative_change(spark):
    df = spark.createDataFrame([("a", [2.0, 0.0], [1.0, 0.0])], "k string, c array<double>, p array<double>")
    assert math.isclose(geometry.relative_change(df, "k", "c", "p").first().change, 1.0, abs_tol=1e-4)


def test_shard_map_and_contiguity(spark):
    assert one(spark, s=H.shard_of(F.lit(2), 2)).s.asDict() == {"shard_index": 1, "local_row": 0}
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "g string, n int")
    assert {r.g: r.contiguous for r in dictionary.contiguous(df, "n", ["g"]).collect()} == {"a": True, "b": False}
