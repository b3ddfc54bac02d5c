"""Queries over whole tables, without SQL, against brute force on the smallest ones."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

from weftlex import plans
from weftlex.operators import geometry, surface
from weftlex.plans.surface import records


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_expert_route(spark, sf_dir):
    skills, kinds, n = defaultdict(set), defaultdict(set), defaultdict(int)
    for e in table(spark, sf_dir, "events"):
        skills[e.user_id].add(e.event_id % 40)
        kinds[e.user_id].add(e.event_type)
        n[e.user_id] += 1
    want, parts = [], table(spark, sf_dir, "part")
    for p in parts:
        ask, view = {p.p_size % 40, p.p_partkey % 40}, {"view"} if p.p_partkey % 4 == 0 else {"none"}
        found = [(not (p.p_partkey % 2 == 0 and u % 3 == 0), -len(kinds[u] & view), -len(skills[u] & ask), -n[u], str(u)) for u in n if skills[u] & ask or kinds[u] & view]
        want += [(p.p_partkey, k, f[4], sorted(skills[int(f[4])] & ask), sorted(kinds[int(f[4])] & view), not f[0]) for k, f in enumerate(sorted(found)[:8], 1)]
    assert max(p.p_partkey for p in parts) > 100
    df = plans.QUERIES["expert_route"](spark, sf_dir)
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_vector_queries_over_all(spark, sf_dir):
    rows = sorted(table(spark, sf_dir, "embeddings"), key=lambda r: r.vec_id)
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    run = lambda name: plans.QUERIES[name](spark, sf_dir)
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :8]
    p = v * 0.9 + np.roll(v, -1, axis=1) * 0.05
    ref, seen = np.sqrt(np.take_along_axis(d, near, 1)), np.linalg.norm(p[:, None] - p[near], axis=-1)
    gap = np.abs(seen - ref) / ref.mean()
    got = run("knn_locality_loss").first()
    assert abs(got.locality_loss - np.where(gap < 1, gap * gap / 2, gap - 0.5).mean()) < 2e-6 and abs(got.point_loss - ((p - v) ** 2).mean()) < 2e-6
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = -((unit(v)[:, None] - unit(v)[None]) ** 2).sum(-1) / 64
    best = {r.vec_id: r.token_id for r in run("greedy_decode").collect()}
    top = run("vocab_scores_topk").collect()
    assert len(best) == len(ids) > 200 and len(top) == 5 * len(ids) and any(r.token_id % 10 for r in top)
    at = {int(x): k for k, x in enumerate(ids)}
    assert all(abs(r.score - np.sort(score[at[r.vec_id]])[-r.rank]) < 2e-6 and abs(r.score - score[at[r.vec_id], at[r.token_id]]) < 2e-6 for r in top)
    assert all(score[at[i], at[t]] > score[at[i]].max() - 1e-9 for i, t in best.items())
    loss = [max(0.0, 0.2 - score[at[i], at[i // 10 * 10]] + s) for i in at if i % 7 for s in sorted((score[at[i], k] for k in range(len(ids)) if ids[k] != i // 10 * 10), reverse=True)[:8]]
    assert abs(run("rank_margin_loss").first().loss - sum(loss) / len(loss)) < 2e-6


def test_blocks_keep_ties_by_id(spark):
    pts = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(40, [1.0, 2.5])], "id long, v array<double>")
    got = {}
    for r in geometry.block_nearest(pts, pts, 3, others=True, block=7).collect():
        got.setdefault(r.id, []).append((r.d2, r.other))
    assert all(sorted(x) == [(0.25 if i == 40 else 0.0, j) for j in [y for y in range(40) if y != i][:3]] for i, x in got.items()) and len(got) == 41


def test_resolve_suffix_tokens(spark, sf_dir):
    plain = lambda x: re.sub(r"\s", "", x.lower(), flags=re.A)
    bank = {}
    for r in sorted(records(spark, sf_dir).where("word_order > 1").collect(), key=lambda r: (-r.word_order, -r.frequency, r.row_index, r.surface_text)):
        bank.setdefault(plain(r.surface_text), (-r.word_order, -r.frequency, r.row_index, r.surface_text))
    lengths, want = {len(k) for k in bank}, []
    for item in table(spark, sf_dir, "benchmark"):
        text = plain(item.text)
        for end in range(len(text)):
            hits = [(bank[k], end - n + 1) for n in lengths if n <= end + 1 and (k := text[end - n + 1 : end + 1]) in bank]
            if hits:
                best, start = min(hits)
                want.append((item.item_id, end, start, -best[0], best[2]))
    got = sorted(tuple(r) for r in plans.QUERIES["resolve_suffix_tokens"](spark, sf_dir).collect())
    assert got == sorted(want) and any(w[4] >= 300 for w in want)


def test_suffixes_of_every_address_length(spark):
    key = list(range(30))
    addresses = spark.createDataFrame([("bos", key, 2, 0, 1, "x", None)], "boundary_mode string, token_ids array<bigint>, word_order int, row_index long, frequency long, surface_text string, sense_id string")
    got = surface.resolve_suffixes(spark.createDataFrame([(1, [*key, 5])], "id long, ids array<bigint>"), addresses, "id").collect()
    assert [(r.end, r.start) for r in got] == [(29, 0)]
