"""Vectors that pass each task in chunks: the same as all pairs by NumPy, and in the time of a matrix product."""

from __future__ import annotations

import time

import numpy as np
import pytest

from weftlex.operators import routing


def _table(spark, m: np.ndarray, ids, name: str = "id"):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, m, strict=True)], f"{name} long, v array<double>")


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(5000, 64))
    m[7::500] = m[3]  # copies, so that ties are common
    return m


def test_routes_and_updates_of_many_anchors(spark, many):
    q, a = many[:4000], many[2500:]
    states = _table(spark, q, range(len(q)))
    anchors = _table(spark, a, range(len(a)), "index").selectExpr("cast(index AS int) AS index", "v")
    began = time.monotonic()
    routes = routing.signed_routes(states, ["id"], "v", anchors, 4).collect()
    moved = routing.direction_update(states, ["id"], "v", anchors.selectExpr("index", "v AS alpha", "v AS beta"), 4).collect()
    assert time.monotonic() - began < 60  # ten million pairs; a fold of arrays for each took minutes
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (a / np.linalg.norm(a, axis=1)[:, None]).T
    want = np.lexsort((np.broadcast_to(np.arange(len(a)), s.shape), -np.abs(s).round(12)), axis=1)[:, :4]
    own = np.take_along_axis(s, want, 1)
    weight = own / (np.abs(own).sum(1)[:, None] + 1e-6)
    got_i, got_w = np.zeros(want.shape, int), np.zeros(want.shape)
    for r in routes:
        got_i[r.id, r.position], got_w[r.id, r.position] = r["index"], r.weight
    assert len(routes) == want.size and (got_i == want).all() and np.abs(got_w - weight).max() < 1e-9
    update = np.einsum("nk,nk,nkd->nd", weight, np.einsum("nd,nkd->nk", q, a[want]), a[want])
    assert len(moved) == len(q) and np.abs(np.array([r.update for r in sorted(moved)]) - update).max() < 1e-6


def test_routes_of_flagged_anchors_and_of_states_that_are_no_vectors(spark):
    states = spark.createDataFrame([(0, [1.0, 0.0], [False, True, True]), (1, None, None), (2, [1.0, None], [True] * 3)], "id long, v array<double>, ok array<boolean>")
    anchors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1.0, 1.0])], "index int, v array<double>")
    got = {(r.id, r.position): (r["index"], r.weight) for r in routing.signed_routes(states, ["id"], "v", anchors, 2, "ok").collect()}
    assert [got[0, p][0] for p in (0, 1)] == [2, 1] and got[0, 0][1] == pytest.approx(-1, abs=1e-5) and got[0, 1][1] == 0
    assert [got[i, p] for i in (1, 2) for p in (0, 1)] == [(0, None), (1, None)] * 2
    update = {r.id: r.update for r in routing.direction_update(states, ["id"], "v", anchors.selectExpr("index", "v AS alpha", "v AS beta"), 1).collect()}
    assert update[0] == pytest.approx([1, 0], abs=1e-5) and update[1] is None and update[2] is None


def test_nearest_of_points_with_copies_without_pairs_of_blocks(spark, many):
    from weftlex.operators import geometry

    pts = _table(spark, many[:3000], range(3000))
    found = geometry.block_nearest(pts, pts, 5, others=True, block=700)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Window" not in plan
    m = many[:3000]
    d = ((m * m).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * m @ m.T).clip(0)
    d[d < 1e-9] = 0
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(3000), d.shape), d), axis=1)[:, :5]
    got = np.full(want.shape, -1)
    for r in found.collect():
        got[r.id, r.rank - 1] = r.other
    assert (got == want).all()


@pytest.mark.parametrize(("scale", "offset"), [(1e-3, 1e4), (1e25, 0), (1e-25, 0), (1, 0)])
def test_nearest_is_exact_where_single_precision_is_not(spark, scale, offset):
    from weftlex.operators import geometry

    m = np.random.default_rng(2).integers(-9, 10, size=(700, 6)).astype(float) * scale + offset
    d = ((m[:, None] - m[None]) ** 2).cumsum(-1)[..., -1]
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(700), d.shape), d), axis=1)[:, :4]
    got = np.full(want.shape, -1)
    pts = _table(spark, m, range(700))
    for r in geometry.block_nearest(pts, pts, 4, others=True, block=300).collect():
        got[r.id, r.rank - 1] = r.other
    assert (got == want).all()


def test_candidates_of_a_chunk_cost_little_more_than_its_product():
    from weftlex.operators import passing

    rng, best = np.random.default_rng(0), passing.Least(1024, 5)
    best.edge[:] = -30.0
    near, slack = rng.normal(size=(1024, 4096)).astype(np.float32), np.full(1024, 1e-5)
    best.wanted(near, slack)
    took = []
    for _ in range(5):
        began = time.perf_counter()
        best.wanted(near, slack)
        took.append(time.perf_counter() - began)
    assert min(took) < 0.016  # four million pairs; two dimensions and double bounds took some 30 ms


def test_banks_are_counted_once(spark, sf_dir):
    from weftlex.plans import surface

    plan = surface.address_table(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "documents.parquet" not in plan and "regexp_extract_all" not in plan.lower()


def test_fields_of_unequal_groups_are_those_of_each_pair(spark, many):
    from pyspark.sql import functions as F

    from weftlex.functions import vectors as V
    from weftlex.operators import geometry

    rows = [(i, None if i % 97 == 0 else int(i % 11 == 0), [float(x) for x in m]) for i, m in enumerate(many[:900])]
    rows += [(900, 5, [1.0] * 64), (901, 0, None), (902, 1, [None] * 64)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>").withColumnRenamed("g", "group")
    senses = df.where("id % 9 = 0 AND id < 900").select("group", "v")
    listed = senses.groupBy("group").agg(F.collect_list(F.struct(F.lit(0).alias("row"), "v")).alias("s"))
    want = {r.id: r for r in df.where("id < 901").join(listed, "group").select("id", F.size("s").alias("n"), geometry.definition_field(F.col("v"), F.col("s")).alias("f")).select("id", "n", V.total(F.col("f.weights")).alias("mass"), F.array_min("f.distances").alias("nearest"), "f.movement").collect()}
    found = geometry.definition_fields(df, senses)
    got = {r.id: r for r in found.collect()}
    assert set(got) == set(want) | {901, 902} and len(want) > 800 and got[901].senses == want[1].n and got[902].mass is None and got[901].movement is None
    for i, w in want.items():
        assert got[i].senses == w.n and got[i].mass == pytest.approx(w.mass, abs=1e-12) and got[i].nearest == pytest.approx(w.nearest, rel=1e-9, abs=1e-15)
        assert np.abs(np.array(got[i].movement) - w.movement).max() < 1e-9
    unfit = geometry.definition_fields(df.where("id < 5"), spark.createDataFrame([(0, None), (1, [1.0] * 64)], "group int, v array<double>")).collect()
    assert {(r.id, r.senses, r.mass is None) for r in unfit} == {(i, 1, True) for i in range(1, 5)}


def test_definition_field_lists_no_group(spark, sf_dir):
    from weftlex import plans

    plan = plans.QUERIES["definition_field"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "collect_list" not in plan
