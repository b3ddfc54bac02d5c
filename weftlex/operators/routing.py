"""Routing: signed top-k over anchors, expert adjacency, low-rank updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vectors as V
from . import passing as P

#: Most distinct forms of requests that are broadcast.
FORMS = 20_000


def cosines(v: Column, anchors: Column) -> Column:
    """Cosine of a vector with each row of an array."""
    return V.let(V.l2_normalize(v), lambda q: F.transform(anchors, lambda a: V.dot(V.l2_normalize(a), q)))


def _chosen(q: np.ndarray, fit: np.ndarray | None, path: str, k: int) -> list[P.Least]:
    """For each ``P.OWN`` rows of unit vectors the k stored anchors of largest cosine in magnitude, ties to the lower index."""
    parts = [(at, q[at : at + P.OWN], P.Least(len(q[at : at + P.OWN]), k)) for at in range(0, len(q), P.OWN)]
    for index, rows in P.chunks(path, ["index", "unit"]):
        for at, own, best in parts:
            near = -np.abs(own @ rows.T)
            if fit is not None:
                near[~fit[at : at + len(own)][:, index]] = np.inf
            i, j = best.wanted(near, np.full(len(own), 1e-12))
            s = P.products(rows[j], own[i])
            best.add(i, -np.abs(s), index[j], s)
    return [best for _, _, best in parts]


def _weights(best: P.Least, n: int, epsilon: float) -> np.ndarray:
    place, mass = best.places(), np.zeros(n)
    for p in range(best.k):
        mass[best.own[place == p]] += np.abs(best.value[place == p])
    return best.value / (mass[best.own] + epsilon)


def _split(states: DataFrame, keys: list[str], v: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(keys, _v, more) of the states that are vectors, and the keys of those that are null or hold one."""
    df = states.select(*keys, F.transform(v, lambda x: x.cast("double")).alias("_v"), *more)
    whole = F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull())
    return P.dealt(df.where(whole)), df.where(~whole).select(*keys)


def signed_routes(states: DataFrame, keys: list[str], v: str, anchors: DataFrame, k: int, valid: str | None = None) -> DataFrame:
    """(keys, position, index, weight) of the k anchors of largest cosine in magnitude, ties to the lower index.

    ``anchors(index, v)`` have dense indexes; they are stored once and pass
    every task in chunks.  ``valid`` is an array of one flag for each anchor.  A
    state that is null, or holds a null, gets the first k anchors without weight.
    """
    path, n = _stored(anchors.select("index", F.col("v").alias("alpha"))), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, best in _routed(batches, n, path, k, valid is not None):
            out = [*(part.column(c).take(pa.array(best.own + at)) for c in range(n)), pa.array(best.places(), pa.int32()), pa.array(best.tie, pa.int32()), pa.array(_weights(best))]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "position", "index", "weight"])

    schema = StructType([*(states.schema[c] for c in keys), *StructType.fromDDL("position int, index int, weight double")])
    flags = [F.transform(valid, lambda x: F.coalesce(x, F.lit(False))).alias("_fit")] if valid else []
    whole, rest = _split(states, keys, v, *flags)
    first = anchors.select(F.col("index").cast("int").alias("index")).orderBy("index").limit(k).withColumn("position", F.col("index"))
    return whole.mapInArrow(run, schema).unionByName(rest.join(F.broadcast(first), F.lit(True)).withColumn("weight", F.lit(None).cast("double")))


def _stored(anchors: DataFrame) -> str:
    """Anchors (index, alpha, more) in the shared folder with ``unit``, alpha at unit length."""
    numbers = [F.transform(c, lambda x: x.cast("double")).alias(c) for c in anchors.columns if c != "index"]
    return P.stored(anchors.select(F.col("index").cast("long").alias("index"), *numbers, V.l2_normalize(F.col("alpha")).alias("unit")), "anchors")


def _routed(batches: Iterator[pa.RecordBatch], n: int, path: str, k: int, flagged: bool = False) -> Iterator[tuple[pa.RecordBatch, int, P.Least]]:
    """For each ``P.OWN`` rows of vectors (column ``n``): their batch, their place in it, and the k anchors of each."""
    for batch in batches:
        q, fit = P.unit(P.matrix(batch.column(n))), P.matrix(batch.column(n + 1)) if flagged else None
        parts = [(at, P.Least(len(q[at : at + P.OWN]), k)) for at in range(0, len(q), P.OWN)]
        for index, rows in P.chunks(path, ["index", "unit"]):
            for at, best in parts:
                own = q[at : at + P.OWN]
                near = -np.abs(own @ rows.T)
                if flagged:
                    near[~fit[at : at + P.OWN][:, index]] = np.inf
                i, j = best.wanted(near, np.full(len(own), 1e-12))
                s = P.products(rows[j], own[i])
                best.add(i, -np.abs(s), index[j], s)
        yield from ((batch, at, best) for at, best in parts)


def _weights(best: P.Least, epsilon: float = 1e-6) -> np.ndarray:
    """As vectors.signed_top_k(): the scores over the sum of their magnitudes."""
    mass = np.zeros(len(best.edge))
    np.add.at(mass, best.own, np.abs(best.value))  # in order of place
    return best.value / (mass[best.own] + epsilon)


def low_rank_update(routes: DataFrame, states: DataFrame, keys: list[str], v: str, factors: DataFrame) -> DataFrame:
    """(keys, update): sum over routes of weight * B (A v); ``factors(index, a, b)`` hold matrices as arrays of rows."""
    one = routes.join(states.select(*keys, F.col(v).alias("_v")), keys).join(F.broadcast(factors), "index")
    part = V.scale(V.mat_vec(F.col("b"), V.mat_vec(F.col("a"), F.col("_v"))), F.col("weight"))
    listed = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", part.alias("u")))).alias("us"))
    return listed.select(*keys, F.aggregate(F.slice("us", 2, F.greatest(F.size("us") - 1, F.lit(0))), F.get("us", F.lit(0))["u"], lambda acc, x: V.add(acc, x["u"])).alias("update"))


def direction_update(states: DataFrame, keys: list[str], v: str, directions: DataFrame, k: int) -> DataFrame:
    """(keys, update): the response along each of the k chosen directions, weighted, mapped back.

    ``directions(index, alpha, beta)``: unit read directions are scored, raw ones
    respond.  They pass every task in chunks, once to be chosen and once to respond.
    """
    path, n = _stored(directions.select("index", "alpha", "beta")), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, best in _routed(batches, n, path, k):
            v, weight = P.matrix(part.column(n).slice(at, len(best.edge))), _weights(best)
            moved = np.zeros((len(best.own), 0))
            for index, alpha, beta in P.chunks(path, ["index", "alpha", "beta"]):
                order = np.argsort(index)
                j = order[np.minimum(np.searchsorted(index, best.tie, sorter=order), len(index) - 1)]
                hit = np.flatnonzero(index[j] == best.tie)
                moved = moved if moved.shape[1] else np.zeros((len(best.own), beta.shape[1]))
                moved[hit] = beta[j[hit]] * P.products(alpha[j[hit]], v[best.own[hit]])[:, None] * weight[hit, None]
            rows = np.unique(best.own)
            update, place = np.zeros((len(best.edge), moved.shape[1])), best.places()
            for p in range(k):
                update[best.own[place == p]] += moved[place == p]
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * moved.shape[1])
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows + at)) for c in range(n)), pa.ListArray.from_arrays(ends, pa.array(update[rows].ravel()))], names=[*keys, "update"])

    whole, rest = _split(states, keys, v)
    schema = StructType([*(states.schema[c] for c in keys), *StructType.fromDDL("update array<double>")])
    return whole.mapInArrow(run, schema).unionByName(rest.withColumn("update", F.lit(None).cast("array<double>")))


def route_experts(experts: DataFrame, requests: DataFrame, limit: int = 8) -> DataFrame:
    """(request_id, rank, expert_id, skills, concepts, task_match): experts by adjacency to what a request has active.

    ``experts(expert_id, task_relation, skill_ids, concept_ids, success_count)``,
    ``requests(request_id, task_relation, skill_ids, concept_ids)``.  Candidates
    share a skill or a concept; they rank by task match, concepts, skills and
    successes, then by id.  A request with no adjacent expert has no row.
    Requests that ask for the same are routed once; each task keeps ``limit``
    experts of such a form before anything is shuffled.
    """
    tagged = lambda df, c, tag: F.transform(F.coalesce(df[c], F.array().cast(df.schema[c].dataType)), lambda x: F.concat(F.lit(tag), x.cast("string")))
    known = lambda df: F.sort_array(F.array_union(tagged(df, "skill_ids", "s:"), tagged(df, "concept_ids", "c:")))
    asked = requests.select("request_id", F.col("task_relation").alias("_t"), *(F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast(requests.schema[c].dataType)))).alias(n) for c, n in (("skill_ids", "_s"), ("concept_ids", "_c"))), known(requests).alias("_k"))
    forms = asked.select("_t", "_s", "_c", "_k").distinct()
    few = F.broadcast if forms.count() <= FORMS else lambda df: df
    edges = few(forms.withColumn("_x", F.explode("_k")))
    # a narrow expert row meets many forms: as many tasks as there are partitions, however few bytes they have
    spark = experts.sparkSession
    dealt = experts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "expert_id")
    full = dealt.withColumn("_own", known(experts)).withColumn("_x", F.explode("_own")).join(edges, "_x")
    # a pair meets once for each thing shared; it counts at the least of them
    full = full.where(F.col("_x") == F.array_min(F.array_intersect("_own", "_k")))
    full = full.select(
        "_t",
        "_k",
        "expert_id",
        F.sort_array(F.array_intersect("skill_ids", "_s")).alias("skills"),
        F.sort_array(F.array_intersect("concept_ids", "_c")).alias("concepts"),
        F.coalesce(F.col("task_relation") == F.col("_t"), F.lit(False)).alias("task_match"),
        "success_count",
    )
    best = Window.partitionBy("_t", "_k").orderBy(F.desc("task_match"), F.desc(F.size("concepts")), F.desc(F.size("skills")), F.desc("success_count"), "expert_id")
    top = full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    top = top.select(F.col("_t").alias("_t1"), F.col("_k").alias("_k1"), "rank", "expert_id", "skills", "concepts", "task_match")
    return asked.join(few(top), F.col("_t").eqNullSafe(F.col("_t1")) & (F.col("_k") == F.col("_k1"))).select("request_id", "rank", "expert_id", "skills", "concepts", "task_match")


def adjacent_experts(active: DataFrame, adjacency: DataFrame, key: str) -> DataFrame:
    """(key, expert_id): experts adjacent to any active skill; ``active(key, skill_id)``, ``adjacency(skill_id, expert_id)``."""
    return active.select(key, "skill_id").distinct().join(adjacency.distinct(), "skill_id").select(key, "expert_id").distinct()
