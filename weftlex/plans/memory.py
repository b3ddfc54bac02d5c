"""Memory and expert layers over the first eight coordinates of ``embeddings``.

Parameters follow one rule, so that SQL can state them too: row i and column j
of an array of seed s is ((7 i + 3 j + s) mod 13 - 6) / 10.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import latent as L
from ..operators import layers as Y
from ..operators import subspace as S
from .catalog import query, table

W, E = 8, Y.EPSILON
SKILLS, RANK, EXPERTS, BRANCHES, TOP = 5, 2, 4, 2, 2


def _p(rows: int, cols: int, seed: int) -> list[list[float]]:
    return [[((7 * i + 3 * j + seed) % 13 - 6) / 10 for j in range(cols)] for i in range(rows)]


def _table(spark: SparkSession, arrays: dict[str, list[list[float]]]) -> DataFrame:
    return spark.createDataFrame([(n, i, r) for n, rows in arrays.items() for i, r in enumerate(rows)], "name string, row int, values array<double>")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, W), lambda x: x.cast("double")).alias("v"))


def _sums(df: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    return df.select(*keys, V.tidy(V.total(F.col(v))).alias("total"), V.tidy(F.sqrt(V.sum_squares(F.col(v)))).alias("norm"))


# -- the same in SQL: x(...) are expressions of lists ----------------------------

_H = f"h AS (SELECT vec_id, label, list_transform(embedding[1:{W}], lambda y: CAST(y AS DOUBLE)) AS v FROM embeddings)"
_r = lambda x: f"round({x}, 6) + 0.0"
_a = lambda i, j, s: f"CAST(((7 * ({i}) + 3 * ({j}) + ({s})) % 13 - 6) AS DOUBLE) / 10"
_mv = lambda rows, x, s, n=W: f"list_transform(range(0, {rows}), lambda i: list_sum(list_transform(range(0, {n}), lambda j: ({_a('i', 'j', s)}) * ({x})[j + 1])))"
_row = lambda i, n, s: f"list_transform(range(0, {n}), lambda j: {_a(i, 'j', s)})"
_sq = lambda v: f"list_sum(list_transform({v}, lambda y: y * y))"
_unit = lambda v: f"list_transform({v}, lambda x: x / greatest(sqrt({_sq(v)}), 1e-12))"
_rms = lambda v: f"list_transform({v}, lambda x: x / sqrt({_sq(v)} / len({v}) + {E}))"
_add = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"
_mul = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])"
_sig = lambda x: f"(1 / (1 + exp(-({x}))))"
_out = lambda v: f"{_r(f'list_sum({v})')} AS total, {_r(f'sqrt({_sq(v)})')} AS norm"


def _summed(src: str, keys: str, scale: str, v: str) -> str:
    """(keys, v): the sum over rows of ``src`` of scale times the list v, by coordinate."""
    return f"SELECT {keys}, list(x ORDER BY i) AS v FROM (SELECT {keys}, i, sum({scale} * {v}[i]) AS x FROM (SELECT *, unnest(range(1, {W + 1})) AS i FROM {src}) GROUP BY {keys}, i) GROUP BY {keys}"


@query(
    f"""WITH x AS (SELECT vec_id, unnest([2, 3]) AS n FROM embeddings), k AS (SELECT vec_id, n, CAST(unnest(range(0, 2)) AS BIGINT) AS head FROM x),
a AS (SELECT vec_id, n, (vec_id * (head + n)) % 6 - 1 AS pos FROM k), m AS (SELECT vec_id, n, list_transform(range(0, 6), lambda j: 0.0) AS z, list(pos) AS ats FROM a GROUP BY vec_id, n),
g AS (SELECT vec_id, n, list_transform(range(0, 6), lambda j: list_sum(list_transform(ats, lambda q: CASE WHEN q >= 0 THEN {_a('q', 'j', 'n')} ELSE 0 END)) / greatest(list_sum(list_transform(ats, lambda q: CASE WHEN q >= 0 THEN 1 ELSE 0 END)), 1)) AS mean FROM m),
o AS (SELECT vec_id, n, {_mv(W, 'mean', 'n + 4', 6)} AS v FROM g), s AS ({_summed('o', 'vec_id', "CASE n WHEN 2 THEN tanh(0.3) ELSE tanh(-0.2) END", 'v')})
SELECT vec_id, {_out('v')} FROM s"""
)
def hash_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two orders' tables gathered by two heads, -1 being no address, then averaged and projected."""
    arrays = {"hash2": _p(5, 6, 2), "hash3": _p(5, 6, 3), "hash_projection2": _p(W, 6, 6), "hash_projection3": _p(W, 6, 7), "hash_gate2": [[0.3]], "hash_gate3": [[-0.2]]}
    p = Y.parameters(_table(spark, arrays))
    Y.need(p, hash2=(None, 6), hash3=(None, 6), hash_projection2=(W, 6), hash_projection3=(W, 6))
    at = lambda n: F.array(*((F.col("vec_id") * (head + n)) % 6 - 1 for head in range(2)))
    df = table(spark, sf_dir, "embeddings").select("vec_id", at(2).alias("a2"), at(3).alias("a3"))
    return _sums(Y.over_rows(df, "vec_id", ["a2", "a3"], lambda a2, a3: Y.hash_memory({2: a2.astype(int), 3: a3.astype(int)}, p)), "vec_id")


_SK = f"""sc AS (SELECT vec_id, label, v, CAST(s AS BIGINT) AS s, list_dot_product({_unit('v')}, {_unit(_row('s', W, 1))}) AS score FROM (SELECT *, unnest(range(0, {SKILLS})) AS s FROM h)),
sk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(score) DESC, s) AS r FROM sc) WHERE r <= {TOP}),
sw AS (SELECT *, score / (sum(abs(score)) OVER (PARTITION BY vec_id) + {E}) AS w, {_mv(RANK, 'v', f'2 + 7 * {RANK} * s')} AS low FROM sk),
so AS (SELECT *, list_transform(range(0, {W}), lambda j: list_sum(list_transform(range(0, {RANK}), lambda q: low[q + 1] * ({_a(f'{RANK} * s + q', 'j', 5)})))) AS o FROM sw)"""


def _skill_arrays() -> dict:
    return {"skill_anchor": _p(SKILLS, W, 1), "skill_a": _p(SKILLS * RANK, W, 2), "skill_b": _p(SKILLS * RANK, W, 5)}


@query(f"WITH {_H}, {_SK}, z AS ({_summed('so', 'vec_id', 'w', 'o')}) SELECT vec_id, {_out('v')} FROM z")
def skill_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two skills nearest in cosine, each a product of low rank, under signed weights."""
    p = Y.parameters(_table(spark, _skill_arrays()))
    Y.need(p, skill_anchor=(SKILLS, W), skill_a=(SKILLS * RANK, W), skill_b=(SKILLS * RANK, W))
    return _sums(Y.over_rows(_states(spark, sf_dir), "vec_id", ["v"], lambda h: Y.skills(h, p, TOP, RANK)[0]), "vec_id")


def _expert_arrays() -> dict:
    out = {"expert_anchor": _p(EXPERTS, W, 4), "adjacency": [[float((s + e) % 3 == 0) for e in range(EXPERTS)] for s in range(SKILLS)]}
    for e in range(EXPERTS):
        for b in range(BRANCHES):
            q = f"expert{e}.{b}"
            out |= {f"{q}.content": _p(6, W, 5 + 2 * e + b), f"{q}.content_bias": _p(1, 6, e + b), f"{q}.gate": _p(6, W, 7 + 3 * e + b), f"{q}.gate_bias": _p(1, 6, 9 + e), f"{q}.output": _p(W, 6, 11 + e + 2 * b), f"{q}.evidence": _p(1, W, 3 + e + b)}
    return out


def _sql_expert(src: str, keep: str) -> str:
    """eo(keep, e, v): what expert e makes of v, for rows of ``src`` (keep, e, v)."""
    return f"""eb AS (SELECT *, CAST(unnest(range(0, {BRANCHES})) AS BIGINT) AS b FROM {src}),
ec AS (SELECT *, {_add(_mv(6, 'v', '5 + 2 * e + b'), _row('0', 6, 'e + b'))} AS c, {_add(_mv(6, 'v', '7 + 3 * e + b'), _row('0', 6, '9 + e'))} AS g FROM eb),
ex AS (SELECT *, list_transform(list_zip(c, g), lambda z: tanh(z[1]) * {_sig('z[2]')}) AS x FROM ec),
ey AS (SELECT *, {_mv(W, 'x', '11 + e + 2 * b', 6)} AS y FROM ex),
ez AS (SELECT *, list_dot_product({_unit('y')}, {_unit(_row('0', W, '3 + e + b'))}) AS score FROM ey),
ew AS (SELECT *, score / (sum(abs(score)) OVER (PARTITION BY {keep}, e) + {E}) AS bw FROM ez),
eo AS ({_summed('ew', f'{keep}, e', 'bw', 'y')})"""


@query(f"WITH {_H}, src AS (SELECT vec_id, vec_id % {EXPERTS} AS e, v FROM h), {_sql_expert('src', 'vec_id')} SELECT vec_id, {_out('v')} FROM eo")
def expert_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expert for each state: gated branches mixed by signed evidence."""
    p = Y.parameters(_table(spark, _expert_arrays()))

    def run(h: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.zeros_like(h)
        for k in np.unique(e).astype(int):
            out[e == k] = Y.expert(h[e == k], p, f"expert{k}", BRANCHES)
        return out

    states = _states(spark, sf_dir).withColumn("e", F.col("vec_id") % EXPERTS)
    return _sums(Y.over_rows(states, "vec_id", ["v", "e"], run), "vec_id")


_EX = f"""al AS (SELECT DISTINCT sk.vec_id, sk.v, e FROM sk, (SELECT CAST(unnest(range(0, {EXPERTS})) AS BIGINT) AS e) WHERE (s + e) % 3 = 0),
as_ AS (SELECT *, list_dot_product({_unit('v')}, {_unit(_row('e', W, 4))}) AS score FROM al),
ak AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(score) DESC, e) AS r FROM as_) WHERE r <= {TOP}),
aw AS (SELECT vec_id, e, v, score / (sum(abs(score)) OVER (PARTITION BY vec_id) + {E}) AS w FROM ak), src AS (SELECT vec_id, e, v FROM aw)"""


@query(f"WITH {_H}, {_SK}, {_EX}, {_sql_expert('src', 'vec_id')}, eu AS (SELECT eo.vec_id, eo.v, w FROM eo JOIN aw USING (vec_id, e)), z AS ({_summed('eu', 'vec_id', 'w', 'v')}) SELECT h.vec_id, coalesce({_r('list_sum(z.v)')}, 0) AS total, coalesce({_r(f'sqrt({_sq("z.v")})')}, 0) AS norm FROM h LEFT JOIN z USING (vec_id)")
def conditional_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the experts adjacent to an active skill the two nearest; a state without one has no update."""
    p = Y.parameters(_table(spark, _skill_arrays() | _expert_arrays()))

    def run(h: np.ndarray) -> np.ndarray:
        return Y.experts(h, Y.skills(h, p, TOP, RANK)[1] != 0, p, TOP, BRANCHES)

    return _sums(Y.over_rows(_states(spark, sf_dir), "vec_id", ["v"], run), "vec_id")


_DR = f"""ds AS (SELECT vec_id, v, CAST(s AS BIGINT) AS s, list_dot_product({_unit('v')}, {_unit(_row('s', W, 8))}) AS score FROM (SELECT *, unnest(range(0, 4)) AS s FROM h)),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(score) DESC, s) AS r FROM ds) WHERE r <= {TOP}),
dw AS (SELECT vec_id, score / (sum(abs(score)) OVER (PARTITION BY vec_id) + {E}) * list_dot_product(v, {_row('s', W, 8)}) AS w, {_row('s', W, 10)} AS o FROM dk)"""


@query(
    f"""WITH {_H}, {_SK}, {_EX}, {_sql_expert('src', 'vec_id')}, {_DR}, u AS (SELECT vec_id, tanh(0.4) * w AS w, o FROM dw UNION ALL SELECT vec_id, tanh(-0.3) * w, o FROM so UNION ALL SELECT eo.vec_id, tanh(0.2) * w, eo.v FROM eo JOIN aw USING (vec_id, e)),
z AS ({_summed('u', 'vec_id', 'w', 'o')}) SELECT vec_id, {_out('v')} FROM z"""
)
def gated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions, skills and experts under their gates."""
    p = Y.parameters(_table(spark, _skill_arrays() | _expert_arrays() | {"alpha": _p(4, W, 8), "beta": _p(4, W, 10), "level_gates": [[0.4, -0.3, 0.2]]}))
    return _sums(Y.over_rows(_states(spark, sf_dir), "vec_id", ["v"], lambda h: Y.gated_sum(h, p, TOP, RANK, TOP, BRANCHES)), "vec_id")


@query(f"WITH {_H}, b AS (SELECT *, CAST(unnest([0, 1]) AS INTEGER) AS block FROM h), z AS (SELECT vec_id, block, list_transform(v, lambda y: tanh(0.5) * y + CASE WHEN block = 1 THEN tanh(-0.7) * y * y ELSE 0 END) AS v FROM b) SELECT vec_id, block, {_out('v')} FROM z")
def memory_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two memory parts under their gates; the late one enters in block one only."""
    p = Y.parameters(_table(spark, {"gate_early": [[0.5]], "gate_late": [[-0.7]]}))
    out = None
    for block in (0, 1):
        part = Y.over_rows(_states(spark, sf_dir), "vec_id", ["v"], lambda h, block=block: Y.fused_memory(h, {"early": h, "late": h**2}, p, block)).withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    return _sums(out, "vec_id", "block")


BITS, CELL = 2, 3
ROUTES, ALPHABET = W // BITS, 1 << BITS


def _sql_order(n: int) -> str:
    """Recalled rows, keys, values and scores of one order, from y(label, t, v, s1, s2): symbols now and before."""
    at = f"r * {ALPHABET**n} + " + " + ".join(f"s{n - 1 - j}[r + 1] * {ALPHABET**j}" for j in range(n))
    zero = "list_transform(range(0, %d), lambda j: 0.0)" % (ROUTES * CELL)
    return f"""f{n} AS (SELECT *, t >= {n - 1} AS ok, CASE WHEN t >= {n - 1} THEN list_transform(range(0, {ROUTES * CELL}), lambda c: {_a(f'list_transform(range(0, {ROUTES}), lambda r: {at})[c // {CELL} + 1]', f'c % {CELL}', n)}) ELSE {zero} END AS flat FROM y),
k{n} AS (SELECT label, t, v, ok, {_rms(_add(_mv(W, 'flat', 6, ROUTES * CELL), _row('0', W, 2)))} AS key, {_add(_mv(W, 'flat', 9, ROUTES * CELL), _row('0', W, 12))} AS val FROM f{n}),
o{n} AS (SELECT label, t, v, val AS val{n}, CASE WHEN ok THEN 1.0 ELSE 0.0 END / (list_sum(list_transform(list_zip({_rms('v')}, key), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / {W} + {E}) AS sc{n} FROM k{n})"""


@query(
    f"""WITH {_H}, q AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, v FROM h),
b AS (SELECT *, {_mv(W, _rms('v'), 3)} AS on_ FROM q),
s AS (SELECT label, t, v, list_transform(range(0, {ROUTES}), lambda r: CAST(list_sum(list_transform(range(0, {BITS}), lambda j: CASE WHEN on_[r * {BITS} + j + 1] > 0 THEN 1 << j ELSE 0 END)) AS BIGINT)) AS s0 FROM b),
y AS (SELECT *, lag(s0, 1) OVER w AS s1, lag(s0, 2) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY label ORDER BY t)), {_sql_order(2)}, {_sql_order(3)},
u AS (SELECT o2.*, val3, sc3 FROM o2 JOIN o3 USING (label, t)), m AS (SELECT label, t, v, list_transform(list_zip(val2, val3), lambda z: (sc2 * z[1] + sc3 * z[2]) / (sc2 + sc3 + {E})) AS fused FROM u),
n AS (SELECT *, {_rms('fused')} AS nm FROM m), c AS (SELECT *, lag(nm, 1) OVER w AS n1, lag(nm, 2) OVER w AS n2 FROM n WINDOW w AS (PARTITION BY label ORDER BY t)),
x AS (SELECT *, list_transform(range(0, {W}), lambda i: ({_a('0', 'i', 1)}) + nm[i + 1] * ({_a('i', '2', 5)}) + coalesce(n1[i + 1], 0) * ({_a('i', '1', 5)}) + coalesce(n2[i + 1], 0) * ({_a('i', '0', 5)})) AS mixed FROM c),
z AS (SELECT label, t, list_transform(range(0, {W}), lambda i: v[i + 1] + tanh(0.6) * (fused[i + 1] + mixed[i + 1] * {_sig('mixed[i + 1]')})) AS v FROM x)
SELECT label, t, {_out('v')} FROM z"""
)
def latent_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent bigrams and trigrams of each label's sequence: recalled, weighed by distance, convolved and added."""
    arrays = {"address": _p(W, W, 3), "table2": _p(ROUTES * ALPHABET**2, CELL, 2), "table3": _p(ROUTES * ALPHABET**3, CELL, 3), "key": _p(W, ROUTES * CELL, 6), "key_bias": _p(1, W, 2), "value": _p(W, ROUTES * CELL, 9), "value_bias": _p(1, W, 12), "conv": _p(W, 3, 5), "conv_bias": _p(1, W, 1), "gate": [[0.6]]}
    p = Y.parameters(_table(spark, arrays))
    Y.need(p, address=(W, W), table2=(None, CELL), table3=(None, CELL), conv=(W, 3))
    df = _states(spark, sf_dir).withColumn("t", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return _sums(Y.over_sequences(df, "label", "t", "v", lambda h: Y.latent_memory(h, p, BITS)), "label", "t")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN vec_id % 40 ELSE (vec_id * 7) % 50 END AS address FROM embeddings")
def forced_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides that are not negative take the place of computed addresses."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    computed = ids.select("vec_id", ((F.col("vec_id") * 7) % 50).alias("address"))
    return L.forced(computed, ids.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 40).otherwise(-1).alias("address")), ["vec_id"], 50)


@query(f"WITH {_H}, z AS (SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN v ELSE {_mv(W, 'v', 'vec_id % 4')} END AS v FROM h) SELECT vec_id, {_out('v')} FROM z")
def joint_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources have a matrix each, the fourth passes unchanged."""
    matrices = spark.createDataFrame([(f"s{k}", _p(W, W, k)) for k in range(3)], "source string, rows array<array<double>>")
    df = _states(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")))
    return _sums(G.transfer(df, matrices), "vec_id", v="joint")


@query(f"WITH {_H}, z AS (SELECT vec_id, list_transform(range(0, {W}), lambda i: CASE WHEN i < 3 THEN 0.0 ELSE v[i + 1] END) AS v, v[1:3] AS c FROM h) SELECT vec_id, {_out('v')}, {_r('list_sum(c)')} AS coordinates FROM z")
def orthogonal_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a state beside the first three axes."""
    basis = spark.createDataFrame([([[float(i == j) for j in range(W)] for i in range(3)],)], "components array<array<double>>")
    out = S.residual(_states(spark, sf_dir), basis, "v")
    return out.select("vec_id", V.tidy(V.total(F.col("residual"))).alias("total"), V.tidy(F.sqrt(V.sum_squares(F.col("residual")))).alias("norm"), V.tidy(V.total(F.col("coordinates"))).alias("coordinates"))


@query(
    f"""WITH q AS (SELECT p_partkey % 20 AS a, p_partkey // 20 AS l FROM part WHERE p_partkey % 3 <> 1), d AS (SELECT a, l, unnest(range(0, 4)) AS o FROM q), e AS (SELECT *, unnest(range(0, 5)) AS i FROM d),
x AS (SELECT a, l, o, i, list_sum(list_transform(range(0, 2), lambda k: ({_a('o', 'k', 'l')}) * ({_a('k', 'i', 'a')}))) * (CASE WHEN l % 10 = 0 THEN 16.0 ELSE 8.0 END) / (CASE WHEN l % 10 = 5 THEN 4.0 ELSE 2.0 END) AS y FROM e)
SELECT CAST(a AS VARCHAR) AS adapter, CAST(l AS INTEGER) AS layer, 'q_proj' AS module, {_r('sum(y)')} AS total, {_r('sqrt(sum(y * y))')} AS norm FROM x GROUP BY a, l"""
)
def adapter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors paired by key; every third has no other half; patterns override alpha and rank for some layers."""
    k = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("a"), F.floor(F.col("p_partkey") / 20).alias("l"), (F.col("p_partkey") % 3 != 1).alias("whole"))
    value = lambda i, j, s: ((7 * i + 3 * j + s) % 13 - 6) / 10.0
    rows = lambda n, m, s: F.array(*(F.array(*(value(F.lit(i), F.lit(j), F.col(s)) for j in range(m))) for i in range(n)))
    key = lambda kind: F.concat(F.lit("base_model.model.model.layers."), F.col("l").cast("string"), F.lit(f".self_attn.q_proj.lora_{kind}.weight"))
    common = [F.col("a").cast("string").alias("adapter"), F.lit(8.0).alias("alpha"), F.lit(2).alias("r")]
    a = k.select(*common, key("A").alias("key"), F.lit("A").alias("kind"), rows(2, 5, "a").alias("rows"))
    b = k.where("whole").select(*common, key("B").alias("key"), F.lit("B").alias("kind"), rows(4, 2, "l").alias("rows"))
    out = S.lora_deltas(a.unionByName(b), alpha_pattern={r"layers\.\d*0\.": 16.0}, rank_pattern={r"layers\.\d*5\.": 4})
    flat = F.flatten("rows")
    return out.select("adapter", "layer", "module", V.tidy(V.total(flat)).alias("total"), V.tidy(F.sqrt(V.sum_squares(flat))).alias("norm"))
