"""Vector queries over ``embeddings``: sequences are labels, steps the order of vec_id within one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import capacity as K
from ..operators import geometry as G
from ..operators import latent as L
from ..operators import routing as R
from ..operators import subspace as S
from .catalog import query, table

E = G.EPSILON
WINDOW, NEAREST = 8, 4


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return _vectors(spark, sf_dir).withColumn("t", t)


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_T = f"{_V}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t FROM v)"
_sq = lambda v: f"list_sum(list_transform({v}, lambda y: y * y))"
_unit = lambda v: f"list_transform({v}, lambda x: x / greatest(sqrt({_sq(v)}), 1e-12))"
_rms = lambda v: f"list_transform({v}, lambda x: x / sqrt({_sq(v)} / len({v}) + {E}))"
_d2 = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_r = lambda x: f"round({x}, 6) + 0.0"


@query(f"WITH {_V} SELECT vec_id, {_r(f'sqrt({_sq(_unit('v'))})')} AS norm, {_r(f'({_unit('v')})[1]')} AS first, {_r(f'({_unit('v')})[64]')} AS last FROM v")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).select("vec_id", V.l2_normalize(F.col("v")).alias("u"))
    return df.select("vec_id", V.tidy(F.sqrt(V.sum_squares(F.col("u")))).alias("norm"), V.tidy(F.get("u", F.lit(0))).alias("first"), V.tidy(F.get("u", F.lit(63))).alias("last"))


BITS = 4
_sym = f"list_transform(range(0, {64 // BITS}), lambda r: CAST(list_sum(list_transform(range(0, {BITS}), lambda j: CASE WHEN v[r * {BITS} + j + 1] > 0 THEN 1 << j ELSE 0 END)) AS BIGINT))"


@query(f"WITH {_T} SELECT label, t, CAST(unnest(range(0, {64 // BITS})) AS INTEGER) AS route, unnest({_sym}) AS symbol FROM s")
def latent_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.symbol_rows(_states(spark, sf_dir), "label", "t", "v", BITS)


def _sql_addresses(order: int) -> str:
    terms = " + ".join(f"lag(symbol, {order - 1 - j}) OVER w * {16**j}" for j in range(order))
    return f"WITH {_T}, y AS (SELECT label, t, CAST(unnest(range(0, {64 // BITS})) AS INTEGER) AS route, unnest({_sym}) AS symbol FROM s) SELECT label, t, route, route * {16**order} + {terms} AS address FROM y WINDOW w AS (PARTITION BY label, route ORDER BY t)"


@query(_sql_addresses(2))
def latent_addresses_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.addresses(_states(spark, sf_dir), "label", "t", "v", BITS, 2)


@query(_sql_addresses(3))
def latent_addresses_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.addresses(_states(spark, sf_dir), "label", "t", "v", BITS, 3)


_LN2 = math.log(2.0)


def _sql_pool(n: float = 2.0) -> str:
    """From c(key columns, q, v, e, s): masses, residual and movement."""
    return f"""
m AS (SELECT *, pow(s, {-0.5 * n}) AS inv FROM c),
z AS (SELECT k, sum(inv) AS zi, sum(e) AS ze FROM m GROUP BY k),
g AS (SELECT m.*, inv / (zi + {E}) AS p, e / (ze + {E}) AS y FROM m JOIN z USING (k)),
mv AS (SELECT k, sqrt(sum(x * x)) AS norm FROM (SELECT k, i, sum({n} * (y - p) * (v[i] - q[i]) / s) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM g) GROUP BY k, i) GROUP BY k),
r AS (SELECT k, count(*) AS anchors, sum(greatest(y - p, 0)) AS attraction, sum(greatest(p - y, 0)) AS repulsion, -sum(y * ln(greatest(p, {E}))) AS residual FROM g GROUP BY k)"""


@query(
    f"""WITH {_T}, h AS (SELECT label, t, {_rms('v')} AS q, count(*) OVER (PARTITION BY label) AS n FROM s), hw AS (SELECT *, least({WINDOW}, greatest(n - 1, 1)) AS w FROM h),
a AS (SELECT x.label * 1000000 + x.t AS k, x.q, b.q AS v, {_LN2!r} AS e, {_d2('b.q', 'x.q')} + {_LN2!r} * pow((x.t - b.t) / x.w::DOUBLE, 2) AS s0, x.t - b.t AS o, x.w FROM hw x JOIN hw b ON b.label = x.label AND b.t < x.t AND b.t >= x.t - x.w),
c0 AS (SELECT k, q, v, e, s0 + {E**2!r} AS s, row_number() OVER (PARTITION BY k ORDER BY s0, o) AS rn FROM a), c AS (SELECT * FROM c0 WHERE rn <= {NEAREST} UNION ALL SELECT label * 1000000 + t, q, q, {_LN2!r}, {_LN2!r} / (w * w) + {E**2!r}, 1 FROM hw WHERE t = 0),
{_sql_pool()} SELECT CAST(r.k // 1000000 AS INTEGER) AS label, CAST(r.k % 1000000 AS INTEGER) AS t, anchors, {_r('attraction')} AS attraction, {_r('repulsion')} AS repulsion, {_r('residual')} AS residual, {_r('norm')} AS movement FROM r JOIN mv USING (k)"""
)
def harmax_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = G.harmonic_causal(_states(spark, sf_dir), "label", "t", "v", WINDOW, NEAREST)
    return df.select("label", "t", *_pool_columns())


def _pool_columns():
    return [F.size("pool.distance_mass").cast("long").alias("anchors"), *(V.tidy(F.col(f"pool.{c}")).alias(c) for c in ("attraction", "repulsion", "residual")), V.tidy(F.sqrt(V.sum_squares(F.col("pool.movement")))).alias("movement")]


@query(
    f"""WITH {_V}, c AS (SELECT a.vec_id AS k, {_rms('a.v')} AS q, {_rms('b.v')} AS v, CASE WHEN b.vec_id % 3 = 0 THEN 0.0 ELSE (b.vec_id % 5 + 1) / 2.0::DOUBLE END AS e, {_d2(_rms('b.v'), _rms('a.v'))} + {E**2!r} AS s FROM v a JOIN v b ON b.vec_id // 10 = a.vec_id // 10 AND b.vec_id <> a.vec_id),
{_sql_pool()} SELECT r.k AS vec_id, anchors, {_r('attraction')} AS attraction, {_r('repulsion')} AS repulsion, {_r('residual')} AS residual, {_r('norm')} AS movement FROM r JOIN mv USING (k)"""
)
def harmax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("block", F.floor(F.col("vec_id") / 10))
    entry = F.struct("vec_id", "v", ((F.col("vec_id") % 5 + 1) / 2.0).alias("evidence"), (F.col("vec_id") % 3 != 0).alias("supported"))
    groups = v.groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    pools = v.join(groups, "block").withColumn("anchors", F.filter("all", lambda a: a["vec_id"] != F.col("vec_id"))).where(F.exists("anchors", lambda a: a["supported"]))
    return G.contract_pool(pools, ["vec_id"], "v", "anchors").select("vec_id", *_pool_columns())


@query(
    f"""WITH {_V}, c AS (SELECT a.vec_id AS k, a.v AS q, b.v AS v, {_d2('a.v', 'b.v')} / 64 + {E**2!r} AS s, b.vec_id AS row FROM v a JOIN v b ON b.label = a.label AND b.vec_id % 50 = 0 AND a.vec_id % 50 <> 0),
w AS (SELECT *, (1 / s) / (sum(1 / s) OVER (PARTITION BY k) + {E}) AS w FROM c),
mv AS (SELECT k, sqrt(sum(x * x)) AS movement FROM (SELECT k, i, sum(w * v[i]) - any_value(q[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM w) GROUP BY k, i) GROUP BY k)
SELECT k AS vec_id, count(*) AS senses, {_r('sum(w)')} AS mass, {_r('min(s)')} AS nearest, {_r('any_value(movement)')} AS movement FROM w JOIN mv USING (k) GROUP BY k"""
)
def definition_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    states = v.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), "v")
    df = G.definition_fields(states, v.where("vec_id % 50 = 0").select(F.col("label").alias("group"), "v"))
    return df.select(F.col("id").alias("vec_id"), "senses", V.tidy(F.col("mass")).alias("mass"), V.tidy(F.col("nearest")).alias("nearest"), V.tidy(F.sqrt(V.sum_squares(F.col("movement")))).alias("movement"))


@query(
    f"""WITH {_V}, p AS (SELECT vec_id AS id, v AS ref, list_transform(range(1, 65), lambda i: v[i] * 0.9 + v[(i % 64) + 1] * 0.05) AS prj FROM v),
n AS (SELECT * FROM (SELECT a.id, b.id AS other, sqrt({_d2('a.ref', 'b.ref')}) AS d, sqrt({_d2('a.prj', 'b.prj')}) AS o, row_number() OVER (PARTITION BY a.id ORDER BY sqrt({_d2('a.ref', 'b.ref')}), b.id) AS rn FROM p a JOIN p b ON a.id <> b.id) WHERE rn <= 8),
g AS (SELECT abs(o / sc - d / sc) AS g FROM n, (SELECT greatest(avg(d), {E}) AS sc FROM n)), l AS (SELECT avg(CASE WHEN g < 1 THEN 0.5 * g * g ELSE g - 0.5 END) AS loc FROM g), q AS (SELECT sum({_d2('prj', 'ref')}) / sum(len(prj)) AS pt FROM p)
SELECT {_r('pt')} AS point_loss, {_r('loc')} AS locality_loss, {_r('pt + loc')} AS total_loss FROM l, q"""
)
def knn_locality_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, neighbours among all, against a fixed smoothing of them."""
    return _locality(_vectors(spark, sf_dir))


def _locality(v: DataFrame) -> DataFrame:
    shifted = F.transform("v", lambda x, i: x * 0.9 + F.get("v", (i + 1) % 64) * 0.05)
    out = G.locality_loss(v.select("vec_id", F.col("v").alias("r"), shifted.alias("p")), "vec_id", "p", "r", blocks=True)
    return out.select(*(V.tidy(F.col(c)).alias(c) for c in ("point_loss", "locality_loss", "total_loss")))


_SCORES = f"v0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), sc AS (SELECT a.vec_id, b.vec_id AS token_id, -({_d2('a.u', 'b.u')}) / 64 AS score FROM (SELECT vec_id, {_unit('v')} AS u FROM (SELECT vec_id, {_rms('v')} AS v FROM v0)) a, (SELECT vec_id, {_unit('v')} AS u FROM v0) b)"


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """All states against all vectors as the vocabulary."""
    v = _vectors(spark, sf_dir)
    return G.block_scores(v.select(F.col("vec_id").alias("id"), "v"), v.select(F.col("vec_id").alias("token_id"), "v"), k).withColumnRenamed("id", "vec_id")


@query(f"WITH {_SCORES} SELECT vec_id, CAST(rank AS INTEGER) AS rank, token_id, {_r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token_id) AS rank FROM sc) WHERE rank <= 5")
def vocab_scores_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 5).withColumn("score", V.tidy(F.col("score")))


@query(f"WITH {_SCORES} SELECT vec_id, token_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token_id) AS rank FROM sc) WHERE rank = 1")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 1).select("vec_id", "token_id")


@query(
    f"""WITH {_SCORES}, t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -100 ELSE vec_id // 10 * 10 END AS target FROM embeddings), j AS (SELECT sc.*, target FROM sc JOIN t USING (vec_id) WHERE target <> -100),
p AS (SELECT vec_id, score AS pos FROM j WHERE token_id = target), n AS (SELECT * FROM (SELECT vec_id, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) AS r FROM j WHERE token_id <> target) WHERE r <= 8)
SELECT {_r('sum(greatest(0, 0.2 - pos + score)) / count(*)')} AS loss FROM n JOIN p USING (vec_id)"""
)
def rank_margin_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight strongest negatives are among the nine best tokens; the target is scored by itself."""
    v, near = _vectors(spark, sf_dir), _best(spark, sf_dir, 9)
    aim = v.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.lit(-100)).otherwise(F.floor(F.col("vec_id") / 10) * 10).alias("target"), V.l2_normalize(V.rms_norm(F.col("v"))).alias("u")).where("target <> -100")
    pos = aim.join(v.select(F.col("vec_id").alias("target"), V.l2_normalize(F.col("v")).alias("t")), "target").select("vec_id", "target", (-V.squared_distance(F.col("t"), F.col("u")) / F.size("u")).alias("pos"))
    order = Window.partitionBy("vec_id").orderBy("rank")
    neg = near.join(pos, "vec_id").where("token_id <> target").withColumn("r", F.row_number().over(order)).where("r <= 8")
    return neg.agg(V.tidy(F.coalesce(F.sum(F.greatest(F.lit(0.0), 0.2 - F.col("pos") + F.col("score"))) / F.count("*"), F.lit(0.0))).alias("loss"))


@query(f"WITH {_T}, p AS (SELECT label, v AS c, lag(v) OVER (PARTITION BY label ORDER BY t) AS b FROM s) SELECT label, {_r(f'sqrt(sum({_d2('c', 'b')}) / sum(len(b))) / (sqrt(sum({_sq('b')}) / sum(len(b))) + {E})')} AS change FROM p WHERE b IS NOT NULL GROUP BY label")
def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _states(spark, sf_dir).withColumn("b", F.lag("v").over(Window.partitionBy("label").orderBy("t"))).where("b IS NOT NULL")
    return G.relative_change(df, "label", "v", "b").select("label", V.tidy(F.col("change")).alias("change"))


_ROUTES = f"""WITH {_V}, a AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, {_unit('v')} AS u FROM v WHERE vec_id % 50 = 0), sc AS (SELECT x.vec_id, a.idx, list_dot_product({_unit('x.v')}, a.u) AS s FROM v x, a),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(s) DESC, idx) AS r FROM sc), m AS (SELECT *, sum(abs(s)) OVER (PARTITION BY vec_id) AS z FROM k WHERE r <= 4)"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("vec_id")  # a parameter table of a few rows
    return _vectors(spark, sf_dir).where("vec_id % 50 = 0").withColumn("index", (F.row_number().over(w) - 1).cast("int")).select("index", "v")


@query(f"{_ROUTES} SELECT vec_id, CAST(r - 1 AS INTEGER) AS position, CAST(idx AS INTEGER) AS index, {_r(f's / (z + {E})')} AS weight FROM m")
def signed_topk_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.signed_routes(_vectors(spark, sf_dir), ["vec_id"], "v", _anchors(spark, sf_dir), 4).withColumn("weight", V.tidy(F.col("weight")))


@query(f"{_ROUTES}, b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, v FROM v WHERE vec_id % 50 = 0), u AS (SELECT m.vec_id, i, sum(s / (z + {E}) * list_dot_product(x.v, b.v) * b.v[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM m) m JOIN b USING (idx) JOIN v x ON x.vec_id = m.vec_id GROUP BY m.vec_id, i) SELECT vec_id, {_r('sqrt(sum(x * x))')} AS norm FROM u GROUP BY vec_id")
def direction_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    directions = _anchors(spark, sf_dir).select("index", F.col("v").alias("alpha"), F.col("v").alias("beta"))
    out = R.direction_update(_vectors(spark, sf_dir), ["vec_id"], "v", directions, 4)
    return out.select("vec_id", V.tidy(F.sqrt(V.sum_squares(F.col("update")))).alias("norm"))


_SKILLS = "list_sort(list_distinct(list_transform(string_split(ps, ','), lambda x: CAST(x AS INTEGER))))"
_EXPERTS = "x AS (SELECT CAST(user_id AS VARCHAR) AS expert_id, CASE WHEN user_id % 3 = 0 THEN 'click' ELSE 'other' END AS task_relation, list_distinct(list(CAST(event_id % 40 AS INTEGER))) AS skill_ids, list_distinct(list(event_type)) AS concept_ids, count(*) AS success_count FROM events GROUP BY user_id)"
_REQUESTS = "q AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 2 = 0 THEN 'click' END AS task_relation, [p_size % 40, p_partkey % 40] AS skill_ids, CASE WHEN p_partkey % 4 = 0 THEN ['view'] ELSE ['none'] END AS concept_ids FROM part)"


@query(
    f"""WITH {_EXPERTS}, {_REQUESTS}, c AS (SELECT request_id, expert_id, list_sort(list_intersect(x.skill_ids, list_distinct(q.skill_ids))) AS skills, list_sort(list_intersect(x.concept_ids, q.concept_ids)) AS concepts, coalesce(x.task_relation = q.task_relation, false) AS task_match, success_count FROM q, x WHERE list_has_any(x.skill_ids, q.skill_ids) OR list_has_any(x.concept_ids, q.concept_ids))
SELECT request_id, CAST(rank AS INTEGER) AS rank, expert_id, skills, concepts, task_match FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CAST(task_match AS INTEGER) DESC, len(concepts) DESC, len(skills) DESC, success_count DESC, expert_id) AS rank FROM c) WHERE rank <= 8"""
)
def expert_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user an expert, every part a request."""
    return R.route_experts(_experts(table(spark, sf_dir, "events")), _requests(table(spark, sf_dir, "part")))


def _experts(events: DataFrame) -> DataFrame:
    e = events.groupBy("user_id").agg(F.collect_set((F.col("event_id") % 40).cast("int")).alias("skill_ids"), F.collect_set("event_type").alias("concept_ids"), F.count("*").alias("success_count"))
    return e.select(F.col("user_id").cast("string").alias("expert_id"), F.when(F.col("user_id") % 3 == 0, "click").otherwise("other").alias("task_relation"), "skill_ids", "concept_ids", "success_count")


def _requests(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("request_id"), F.when(F.col("p_partkey") % 2 == 0, "click").alias("task_relation"), F.array((F.col("p_size") % 40).cast("int"), (F.col("p_partkey") % 40).cast("int")).alias("skill_ids"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("view"))).otherwise(F.array(F.lit("none"))).alias("concept_ids"))


@query("SELECT DISTINCT user_id, s AS expert_id FROM (SELECT DISTINCT user_id, event_type FROM events) JOIN (SELECT DISTINCT event_type, user_id % 16 AS s FROM events) USING (event_type)")
def skill_expert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    active = events.select("user_id", F.col("event_type").alias("skill_id"))
    return R.adjacent_experts(active, events.select(F.col("event_type").alias("skill_id"), (F.col("user_id") % 16).alias("expert_id")), "user_id")


@query(
    f"WITH {_V}, u AS (SELECT CAST(label AS VARCHAR) AS source, {_unit('v')} AS u FROM v), x AS (SELECT source, i, avg(u[i]) AS m, avg(u[i] * u[i]) AS d FROM (SELECT *, unnest(range(1, 65)) AS i FROM u) GROUP BY source, i) SELECT source, (SELECT count(*) FROM u WHERE u.source = x.source) AS n, {_r('sum(m)')} AS mean_sum, {_r('sum(d)')} AS trace, {_r('sum(m * m)')} AS mean_square FROM x GROUP BY source"
)
def vector_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.moments(_vectors(spark, sf_dir), "v", 64, "label")
    trace = V.total(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("second", i * 65)))
    return out.select("source", "n", V.tidy(V.total(F.col("mean"))).alias("mean_sum"), V.tidy(trace).alias("trace"), V.tidy(V.sum_squares(F.col("mean"))).alias("mean_square"))


@query()
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = S.balanced_pca(S.moments(_vectors(spark, sf_dir), "v", 64, "label"), 16)
    return basis.select(F.posexplode("ratio").alias("component", "ratio")).select((F.col("component") + 1).alias("component"), V.tidy(F.col("ratio")).alias("ratio"))


@query()
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.project(v, S.balanced_pca(S.moments(v, "v", 64), 32), "v").select("vec_id", V.tidy(F.col("cosine")).alias("cosine"))


_RATIOS = f"{_V}, u AS (SELECT {_unit('v')} AS u FROM v), d AS (SELECT i, avg(u[i] * u[i]) - avg(u[i]) * avg(u[i]) AS d FROM (SELECT *, unnest(range(1, 65)) AS i FROM u) GROUP BY i), r AS (SELECT row_number() OVER (ORDER BY d DESC, i) AS rank, d / sum(d) OVER () AS ratio FROM d)"


@query(f"WITH {_RATIOS}, c AS (SELECT rank, sum(ratio) OVER (ORDER BY rank) AS c FROM r), k AS (SELECT * FROM c WHERE rank IN (16, 32, 64)) SELECT rank, {_r('c')} AS explained, c >= 0.7 AS reached FROM k ORDER BY (c >= 0.7) DESC, CASE WHEN c >= 0.7 THEN rank ELSE -rank END LIMIT 1")
def rank_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the variances of the 64 coordinates over all vectors, largest first
    own = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("second", i * 65) - F.get("mean", i) * F.get("mean", i))
    spectrum = F.transform(F.array_sort(F.transform(own, lambda x: -x)), lambda x: -x)
    ratios = S.moments(_vectors(spark, sf_dir), "v", 64).select(spectrum.alias("s")).select(F.posexplode(F.transform("s", lambda x: x / V.total(F.col("s")))).alias("i", "ratio")).select((F.col("i") + 1).alias("rank"), "ratio")
    return S.select_rank(ratios, 0.7).select("rank", V.tidy(F.col("explained")).alias("explained"), "reached")


@query(
    "WITH e AS (SELECT unnest(range(1, 4097)) AS experts), u AS (SELECT experts, 3 * 2 * 1 * 64 * experts AS u FROM e), c AS (SELECT experts, u, unnest([(3 * 592896 - 9216) // u, (3 * 592896 - 9216 + u - 1) // u]) AS hidden_width FROM u) SELECT experts, hidden_width, u * hidden_width AS expert_parameters, u * hidden_width + 9216 AS total_compute, abs(3 * 592896 - 9216 - u * hidden_width) AS gap, (3 * 592896 - 9216 = u * hidden_width) AS exact FROM c WHERE hidden_width BETWEEN 32 AND 8192 ORDER BY gap, experts, hidden_width LIMIT 1"
)
def capacity_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.expert_geometry(spark, 592_896, 9_216, 64, 1)


@query(
    "WITH p AS (SELECT CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN p_size END) AS BIGINT) AS memory, CAST(sum(CASE WHEN p_partkey % 3 = 1 THEN p_size END) AS BIGINT) AS compute, CAST(sum(CASE WHEN p_partkey % 3 = 2 THEN p_size END) AS BIGINT) AS shared FROM part) SELECT memory, compute, shared, memory + compute AS sparse_total, memory / (memory + compute) AS memory_fraction, compute / (memory + compute) AS compute_fraction, memory * 3 AS required_compute, memory * 3 - compute AS compute_gap, memory * 3 = compute AS exact_split FROM p"
)
def capacity_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "memory").when(F.col("p_partkey") % 3 == 1, "compute").otherwise("shared")
    return K.ledger(table(spark, sf_dir, "part").select(kind.alias("kind"), F.col("p_size").alias("n")))


@query(f"WITH {_T}, p AS (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS t) SELECT t, {_r('sum(x)')} AS total, {_r('sum(x * x)')} AS energy FROM (SELECT t, CASE WHEN i % 2 = 0 THEN sin(t * exp(i * {-math.log(10_000.0) / 64!r})) ELSE cos(t * exp((i - 1) * {-math.log(10_000.0) / 64!r})) END AS x FROM (SELECT t, unnest(range(0, 64)) AS i FROM p)) GROUP BY t")
def position_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(64).select(F.col("id").cast("int").alias("t")).withColumn("g", G.sinusoid(F.col("t"), 64))
    return df.select("t", V.tidy(V.total(F.col("g"))).alias("total"), V.tidy(V.sum_squares(F.col("g"))).alias("energy"))


@query(f"WITH {_T}, w AS (SELECT label, t, v, lag(v, 1) OVER q AS a, lag(v, 2) OVER q AS b FROM s WINDOW q AS (PARTITION BY label ORDER BY t)) SELECT label, t, {_r('list_sum(list_transform(range(1, 65), lambda i: v[i] * 0.5 + coalesce(a[i], 0) * 0.3 + coalesce(b[i], 0) * 0.2))')} AS total FROM w")
def causal_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.causal_convolution(_states(spark, sf_dir), "label", "t", "v", [0.2, 0.3, 0.5])
    return df.select("label", "t", V.tidy(V.total(F.col("conv"))).alias("total"))
