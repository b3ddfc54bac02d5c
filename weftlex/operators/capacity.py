"""Capacity arithmetic: the ledger of parameters and the expert geometry that fills a fixed split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compute parameters for each memory parameter in the fixed quarter to three quarters split.
COMPUTE_PER_MEMORY = 3


def ledger(parameters: DataFrame) -> DataFrame:
    """One row of totals, shares and the gap to the split, from ``parameters(kind, n)``.

    Kinds are 'memory', 'compute' and 'shared'; empty sparse capacity raises.
    """
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("long").alias(kind)
    df = parameters.agg(of("memory"), of("compute"), of("shared")).withColumn("sparse_total", F.col("memory") + F.col("compute"))
    total = F.when(F.col("sparse_total") > 0, F.col("sparse_total")).otherwise(F.raise_error(F.lit("sparse capacity cannot be empty")).cast("long"))
    need = F.col("memory") * COMPUTE_PER_MEMORY
    return df.select("memory", "compute", "shared", total.alias("sparse_total"), (F.col("memory") / total).alias("memory_fraction"), (F.col("compute") / total).alias("compute_fraction"), need.alias("required_compute"), (need - F.col("compute")).alias("compute_gap"), (need == F.col("compute")).alias("exact_split"))


def expert_geometry(spark: SparkSession, memory: int, fixed_compute: int, width: int, branches: int, blocks: int = 2, experts: tuple[int, int] = (1, 4096), hidden: tuple[int, int] = (32, 8192)) -> DataFrame:
    """One row (experts, hidden_width, expert_parameters, total_compute, gap, exact): the closest admissible geometry.

    Each expert branch has three matrices in each block.  Ties go to fewer
    experts, then to the narrower width.  Nothing left to fill gives zero
    experts; no admissible geometry raises.
    """
    if min(memory, fixed_compute, hidden[0]) < 0 or min(width, branches, blocks, experts[0]) < 1 or experts[1] < experts[0] or hidden[1] < hidden[0]:
        raise ValueError("capacity bounds must be positive and in order")
    left = COMPUTE_PER_MEMORY * memory - fixed_compute
    if left <= 0:
        return spark.sql(f"SELECT 0L AS experts, 0L AS hidden_width, 0L AS expert_parameters, {fixed_compute}L AS total_compute, {-left}L AS gap, {left == 0} AS exact").select("*")
    unit = 3 * blocks * branches * width
    df = spark.range(experts[0], experts[1] + 1).select(F.col("id").alias("experts"), (F.col("id") * unit).alias("u"))
    df = df.select("experts", "u", F.explode(F.array_distinct(F.array(F.expr(f"{left}L DIV u"), F.expr(f"({left}L + u - 1) DIV u")))).alias("hidden_width"))
    df = df.where(F.col("hidden_width").between(*hidden)).withColumn("expert_parameters", F.col("u") * F.col("hidden_width"))
    df = df.withColumn("gap", F.abs(F.lit(left) - F.col("expert_parameters")))
    best = df.agg(F.min(F.struct("gap", "experts", "hidden_width", "expert_parameters")).alias("b"))
    best = best.select(F.coalesce("b", F.raise_error(F.lit("no geometry inside the bounds")).cast("struct<gap:bigint,experts:bigint,hidden_width:bigint,expert_parameters:bigint>")).alias("b"))
    return best.select("b.experts", "b.hidden_width", "b.expert_parameters", (F.col("b.expert_parameters") + fixed_compute).alias("total_compute"), "b.gap", (F.col("b.gap") == 0).alias("exact"))


def latency(samples: DataFrame, value: str) -> DataFrame:
    """One row (median, p95) by position in the sorted samples; no interpolation at p95, mean of the middle two at the median."""
    from .dictionary import numbered

    ranked = numbered(samples.select(F.col(value).alias("x"), F.monotonically_increasing_id().alias("id")), ["x", "id"], "at")
    n = samples.agg(F.count(value).alias("n"))
    at = ranked.join(F.broadcast(n), F.lit(True))
    pick = lambda p: F.max(F.when(F.col("at") == F.floor(p), F.col("x")))
    return at.agg(((pick((F.col("n") - 1) / 2) + pick(F.col("n") / 2)) / 2).alias("median"), pick(F.lit(0.95) * (F.col("n") - 1)).alias("p95"))
