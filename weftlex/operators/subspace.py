"""Subspaces: mergeable moments, balanced PCA, rank choice, shared factor bases, unfoldings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

TARGET, RANKS = 0.90, (16, 32, 64, 128, 256, 512, 1024)


def moments(vectors: DataFrame, v: str, width: int, source: str | None = None, normalize: bool = True) -> DataFrame:
    """(source, n, mean, second): exact sufficient statistics of each source.

    Partitions sum outer products batch by batch in matrices of width**2, and
    one row of them for each partition and source is merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            lists = batch.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(x) != len(lists) * width:
                raise ValueError(f"vectors of width {width} are expected")
            x = x.reshape(len(lists), width)
            if normalize:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for name in set(names.tolist()):
                own = x[names == name]
                n, s, o = sums.get(name, (0, 0.0, 0.0))
                sums[name] = (n + len(own), s + own.sum(0), o + own.T @ own)
        rows = [(k, n, s.tolist(), o.ravel().tolist()) for k, (n, s, o) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["source", "n", "s", "o"])

    name = F.col(source).cast("string") if source else F.lit("all")
    parts = vectors.select(name.alias("source"), F.col(v).alias("v")).mapInArrow(run, "source string, n long, s array<double>, o array<double>")
    return merged_moments(parts)


def merged_moments(parts: DataFrame) -> DataFrame:
    """Sum (source, n, s, o) by coordinate and divide by the count."""
    by = parts.groupBy("source").agg(F.sum("n").alias("n"))
    add = lambda c, name: parts.select("source", F.posexplode(c).alias("i", "x")).groupBy("source", "i").agg(F.sum("x").alias("x")).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias(name))
    out = by.join(add("s", "s"), "source").join(add("o", "o"), "source")
    return out.select("source", "n", F.transform("s", lambda x: x / F.col("n")).alias("mean"), F.transform("o", lambda x: x / F.col("n")).alias("second"))


def balanced_pca(found: DataFrame, rank: int, weights: dict[str, float] | None = None) -> DataFrame:
    """One row (mean, components, eigenvalues, ratio) of the weighted sources, equal by default.

    The moments are one row for each source, of width**2 numbers: the driver
    solves one symmetric eigenproblem.
    """
    spark: SparkSession = found.sparkSession
    rows = sorted(found.collect(), key=lambda r: r["source"])
    w = np.array([1.0 if weights is None else weights[r["source"]] for r in rows])
    if not len(rows) or (w < 0).any() or w.sum() <= 0:
        raise ValueError("sources with nonnegative weights and positive mass are needed")
    w = w / w.sum()
    mean = sum(k * np.array(r["mean"]) for k, r in zip(w, rows, strict=True))
    width = len(mean)
    if not 1 <= rank <= width:
        raise ValueError(f"rank must be between 1 and {width}")
    second = sum(k * np.array(r["second"]).reshape(width, width) for k, r in zip(w, rows, strict=True))
    cov = second - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(width)])
    ratio = values / values.sum() if values.sum() > 0 else np.zeros(width)
    return spark.createDataFrame([(mean.tolist(), vectors[:, :rank].T.tolist(), values[:rank].tolist(), ratio[:rank].tolist())], "mean array<double>, components array<array<double>>, eigenvalues array<double>, ratio array<double>")


def project(vectors: DataFrame, basis: DataFrame, v: str, normalize: bool = True) -> DataFrame:
    """Adds ``coordinates``, ``restored`` and ``cosine`` of each vector with what the basis restores."""
    df = vectors.join(F.broadcast(basis.select("mean", "components")), F.lit(True))
    df = df.withColumn("_t", V.l2_normalize(F.col(v)) if normalize else F.transform(v, lambda x: x.cast("double")))
    df = df.withColumn("coordinates", V.mat_vec(F.col("components"), F.zip_with("_t", "mean", lambda a, b: a - b)))
    terms = F.zip_with("components", "coordinates", lambda c, k: F.transform(c, lambda x: x * k))
    df = df.withColumn("restored", F.aggregate(terms, F.col("mean"), lambda acc, x: V.add(acc, x)))
    norm = F.sqrt(V.sum_squares(F.col("_t"))) * F.sqrt(V.sum_squares(F.col("restored")))
    return df.withColumn("cosine", V.dot(F.col("_t"), F.col("restored")) / F.greatest(norm, F.lit(1e-12))).drop("mean", "components", "_t")


def select_rank(ratios: DataFrame, target: float = TARGET, candidates: tuple[int, ...] = RANKS, minimum: int = 16) -> DataFrame:
    """One row (rank, explained, reached): the least candidate whose cumulative ratio reaches the target, else the largest.

    ``ratios(rank, ratio)``, ranks from 1: as many rows as the vectors are wide.
    """
    df = ratios.withColumn("c", F.sum("ratio").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    usable = df.where(F.col("rank").isin(*candidates) & (F.col("rank") >= minimum))
    best = usable.agg(F.min(F.when(F.col("c") >= target, F.struct("rank", "c"))).alias("a"), F.max(F.struct("rank", "c")).alias("b"))
    return best.select(F.coalesce("a", "b").alias("x"), F.col("a").isNotNull().alias("reached")).select("x.rank", F.col("x.c").alias("explained"), "reached")


def shared_basis(adapters: DataFrame, rank: int) -> DataFrame:
    """One row for each operator: mean and basis of the stacked factors, and their energy ratios.

    ``adapters(operator, task_id, beta, alpha)``: beta out x r, alpha r x in, as
    arrays of rows.  One operator's adapters are a group of bounded size.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task_id")
        out = {"operator": [pdf["operator"].iloc[0]]}
        for name, turn in (("beta", False), ("alpha", True)):
            mats = [np.stack([np.asarray(r, float) for r in m]) for m in pdf[name]]
            stack = np.concatenate([m.T if turn else m for m in mats], axis=1)
            if not 1 <= rank <= min(stack.shape):
                raise ValueError("rank exceeds the stacked factors")
            mean = stack.mean(axis=1)
            u, s, _ = np.linalg.svd(stack - mean[:, None], full_matrices=False)
            energy = s**2 / (s**2).sum() if (s**2).sum() > 0 else np.zeros_like(s)
            out |= {f"{name}_mean": [mean.tolist()], f"{name}_basis": [u[:, :rank].T.tolist()], f"{name}_energy": [energy.tolist()]}
        return pd.DataFrame(out)

    schema = "operator string, " + ", ".join(f"{n}_mean array<double>, {n}_basis array<array<double>>, {n}_energy array<double>" for n in ("beta", "alpha"))
    return adapters.groupBy("operator").applyInPandas(fit, schema)


def adapter_coefficients(adapters: DataFrame, basis: DataFrame) -> DataFrame:
    """(operator, task_id, beta_coordinates, alpha_coordinates, error): each adapter in its operator's basis, and the relative error of its product."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            m = {k: np.stack([np.asarray(x, float) for x in getattr(r, k)]) for k in ("beta", "alpha", "beta_basis", "alpha_basis")}
            cb = m["beta_basis"] @ (m["beta"] - np.asarray(r.beta_mean)[:, None])
            ca = m["alpha_basis"] @ (m["alpha"].T - np.asarray(r.alpha_mean)[:, None])
            beta = np.asarray(r.beta_mean)[:, None] + m["beta_basis"].T @ cb
            alpha = (np.asarray(r.alpha_mean)[:, None] + m["alpha_basis"].T @ ca).T
            whole = m["beta"] @ m["alpha"]
            rows.append((r.operator, r.task_id, cb.tolist(), ca.tolist(), float(np.linalg.norm(whole - beta @ alpha) / max(np.linalg.norm(whole), 1e-12))))
        return pd.DataFrame(rows, columns=["operator", "task_id", "beta_coordinates", "alpha_coordinates", "error"])

    joined = adapters.join(basis, "operator")
    return joined.mapInPandas(lambda it: map(run, it), "operator string, task_id string, beta_coordinates array<array<double>>, alpha_coordinates array<array<double>>, error double")


def residual(updates: DataFrame, basis: DataFrame, v: str) -> DataFrame:
    """Adds ``coordinates`` (U^T v) and ``residual`` (v - U U^T v); ``basis(components)`` has orthonormal rows."""
    df = updates.join(F.broadcast(basis.select("components")), F.lit(True)).withColumn("coordinates", V.mat_vec(F.col("components"), F.col(v)))
    terms = F.zip_with("components", "coordinates", lambda c, k: F.transform(c, lambda x: -x * k))
    return df.withColumn("residual", F.aggregate(terms, F.transform(v, lambda x: x.cast("double")), lambda acc, x: V.add(acc, x))).drop("components")


def unfold_groups(deltas: DataFrame, ranks: list[int], thresholds: list[float], center: str = "task") -> DataFrame:
    """(layer, module, mode, status, requested_rank, rank, explained, ranks_for) of each group's three unfoldings.

    ``deltas(layer, module, adapter, rows)``.  Groups of fewer than two adapters
    or of mixed shapes are reported as skipped.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        layer, module = int(pdf["layer"].iloc[0]), pdf["module"].iloc[0]
        mats = [np.stack([np.asarray(r, float) for r in m]) for m in pdf.sort_values("adapter")["rows"]]
        cols = ["layer", "module", "mode", "status", "requested_rank", "rank", "explained", "ranks_for"]
        if len(mats) < 2 or len({m.shape for m in mats}) > 1:
            return pd.DataFrame([(layer, module, None, "skipped_few" if len(mats) < 2 else "skipped_mixed_shapes", None, None, None, None)], columns=cols).astype({"requested_rank": "Int64", "rank": "Int64"})
        x = np.stack(mats)
        x = x - (x.mean(0, keepdims=True) if center == "task" else x.mean() if center == "global" else 0.0)
        out = []
        for mode, axis in (("adapter_task", 0), ("output", 1), ("input_hidden", 2)):
            s = np.linalg.svd(np.moveaxis(x, axis, 0).reshape(x.shape[axis], -1), compute_uv=False)
            share = s**2 / (s**2).sum() if (s**2).sum() > 0 else np.zeros_like(s)
            c = np.cumsum(share)
            need = [int(np.argmax(c >= t)) + 1 if (c >= t).any() else len(c) for t in thresholds]
            out += [(layer, module, mode, "ok", r, max(1, min(r, len(c))), float(c[max(1, min(r, len(c))) - 1]), need) for r in ranks]
        return pd.DataFrame(out, columns=cols)

    return deltas.groupBy("layer", "module").applyInPandas(run, "layer int, module string, mode string, status string, requested_rank long, rank long, explained double, ranks_for array<long>")


def lora_deltas(factors: DataFrame, alpha_pattern: dict[str, float] | None = None, rank_pattern: dict[str, int] | None = None) -> DataFrame:
    """(adapter, layer, module, rows): alpha / r times B A for each pair of factor tensors.

    The first expression of a pattern that a key's base matches overrides alpha or r.

    ``factors(adapter, key, kind, rows, alpha, r)``; keys that differ only in the
    factor's name are a pair; a factor without its other half drops out.
    """
    base = F.regexp_replace(F.regexp_replace("key", r"(^|\.)base_model\.model\.", "$1"), r"\.lora_[AB](\.default)?(\.weight)?$", "")
    df = factors.withColumn("base", base)
    a = df.where("kind = 'A'").select("adapter", "base", F.col("rows").alias("a"), "alpha", "r")
    b = df.where("kind = 'B'").select("adapter", "base", F.col("rows").alias("b"))
    both = a.join(b, ["adapter", "base"])
    told = lambda pattern, own: F.coalesce(*(F.when(F.col("base").rlike(p), F.lit(x)) for p, x in (pattern or {}).items()), F.col(own))
    both = both.withColumns({"alpha": told(alpha_pattern, "alpha"), "r": told(rank_pattern, "r")})
    rank = F.coalesce("r", F.size("a")).cast("double")
    columns = F.transform(F.sequence(F.lit(0), F.size(F.get("a", F.lit(0))) - 1), lambda j: F.transform("a", lambda row: F.get(row, j)))
    scaled = F.transform("b", lambda row: F.transform("at", lambda col: V.dot(row, col) * F.coalesce("alpha", F.lit(1.0) * rank) / rank))
    out = both.withColumn("at", columns).withColumn("rows", scaled)
    return out.select("adapter", F.regexp_extract("base", r"layers?\.(\d+)\.", 1).cast("int").alias("layer"), F.regexp_extract("base", r"([^.]+)$", 1).alias("module"), "rows")
