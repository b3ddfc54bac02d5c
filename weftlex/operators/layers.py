"""Memory and expert layers over sequences of states, with parameters as tables.

A sequence is one group of bounded length; its states are one matrix, so each
layer is a few matrix products in an Arrow batch.  Parameters are broadcast and
their size is checked first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Numbers in the parameters that a layer ships to every task.
MAX_PARAMETERS = 64 << 20
EPSILON = 1e-6


def parameters(table: DataFrame) -> dict[str, np.ndarray]:
    """Arrays by name from ``table(name, row, values)``, rows in order; more than MAX_PARAMETERS numbers raise."""
    from pyspark.sql import functions as F

    size = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} parameters are too many to ship to every task")
    out: dict[str, list] = {}
    for r in table.orderBy("name", "row").collect():
        out.setdefault(r["name"], []).append(r["values"])
    return {k: np.array(v, float) for k, v in out.items()}


def need(p: dict[str, np.ndarray], **shapes: tuple) -> None:
    """Raise for parameters that are missing or misshapen; None stands for any length."""
    for name, shape in shapes.items():
        if name not in p:
            raise KeyError(f"parameter {name} is missing")
        if len(p[name].shape) != len(shape) or any(want is not None and want != got for want, got in zip(shape, p[name].shape, strict=True)):
            raise ValueError(f"parameter {name} has shape {p[name].shape}, {shape} is expected")


def rms(x: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    return x / np.sqrt((x**2).mean(-1, keepdims=True) + epsilon)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def signed_weights(scores: np.ndarray, k: int, valid: np.ndarray | None = None, epsilon: float = EPSILON) -> np.ndarray:
    """Dense weights: the k scores largest in magnitude over the sum of their magnitudes, zero elsewhere."""
    size = np.abs(scores) if valid is None else np.where(valid, np.abs(scores), -np.inf)
    top = np.argsort(-size, axis=-1, kind="stable")[..., : min(k, scores.shape[-1])]
    kept = np.zeros_like(scores)
    np.put_along_axis(kept, top, np.take_along_axis(scores if valid is None else scores * valid, top, -1), -1)
    return kept / (np.abs(kept).sum(-1, keepdims=True) + epsilon)


def latent_memory(h: np.ndarray, p: dict[str, np.ndarray], bits: int, orders: tuple[int, ...] = (2, 3), mode: str = "distance", forced: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """States with what their latent n-grams recall added.

    ``address`` maps normalised states to bits; ``table{n}`` holds a row for each
    address; ``key``, ``value`` (with biases) read the routes' rows; ``conv`` is a
    depthwise causal kernel, its last column on the current state.
    """
    t, width = h.shape
    routes, alphabet = width // bits, 1 << bits
    on = (rms(h) @ p["address"].T).reshape(t, routes, bits) > 0
    symbols = (on * (1 << np.arange(bits))).sum(-1)
    values, scores = [], []
    for n in orders:
        table = p[f"table{n}"]
        at = np.broadcast_to(np.arange(routes) * alphabet**n, (t, routes)).copy()
        for j in range(n):
            back = n - 1 - j
            at[back:] += symbols[: t - back] * alphabet**j
        valid = np.arange(t) >= n - 1
        recalled = np.where(valid[:, None, None], table[np.where(valid[:, None], at, 0)], 0.0)
        if forced and n in forced:
            f = forced[n]
            if (f >= len(table)).any():
                raise ValueError("forced address exceeds the table")
            recalled = np.where((f >= 0)[..., None], table[np.maximum(f, 0)], recalled)
        flat = recalled.reshape(t, -1)
        key = rms(flat @ p["key"].T + p["key_bias"][0])
        values.append(flat @ p["value"].T + p["value_bias"][0])
        scores.append(valid / (((rms(h) - key) ** 2).mean(-1) + EPSILON))
    score = np.stack(scores, -1)
    if mode == "sigmoid":
        weights = sigmoid(score) * np.stack([np.arange(t) >= n - 1 for n in orders], -1)
    else:
        weights = score / (score.sum(-1, keepdims=True) + EPSILON)
    fused = sum(weights[:, [i]] * v for i, v in enumerate(values))
    normed, kernel = rms(fused), p["conv"]
    mixed = np.zeros_like(fused) + p["conv_bias"][0]
    for k in range(kernel.shape[1]):
        back = kernel.shape[1] - 1 - k
        mixed[back:] += normed[: t - back] * kernel[:, k]
    return h + np.tanh(p["gate"][0, 0]) * (fused + mixed * sigmoid(mixed))


def hash_memory(addresses: dict[int, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    """Gated sum over orders of the projected mean of the heads' rows; -1 is no address."""
    out: np.ndarray | float = 0.0
    for n, at in sorted(addresses.items()):
        valid = at >= 0
        rows = p[f"hash{n}"][np.clip(at, 0, len(p[f"hash{n}"]) - 1)] * valid[..., None]
        mean = rows.sum(-2) / np.maximum(valid.sum(-1, keepdims=True), 1)
        out = out + np.tanh(p[f"hash_gate{n}"][0, 0]) * (mean @ p[f"hash_projection{n}"].T)
    return np.asarray(out)


def directions(h: np.ndarray, p: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Update along the k best directions: unit ``alpha`` rows are scored, raw ones respond, ``beta`` rows carry."""
    if not len(p.get("alpha", ())):
        return np.zeros_like(h)
    weights = signed_weights(unit(h) @ unit(p["alpha"]).T, k)
    return (weights * (h @ p["alpha"].T)) @ p["beta"]


def skills(h: np.ndarray, p: dict[str, np.ndarray], k: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(update, dense weights) of low-rank skills; skill s has rows s * rank.. of ``skill_a`` and of ``skill_b``."""
    weights = signed_weights(unit(h) @ unit(p["skill_anchor"]).T, k)
    out = np.zeros_like(h)
    for s in np.flatnonzero((weights != 0).any(0)):
        a, b = p["skill_a"][s * rank : (s + 1) * rank], p["skill_b"][s * rank : (s + 1) * rank]
        out += weights[:, [s]] * ((h @ a.T) @ b)
    return out, weights


def expert(h: np.ndarray, p: dict[str, np.ndarray], name: str, branches: int) -> np.ndarray:
    """Branches of tanh content times sigmoid gate, mixed by signed evidence."""
    outs, scores = [], []
    for b in range(branches):
        q = f"{name}.{b}"
        x = np.tanh(h @ p[f"{q}.content"].T + p[f"{q}.content_bias"][0]) * sigmoid(h @ p[f"{q}.gate"].T + p[f"{q}.gate_bias"][0])
        outs.append(x @ p[f"{q}.output"].T)
        scores.append((unit(outs[-1]) * unit(p[f"{q}.evidence"][0])).sum(-1))
    score = np.stack(scores, -1)
    weights = score / (np.abs(score).sum(-1, keepdims=True) + EPSILON)
    return sum(weights[:, [b]] * o for b, o in enumerate(outs))


def experts(h: np.ndarray, active: np.ndarray, p: dict[str, np.ndarray], k: int, branches: int) -> np.ndarray:
    """Update of the k best experts adjacent to any active skill; ``adjacency`` is skills by experts."""
    allowed = (active.astype(float) @ p["adjacency"]) > 0
    weights = signed_weights(unit(h) @ unit(p["expert_anchor"]).T, k, allowed)
    out = np.zeros_like(h)
    for e in np.flatnonzero((weights != 0).any(0)):
        at = weights[:, e] != 0
        out[at] += weights[at][:, [e]] * expert(h[at], p, f"expert{e}", branches)
    return out


def gated_sum(h: np.ndarray, p: dict[str, np.ndarray], k: int, rank: int, k_experts: int, branches: int) -> np.ndarray:
    """Directions, skills and experts, each under its gate in ``level_gates``."""
    g = np.tanh(p["level_gates"][0])
    skill, weights = skills(h, p, k, rank)
    return g[0] * directions(h, p, k) + g[1] * skill + g[2] * experts(h, weights != 0, p, k_experts, branches)


def fused_memory(h: np.ndarray, parts: dict[str, np.ndarray | None], p: dict[str, np.ndarray], block: int) -> np.ndarray:
    """Sum of the memory parts under their gates; 'late' phrase memory enters in block one only."""
    out = np.zeros_like(h)
    for name, part in parts.items():
        if part is not None and not (name == "late" and block != 1):
            out += np.tanh(p[f"gate_{name}"][0, 0]) * part
    return out


def over_sequences(states: DataFrame, seq: str, t: str, v: str, layer: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(seq, t, v) with each sequence's states replaced by ``layer`` of their matrix, in order of t."""
    seq_type, t_type = (states.schema[c].dataType.simpleString() for c in (seq, t))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        out = layer(np.stack([np.asarray(x, float) for x in pdf[v]]))
        return pd.DataFrame({seq: pdf[seq].to_numpy(), t: pdf[t].to_numpy(), v: list(out)})

    return states.select(seq, t, v).groupBy(seq).applyInPandas(run, f"{seq} {seq_type}, {t} {t_type}, {v} array<double>")


def over_rows(rows: DataFrame, key: str, inputs: list[str], layer: Callable[..., np.ndarray], out: str = "v") -> DataFrame:
    """(key, out): ``layer`` of the matrices of the input columns, batch by batch; rows are independent of each other.

    An array column is a matrix of a row for each state, any other a vector.  An
    empty table gives no rows.
    """
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = layer(*(np.stack([np.asarray(x, float) for x in pdf[c]]) for c in inputs))
                yield pd.DataFrame({key: pdf[key].to_numpy(), out: list(found)})

    return rows.select(key, *inputs).mapInPandas(run, f"{key} {key_type}, {out} array<double>")


def recurrent(states: DataFrame, seq: str, t: str, v: str, blocks: list[Callable[[np.ndarray], np.ndarray]], rounds: int, exponent: float = 0.25, tolerance: float | None = None) -> DataFrame:
    """Visit the blocks in turn, ``rounds`` times: x becomes rms(gain * x + block(x)).

    Sequences are independent, so all rounds of one run in its own task; a
    sequence stops early once its relative change is under ``tolerance``.
    """
    from .geometry import deep_loop_gains

    gain, _ = deep_loop_gains(rounds, exponent)

    def layer(h: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            before = h
            for block in blocks:
                h = rms(gain * h + block(h))
            if tolerance is not None and np.sqrt(((h - before) ** 2).mean()) / (np.sqrt((before**2).mean()) + EPSILON) < tolerance:
                break
        return h

    return over_sequences(states, seq, t, v, layer)
