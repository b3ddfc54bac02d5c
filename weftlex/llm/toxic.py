"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are toxic or not.  A token speaks for toxicity by its word, its first
and last bytes, its neighbours and its shape (hashed weights), a pair of
neighbours by the transition weights.  Labels are of documents, so tokens get
theirs in two steps: in toxic documents those that stand out against clean ones
by counted log-odds, at least one each; then those that a first field finds.
Forward-backward gives every token its marginal; marginals over a half join to
spans, and a calibrated model over a document's marginals gives its score.

Forward and backward passes run over blocks of many texts at once, as prefix
products of 2 by 2 matrices in chunks, so neither short nor long texts cost a
step of Python for each token.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import arrow_rows, lean
from .quality import Logistic

#: Labelled documents used for fitting, half of them toxic at most, and the bytes from which a text is not among them.
LABELLED, FIT_BYTES = 4000, 1 << 16
#: Hashed weights.
SLOTS = 1 << 18
#: Bytes of a token's beginning and end that are features.
PREFIXES, SUFFIXES = (3, 4, 5, 6, 8), (3, 5)
#: Features: the word, beginnings, ends, shape, the word before and the word after.
WIDTH = 1 + len(PREFIXES) + len(SUFFIXES) + 3
PASSES, STEP, DECAY = 5, 0.3, 1e-4
CHUNK = 64


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    """A weight's number, 1 and up; 0 is the feature that is absent."""
    return (wordhash.mix(h + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(SLOTS - 1)).astype(np.uint32) + np.uint32(1)


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes with the accented Latin capitals (U+00C0 to U+00DE) made small; hashing does it for ASCII."""
    high = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = high[(data[high] < 0x9F) & (data[high] != 0x97)]
    if not len(capital):
        return data
    out = data.copy()
    out[capital] += 0x20
    return out


def tokens(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, features) of the tokens of one piece; the columns of neighbours are left 0."""
    gap = wordhash.punctuation(data)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = gap[:-1]
    edge[doc_starts] = True
    starts = np.flatnonzero(edge[:-1] & ~gap)
    edge[:-1] = gap
    edge[doc_starts] = True
    edge[-1] = True
    stops = np.flatnonzero(edge)
    ends = stops[np.searchsorted(stops, starts + 1)]
    out, size = np.zeros((len(starts), WIDTH), np.uint32), ends - starts
    part = wordhash.substrings(_folded(data))
    out[:, 0] = _slot(part(starts, ends), 1)
    for k, n in enumerate((*PREFIXES, *SUFFIXES)):
        long = size > n
        a = starts[long] if k < len(PREFIXES) else ends[long] - n
        out[long, k + 1] = _slot(part(a, a + n), k + 2)
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    shape = np.minimum(size, 15) * 4 + ((head >= 65) & (head < 91)) * 2 + (digits[ends] > digits[starts])
    out[:, WIDTH - 3] = _slot(shape.astype(np.uint64), 90)
    return starts, ends, out


def _neighbours(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the word before and after each token; ``firsts`` are the first tokens of texts."""
    before, after = np.zeros_like(words), np.zeros_like(words)
    if len(words) > 1:
        before[1:] = _slot(words[:-1].astype(np.uint64), 91)
        after[:-1] = _slot(words[1:].astype(np.uint64), 92)
    before[firsts] = 0
    after[firsts[firsts > 0] - 1] = 0
    return before, after


def _norm(p: list[np.ndarray]) -> list[np.ndarray]:
    most = np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
    return [x / most for x in p]


def _times(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return _norm([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])


def prefix_products(m: np.ndarray) -> np.ndarray:
    """Products m[0] m[1] ... m[t] for every t, each up to a factor; ``m`` is (4, n), 2 by 2 matrices by rows."""
    n = m.shape[1]
    if n <= 1:
        return m
    rows = -(-n // CHUNK)
    x = np.zeros((4, rows * CHUNK))
    x[:, :n] = m
    x[0, n:] = x[3, n:] = 1
    x = np.ascontiguousarray(x.reshape(4, rows, CHUNK).transpose(0, 2, 1))
    for k in range(1, CHUNK):
        x[:, k] = _times(list(x[:, k - 1]), list(x[:, k]))
    if rows > 1:
        before = prefix_products(np.ascontiguousarray(x[:, -1, :-1]))
        for k in range(CHUNK):
            x[:, k, 1:] = _times(list(before), list(x[:, k, 1:]))
    return x.transpose(0, 2, 1).reshape(4, -1)[:, :n]


class Field(NamedTuple):
    """Weights of features, log transition weights by rows (from clean, from toxic), and of a first token being toxic."""

    weights: np.ndarray
    moves: np.ndarray
    first: float


def forward_backward(unary: np.ndarray, firsts: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of toxic, summed posterior transitions) of texts laid end to end; ``firsts`` are their first tokens."""
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros(4)
    e, a = np.exp(np.clip(unary, -30, 30)), np.exp(field.moves)
    first = np.zeros(n, bool)
    first[firsts] = True
    one = np.ones(n)
    step = np.stack([one * a[0], a[1] * e, one * a[2], a[3] * e])
    at_first = np.exp(field.first) * e
    forth = np.where(first, np.stack([one, at_first, one, at_first]), step)  # what comes before a first token does not count
    alpha = prefix_products(forth)[:2]
    # backward: row vectors again, over transposed matrices from the end; a text's last token forgets what follows it
    back, last = np.empty((4, n)), np.append(first[1:], True)
    back[:, :-1] = step[:, 1:][[0, 2, 1, 3]]
    back[:, last] = 1
    beta = prefix_products(np.ascontiguousarray(back[:, ::-1]))[:2, ::-1]
    odds = alpha * beta
    p = odds[1] / odds.sum(0)
    inner = np.flatnonzero(~first)
    pair = np.stack([alpha[i, inner - 1] * step[2 * i + j, inner] * beta[j, inner] for i in (0, 1) for j in (0, 1)])
    return p, (pair / pair.sum(0)).sum(1) if len(inner) else np.zeros(4)


def _first_tokens(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)


def _fit_field(features: list[np.ndarray], truth: list[np.ndarray]) -> Field:
    """Adagrad on the conditional log-likelihood, some texts at a time."""
    w, moves, first = np.zeros(SLOTS), np.zeros(4), np.zeros(1)
    seen = [np.full(SLOTS, 1e-3), np.full(4, 1e-3), np.full(1, 1e-3)]
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        deal = order.permutation(len(features))
        for at in range(0, len(deal), 64):
            own = [i for i in deal[at : at + 64] if len(features[i])]
            if not own:
                continue
            x, y = np.concatenate([features[i] for i in own]), np.concatenate([truth[i] for i in own]).astype(float)
            firsts = np.cumsum([0, *(len(features[i]) for i in own[:-1])])
            p, pairs = forward_backward(w[x].sum(1), firsts, Field(w, moves, float(first[0])))
            inner = np.ones(len(y), bool)
            inner[firsts] = False
            k = np.flatnonzero(inner)
            held = np.bincount((2 * y[k - 1] + y[k]).astype(int), minlength=4)
            steps = (np.bincount(x.ravel(), np.repeat(y - p, x.shape[1]), SLOTS), held - pairs, np.array([(y - p)[firsts].sum()]))
            for v, g, s in zip((w, moves, first), steps, seen, strict=True):
                s += g * g
                v += STEP * g / np.sqrt(s)
                v *= 1 - DECAY
            w[0] = 0
    return Field(w, moves, float(first[0]))


def _stand_out(features: list[np.ndarray], toxic: np.ndarray) -> list[np.ndarray]:
    """First token labels: in toxic texts, the tokens whose word or beginning is surely commoner there; at least one each."""
    columns, n = range(1 + len(PREFIXES)), np.array([max(1, (toxic == k).sum()) for k in (0, 1)])
    doc = np.repeat(np.arange(len(features)), [len(f) for f in features])
    flat = np.concatenate(features) if len(doc) else np.zeros((0, WIDTH), np.uint32)
    score = np.full(len(flat), -9.0)
    for c in columns:
        pairs = np.unique(flat[:, c].astype(np.int64) * len(features) + doc)
        slot, of = pairs // len(features), toxic[pairs % len(features)]
        bad, good = (np.bincount(slot[of == k], minlength=SLOTS) for k in (1, 0))
        # log-odds of the two document rates, less two standard errors
        sure = np.log((bad + 0.5) / n[1]) - np.log((good + 0.5) / n[0]) - 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        sure[0] = -9
        score = np.maximum(score, sure[flat[:, c]])
    bounds = np.cumsum([0, *(len(f) for f in features)])
    return [_marked(score[a:b], 0.0) & bool(t) for a, b, t in zip(bounds[:-1], bounds[1:], toxic, strict=True)]


def _marked(score: np.ndarray, least: float) -> np.ndarray:
    """Scores of ``least`` or more, or else the highest one."""
    return score >= min(least, score.max()) if len(score) else np.zeros(0, bool)


class Model(NamedTuple):
    field: Field
    total: Logistic


def evidence(p: np.ndarray) -> list[float]:
    """What a document's score is made of, from its tokens' marginals."""
    top = float(p.max()) if len(p) else 0.0
    return [top, float(np.log1p(p.sum())), float(np.clip(np.log((top + 1e-6) / (1 - top + 1e-6)), -10, 10))]


def fit(features: list[np.ndarray], toxic: np.ndarray, shares: tuple[float, float] = (0.5, 0.5)) -> Model:
    """A field and its calibrated document model from token features of labelled texts.

    The document model learns from marginals that a field gives texts it did not
    see: one field for each half of the texts, then one from all.  ``shares`` are
    those of clean and toxic texts among all labelled ones, for which it is weighted.
    """
    half = np.zeros(len(toxic), int)
    for k in (0, 1):
        own = np.flatnonzero(toxic == k)
        half[own] = np.arange(len(own)) % 2
    x = np.zeros((len(toxic), 3))
    for k in (0, 1):
        field = _learn([f for f, h in zip(features, half, strict=True) if h != k], toxic[half != k])
        own = np.flatnonzero(half == k)
        for i, p in zip(own, _marginals([features[i] for i in own], field), strict=True):
            x[i] = evidence(p)
    t = toxic.astype(float)
    weight = np.where(t == 1, shares[1] / max(t.mean(), 1e-9), shares[0] / max(1 - t.mean(), 1e-9))
    field = _learn(features, toxic)
    return Model(Field(field.weights.astype(np.float32), field.moves, field.first), Logistic(0.1).fit(x, t, weight))


def _marginals(features: list[np.ndarray], field: Field) -> Iterator[np.ndarray]:
    """Marginals of each text's tokens, some texts at a time."""
    for at in range(0, len(features), 64):
        own = features[at : at + 64]
        ends = np.cumsum([len(f) for f in own])
        firsts = (ends - [len(f) for f in own])[[len(f) > 0 for f in own]]
        p, _ = forward_backward(field.weights[np.concatenate(own)].sum(1), firsts, field)
        yield from np.split(p, ends[:-1])


def _learn(features: list[np.ndarray], toxic: np.ndarray) -> Field:
    """A field whose token labels are first those that stand out, then those that a first field finds."""
    field = _fit_field(features, _stand_out(features, toxic))
    found = [_marked(p, 0.5) & bool(t) for p, t in zip(_marginals(features, field), toxic, strict=True)]
    return _fit_field(features, found)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: (first row, row of each token, starts, ends, features); a long text is turned into features by pieces."""
    data, offsets = wordhash.buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + wordhash.BLOCK_BYTES, "right")) - 1)
        parts, lo, hi = [], int(offsets[row]), int(offsets[stop])
        while lo < hi:
            end = min(lo + wordhash.BLOCK_BYTES, hi)
            while end < hi and not len(found := np.flatnonzero(wordhash.NON_ALNUM[data[lo:end]])):
                end = min(end + wordhash.BLOCK_BYTES, hi)
            if end < hi:
                end = lo + int(found[-1]) + 1
            inside = offsets[row:stop] - lo
            starts, ends, features = tokens(data[lo:end], inside[(inside >= 0) & (inside < end - lo)])
            parts.append((starts + lo, ends + lo, features))
            lo = end
        if parts:
            starts, ends, features = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            starts, ends, features = np.zeros(0, int), np.zeros(0, int), np.zeros((0, WIDTH), np.uint32)
        rows = np.searchsorted(offsets[row : stop + 1], starts, "right") - 1
        features[:, WIDTH - 2], features[:, WIDTH - 1] = _neighbours(features[:, 0], _first_tokens(rows))
        yield row, rows, starts, ends, features
        row = stop


def _spans(data: np.ndarray, lo: int, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> list[dict]:
    """Runs of tokens over a half, as code point offsets in the text that begins at ``lo``."""
    over = np.diff(np.concatenate([[0], (p >= 0.5).astype(np.int8), [0]]))
    out, at, chars = [], lo, 0
    for a, b in zip(np.flatnonzero(over == 1).tolist(), np.flatnonzero(over == -1).tolist(), strict=True):
        both = []
        for to in (int(starts[a]), int(ends[b - 1])):
            chars += int(np.count_nonzero(data[at:to] & 0xC0 != 0x80))
            at = to
            both.append(chars)
        out.append({"start": both[0], "end": both[1], "p": float(p[a:b].max())})
    return out


def _label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y): of several labels of one id the mean counts, ties as toxic; null ids and labels are left out."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def held_out(id_col: str) -> Column:
    """Whether a row's labels are kept from training: its id's CRC-32 is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", labelled: int = LABELLED) -> Model | None:
    """A model from at most ``labelled`` labelled documents, half of them toxic at most, none held out.

    They are the first of each class by a hash of their ids.  None where
    fewer than two texts of a class are left.  Of rows repeated under one id the least text counts; null texts count as empty.
    """
    marks = _label(labels, id_col, label_col).where(~held_out("id"))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    bad = min(counts[1], labelled // 2)
    some = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(13)), "id").limit(n) for y, n in ((1, bad), (0, labelled - bad))]
    known = some[0].unionByName(some[1]).toPandas()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(known.astype({"id": "int64", "y": "int32"}), "id long, y int"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    once = rows.join(wanted, "id").groupBy("id", "y").agg(F.min("text").alias("text")).where(F.octet_length("text") < FIT_BYTES)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            for first, rows, _, _, features in _texts(batch.column(2)):
                at = np.searchsorted(rows, np.arange(rows[-1] + 2)) if len(rows) else []
                for i in range(len(at) - 1):
                    out[first + i] = features[at[i] : at[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "y", "f"])

    got = arrow_rows(once).mapInArrow(run, "id long, y int, f binary").toArrow().sort_by("id")
    toxic = got["y"].to_numpy()
    if min((toxic == 0).sum(), (toxic == 1).sum()) < 2:
        return None
    features = [np.frombuffer(f.as_buffer(), np.uint32).reshape(-1, WIDTH) for f in got["f"]]
    total = counts[0] + counts[1]
    return fit(features, toxic, (counts[0] / total, counts[1] / total))


def tag(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score, spans) for each row of ``docs``: spans are an array of (start, end, p) in code points, end exclusive.

    Whole texts are read; a null text counts as empty and scores as an empty one.
    Repeated rows score alike; other columns are not read.  Without a model
    (too few labels of a class) scores are null and there are no spans.  An empty table gives no rows.
    """
    schema = f"{id_col} long, score double, spans array<struct<start: long, end: long, p: double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score, spans = np.zeros(n), [[] for _ in range(n)]
            if model is not None:
                data, offsets = wordhash.buffers(batch.column(1))
                held = np.tile(evidence(np.zeros(0)), (n, 1))
                for first, rows, starts, ends, features in _texts(batch.column(1)):
                    unary = sum(model.field.weights[features[:, k]] for k in range(WIDTH)).astype(float)
                    p, _ = forward_backward(unary, _first_tokens(rows), model.field)
                    at = np.append(_first_tokens(rows), len(rows))
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        i = first + int(rows[a])
                        held[i] = evidence(p[a:b])
                        if held[i, 0] >= 0.5:
                            spans[i] = _spans(data, int(offsets[i]), starts[a:b], ends[a:b], p[a:b])
                score = 1 / (1 + np.exp(-np.clip(model.total.raw(held), -30, 30)))
            scores = pa.array(score) if model is not None else pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, pa.array(spans, kind)], names=[id_col, "score", "spans"])

    rows = arrow_rows(docs).select(F.col(id_col).cast("long").alias(id_col), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """(id_col, held_out, score, predicted, n_spans, spans): train() and tag(); spans as "start:end", comma-joined."""
    found = tag(docs, train(docs, labels, id_col, label_col, labelled), id_col)
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), listed.alias("spans"))
