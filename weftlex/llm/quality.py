"""Quality classifier by co-training of two views.

The text view sees what is written (hashed byte pairs and how often words
recur); the metadata view sees what is recorded about a row and its layout
(language, source, recorded and actual length, lines, case and symbol shares).
Logistic models of the two views start from labelled documents.  In every round
both score the whole corpus, and of the documents that one is sure of some are
added to the other's training rows: as many from each language and source, by
a hash of the row.  Both are calibrated on held-out labels, and a model over
the two calibrated log-odds scores every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import arrow_rows, lean

#: Labelled documents used for training: the first by a hash of the id.
LABELLED = 6000
#: Rounds of co-training, and the calibrated probability from which a view is sure of a class.
ROUNDS, SURE = 3, 0.9
#: Pseudo-labels that a view gives in a round, for each labelled training row.
GIVEN = 0.25
#: Hash buckets of languages and of sources.
LANGS, SOURCES = 16, 32
PAIRS = 512
#: Bytes of a text turned into features at a time.
PIECE = 1 << 18

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!@^~="]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
_MIX = np.uint32(2654435761)


def _hashed(s: str | None, size: int) -> int:
    h = 0
    for b in (s or "").encode():
        h = (h * 131 + b) % 1_000_003
    return h % size


def view_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text view, metadata view) of rows (id, text, lang, source, n_chars); one float32 row for each."""
    data, offsets = wordhash.buffers(batch.column(1))
    n = batch.num_rows
    text = np.zeros((n, PAIRS + 4), np.float32)
    meta = np.zeros((n, 8 + 16 + 32), np.float32)
    for first, _, hashes, bounds in wordhash.words(batch.column(1)):
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                _, counts = np.unique(hashes[a:b], return_counts=True)
                runs = np.count_nonzero(hashes[a + 1 : b] == hashes[a : b - 1]) / (b - a)
                text[first + i, PAIRS:] = (len(counts) / (b - a), counts.max() / (b - a), runs, np.log1p(b - a) / 10)
    for i in range(n):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        size = hi - lo
        pairs, sums = np.zeros(PAIRS), np.zeros(6)
        for at in range(lo, hi, PIECE):
            own = data[at : min(at + PIECE, hi)]
            more = data[at : min(at + PIECE + 1, hi)].astype(np.uint32)
            code = ((more[:-1] * np.uint32(256) + more[1:]) * _MIX) >> np.uint32(23)
            pairs += np.bincount(code, minlength=PAIRS)
            sums += (_UPPER[own].sum(), _SYMBOL[own].sum(), _DIGIT[own].sum(), (own == 10).sum(), (own == 32).sum(), _STOP[own].sum())
        text[i, :PAIRS] = np.sqrt(pairs / max(pairs.sum(), 1))
        meta[i, :6] = sums / max(size, 1)
        meta[i, 6] = np.log1p(size / (1 + sums[3])) / 10
    lang, source, chars = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
    for i in range(n):
        meta[i, 7] = np.log1p(max(chars[i] or 0, 0)) / 10
        meta[i, 8 + _hashed(lang[i], 16)] = 0.3
        meta[i, 24 + _hashed(source[i], 32)] = 0.3
    return text, meta


class Logistic:
    """L2-regularised logistic regression on standardised columns, by Newton steps; Platt-calibrated."""

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty
        self.scale = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))]).astype(float)
        w, reg = np.zeros(z.shape[1]), np.full(z.shape[1], self.penalty)
        reg[-1] = 1e-6
        k = np.ones(len(y)) if weight is None else weight
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (k * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(reg), z.T @ (k * (p - y)) + reg * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std) @ self.w[:-1] + self.w[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        z, a, b = np.clip(self.raw(x), -30, 30), 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = max(a - 0.02 * float(((p - y) * z).mean()), 1e-3), b - 0.2 * float((p - y).mean())
        self.scale = (a, b)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return np.clip(a * np.clip(self.raw(x), -30, 30) + b, -12, 12)


#: Text view, metadata view, and the model over their calibrated log-odds.
Models = tuple[Logistic, Logistic, Logistic]


#: From models of both views: features of both views, the view that is sure (0 or 1), and its label, one of each for a row.
Pick = Callable[[tuple[Logistic, Logistic], int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, pick: Pick, rounds: int = ROUNDS) -> Models:
    """Two calibrated view models and their combination; ``held`` marks labelled rows kept for these.

    ``pick(models, n)`` gives about ``n`` rows for each view, split by the class shares; see corpus_pick().
    """
    own = [(v[~held], y[~held], np.ones((~held).sum())) for v in views]

    def fitted() -> tuple[Logistic, Logistic]:
        return tuple(Logistic().fit(*o).calibrate(v[held], y[held]) for o, v in zip(own, views, strict=True))

    models = fitted()
    for _ in range(rounds):
        *found, teacher, label = pick(models, round(GIVEN * int((~held).sum())))
        if not len(label):
            break
        for k in (0, 1):
            mine, (x, t, w) = teacher == 1 - k, own[k]
            own[k] = (np.vstack([x, found[k][mine]]), np.concatenate([t, label[mine]]), np.concatenate([w, np.full(mine.sum(), 0.5)]))
        models = fitted()
    odds = np.stack([m.log_odds(v[held]) for m, v in zip(models, views, strict=True)], axis=1)
    return *models, Logistic().fit(odds, y[held])


def sure_of(models: tuple[Logistic, Logistic], views: tuple[np.ndarray, np.ndarray], sure: float = SURE) -> list[np.ndarray]:
    """For each view 1 where it is sure of a good document, 0 where of a bad one, else -1."""
    at = np.log(sure / (1 - sure))
    return [np.where(z >= at, 1, np.where(z <= -at, 0, -1)) for z in (m.log_odds(v) for m, v in zip(models, views, strict=True))]


def level(counts: np.ndarray, total: float) -> float:
    """The level at which min(counts, level) sum to ``total``: each stratum gives as many, or all that it has."""
    c = np.sort(np.asarray(counts, float))
    for i, x in enumerate(c):
        if x * (len(c) - i) >= total:
            return total / (len(c) - i)
        total -= x
    return float(c[-1]) if len(c) else 0.0


def combined(models: Models, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of a good document by the text view, the metadata view and both."""
    a, b = (m.log_odds(v) for m, v in zip(models[:2], views, strict=True))
    both = models[2].raw(np.stack([a, b], axis=1))
    return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, both))


_COLUMNS = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _inputs(docs: DataFrame, id_col: str) -> DataFrame:
    """The columns that the views read; an absent one counts as null."""
    return arrow_rows(docs).select(F.col(id_col).cast("long").alias("id"), *((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()))


_FEATURES = "t binary, m binary"


def _packed(views: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.tobytes() for x in v], pa.binary()) for v in views]


def _unpacked(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack([np.frombuffer(x, np.float32) for x in got[c]]) if len(got) else np.zeros((0, 1), np.float32) for c in ("t", "m"))


def _sample_features(rows: DataFrame) -> pd.DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_packed(view_features(batch))], names=["id", "t", "m"])

    return rows.mapInArrow(run, f"id long, {_FEATURES}").toPandas()


def corpus_pick(rows: DataFrame, shares: tuple[float, float], sure: float = SURE) -> Pick:
    """Pseudo-labels from all ``rows`` (id, text, lang, source, n_chars) for co_train().

    Both views score every row, and what each is sure of is counted by class and
    stratum (language and source).  The counts give every stratum a share of the
    hash range such that strata give equally many, or all that they have; a
    second pass makes features of the rows under it only.  What reaches the
    driver is at most 4 counts a stratum and about ``n`` rows a view.  A row is
    known by a hash of all its columns: equal rows count once, are given once,
    and are not given again in a later round.
    """
    stratum = F.pmod(F.xxhash64("lang"), F.lit(LANGS)) * SOURCES + F.pmod(F.xxhash64("source"), F.lit(SOURCES))
    whole = rows.select("id", *_COLUMNS, F.xxhash64("id", *_COLUMNS).alias("key"), stratum.cast("int").alias("stratum"))
    taken, turn = np.zeros(0, np.int64), 0

    def pick(models: tuple[Logistic, Logistic], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        nonlocal taken, turn
        past, turn = taken, turn + 1
        keyed = whole.withColumn("u", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 53)) / float(1 << 53))

        def sure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray], int, np.ndarray, np.ndarray]]:
            for some_rows in batches:
                for k in range(0, some_rows.num_rows, 1000):
                    batch = some_rows.slice(k, 1000)
                    views, new = view_features(batch), ~np.isin(batch.column("key").to_numpy(), past)
                    for teacher, label in enumerate(sure_of(models, views, sure)):
                        yield batch, views, teacher, (label >= 0) & new, batch.column("stratum").to_numpy() * 2 + label

        @lean
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, teacher, mine, code in sure_rows(batches):
                codes, found = np.unique(code[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), teacher), pa.int32()), pa.array(codes, pa.int32()), pa.array(found, pa.int64())], names=["teacher", "code", "n"])

        counts = keyed.mapInArrow(count, "teacher int, code int, n long").groupBy("teacher", "code").agg(F.sum("n").alias("n")).toPandas()
        cut = np.zeros((2, LANGS * SOURCES * 2))
        for (teacher, label), own in counts.groupby([counts["teacher"], counts["code"] % 2]):
            cut[teacher, own["code"]] = np.minimum(1, level(own["n"].to_numpy(), n * shares[label]) / own["n"].to_numpy())
        most = cut.max(0).reshape(-1, 2).max(1)
        some = rows.sparkSession.createDataFrame([(int(i), float(most[i])) for i in np.flatnonzero(most)], "stratum int, most double")

        @lean
        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, views, teacher, mine, code in sure_rows(batches):
                at = np.flatnonzero(mine & (batch.column("u").to_numpy() < cut[teacher, np.maximum(code, 0)]))
                given = [batch.column("key").take(pa.array(at)), pa.array(np.full(len(at), teacher), pa.int32()), pa.array(code[at] % 2, pa.int32())]
                yield pa.RecordBatch.from_arrays([*given, *_packed(tuple(v[at] for v in views))], names=["key", "teacher", "label", "t", "m"])

        under = keyed.join(F.broadcast(some), "stratum").where("u < most").select(*keyed.columns)
        got = under.mapInArrow(give, f"key long, teacher int, label int, {_FEATURES}").dropDuplicates(["key", "teacher"]).toPandas().sort_values(["teacher", "key"])
        taken = np.union1d(taken, got["key"].to_numpy(np.int64))
        return *_unpacked(got), got["teacher"].to_numpy(), got["label"].to_numpy(float)

    return pick


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Models | None:
    """The two view models, from a bounded sample of labelled rows and pseudo-labels of the whole corpus.

    None where labels hold fewer than two classes.  Of several labels of one id
    the mean counts, ties as good.  Ids and labels that are null are left out;
    rows of null id, and labelled rows outside the sample, are unlabelled.
    """
    rows = _inputs(docs, id_col)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = marks.orderBy(F.xxhash64(F.col("id"), F.lit(7)), "id").limit(labelled).toPandas().set_index("id")["y"]
    if known.nunique() < 2:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in known.index], "id long"))
    # of rows repeated under one id the least counts, so that models do not depend on the order of arrival
    once = rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*_COLUMNS)).alias("r")).select("id", "r.*")
    got = _sample_features(arrow_rows(once)).sort_values("id")
    y = known.reindex(got["id"]).to_numpy(float)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    good = float(np.clip(y[~held].mean(), 0.02, 0.98))
    return co_train(_unpacked(got), y, held, corpus_pick(rows.join(wanted, "id", "left_anti"), (1 - good, good)), rounds)


def score(docs: DataFrame, models: Models | None, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(id_col, text_score, meta_score, score, kept) for each row of ``docs``.

    Without models (labels of fewer than two classes) scores are null and every
    row is kept.  Null columns have features of their own; a null text counts as
    empty.  Repeated rows score alike.  An empty table gives no rows.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                if models is None:
                    none = pa.nulls(batch.num_rows, pa.float64())
                    cols = [none, none, none, pa.array([True] * batch.num_rows)]
                else:
                    found = combined(models, view_features(batch))
                    cols = [*map(pa.array, found), pa.array(found[2] >= threshold)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "text_score", "meta_score", "score", "kept"])

    return _inputs(docs, id_col).mapInArrow(run, "id long, text_score double, meta_score double, score double, kept boolean").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``; see train() and score()."""
    return score(docs, train(docs, labels, id_col, labelled=labelled), id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; columns unchanged.

    Nulls count as in score(); repeated rows stay or go alike; without labels of
    two classes all rows stay; an empty table gives no rows.
    """
    models = train(docs, labels, id_col, labelled=labelled)
    if models is None:
        return docs
    names = docs.columns
    at = [names.index(c) if c in names else None for c in _COLUMNS]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                cols = [pa.nulls(batch.num_rows, t) if i is None else batch.column(i).cast(t) for i, t in zip(at, kinds, strict=True)]
                rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), *cols], names=["id", *_COLUMNS])
                yield batch.filter(pa.array(combined(models, view_features(rows))[2] >= threshold))

    return arrow_rows(docs).mapInArrow(run, docs.schema)
