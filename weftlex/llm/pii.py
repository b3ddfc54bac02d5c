"""Personal data: base spans by format, further spans by candidate gradient boosting.

High-recall generators propose overlapping spans; each gets format features (of
the span) and context features (of the characters around it); boosted trees,
one model for each kind, score it; a threshold calibrated on held-out samples
selects.  Samples are generated from seeded templates in several layouts of
text, TRAIN_SAMPLES for each kind, so that every executor and every run has the
same model; trees, calibration and threshold each have samples of their own.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, lean

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
#: Labelled samples generated for the trees of each kind; a third as many calibrate, as many again set the threshold.
TRAIN_SAMPLES = 3000
#: Precision that a calibrated threshold must reach on the held-out samples.
PRECISION = 0.98
CONTEXT = 32

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The contract's matches: leftmost, non-overlapping within a kind, failing ones dropped."""
    out: list[Span] = []
    if "@" in text:
        past = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                past = m.end()
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return out


# -- candidates ---------------------------------------------------------------

#: High-recall generators by kind.  Bounded repeats keep each of them linear.
GENERATORS: dict[str, tuple[re.Pattern, ...]] = {
    "email": (
re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.I),
        re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4}", re.I),
        re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} @ [A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}"),
    ),
    "ip": (re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::[0-9A-Fa-f]{1,4}|:|[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"), re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}|\(\.\)[0-9]{1,3}| \. [0-9]{1,3}){3}(?![0-9])")),
    "card": (re.compile(r"(?<![0-9])[0-9]{4}(?:[._/ -]{1,2}[0-9]{4}){3}(?![0-9])"),),
    "phone": (
        re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])"),
        re.compile(r"(?<![0-9])00[1-9][0-9]{0,2}[ ./-]?[0-9()]{2,5}(?:[ ./-]?[0-9]{2,4}){2,4}(?![0-9])"),
        re.compile(r"(?<![0-9.,$#/-])[0-9]{10,11}(?![0-9]|[.,/-][0-9])"),
    ),
}
#: A text without the hint cannot hold a candidate of the kind.
_HINT = {"email": re.compile(r"at[\s)\]}]| @ ", re.I), "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9][\[( ]\."), "card": re.compile(r"[0-9]{4}"), "phone": re.compile(r"[0-9]{3}")}
_CUES = {
    "email": re.compile(r"e-?mail|contact|write|reach|correo|courriel|address", re.I),
    "ip": re.compile(r"\bip(?:v[46])?\b|host|server|client|login|addr", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|carte|tarjeta|karte|pan\b", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|whats|sms|ruf|handy|llam|t[ée]l", re.I),
}
_OTHER = re.compile(r"order|invoice|isbn|version|ref|id\b|no\.?\b|#|sku|part|page|date|total|price|serial|ticket|build", re.I)


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    found: set[Span] = set()
    has_digit = _DIGIT.search(text)
    for kind, patterns in GENERATORS.items():
        if (kind == "email" or has_digit) and _HINT[kind].search(text):
            for p in patterns:
                found.update((m.start(), m.end(), kind) for m in p.finditer(text))
    return sorted(found)


def features(text: str, span: Span) -> list[float]:
    """Format features of the span and context features around it."""
    start, end, kind = span
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    return [
        len(s), len(d), len(groups), max(map(len, groups), default=0), len(groups[-1]) if groups else 0,
        luhn(d) if d else 0, s.count("-"), s.count("."), s.count(" "), s.count("/"), "(" in s, s.startswith("00"), sum(c.isalpha() for c in s), len(set(d)),
        bool(re.search(r"\(|\[|\{| @ ", s)), s.count(":"), bool(re.search(r"(?:\.| dot |\(dot\)|\[dot\])\s?(?:com|org|net|edu|io|de|fr|es|info)$", s, re.I)),
        bool(_CUES[kind].search(before)), bool(_OTHER.search(before)), bool(_CUES[kind].search(after)), before[-1:].isalnum(), after[:1].isalnum(), before[-2:-1] == ":" or before[-1:] == ":", "$" in before[-3:] or "€" in before[-3:],
        bool(re.search(r"\b(?:19|20)\d\d\b", s)),
    ]


# -- boosted trees ------------------------------------------------------------


class Boosted:
    """Gradient-boosted depth-limited regression trees on the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 10):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list = []
        self.start = 0.0
        self.scale = (1.0, 0.0)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = -gs / (hs + 1.0)
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            at = np.arange(1, len(rows))
            ok = (v[1:] > v[:-1]) & (at >= self.least) & (len(rows) - at >= self.least)
            if ok.any():
                gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    @classmethod
    def _value(cls, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, cls._value(a, x), cls._value(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self.rate * self._value(tree, x)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on samples that the trees have not seen."""
        z, a, b = self.raw(x), 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.05 * ((p - y) * z).mean(), b - 0.05 * (p - y).mean()
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -50, 50)))


#: Layouts that a sample stands in: prose, a form, a log line, an object, a table row, mark-up.
LAYOUTS = ("{noise} {cue} {body}{stop}{word}", "{word}\n{cue}: {body}\n{noise}", "2024-03-05T10:11:12 {word} {cue}={body} {noise}", '{{"{word}": "{noise}", "{cue}": "{body}"}}', "{word},{cue},{body},{noise}", "<td>{cue}</td><td>{body}</td><p>{noise}</p>")


def _sample(kind: str, good: bool, rng: random.Random, layout: str = LAYOUTS[0]) -> str:
    """A short text with personal data of the kind in an uncommon form, or with a look-alike."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    sep = rng.choice([" ", "-", ".", "/"])
    noise = " ".join(word() for _ in range(rng.randint(1, 4)))
    cue = rng.choice({"email": ["email", "e-mail:", "contact", "write to", "", ""], "ip": ["ip", "host", "server", "from", "", "addr:"], "card": ["card", "visa", "credit card:", "tarjeta", "", "karte"], "phone": ["phone", "tel:", "call", "mobile", "fax", "tel.", "cell", "handy"]}[kind])
    other = rng.choice(["order", "invoice no.", "isbn", "version", "ref", "part", "page", "date", "total", "price $", "", "serial", "build", noise])
    if kind == "email":
        tld = rng.choice(["com", "org", "net", "edu", "de", "fr", "es", "io"])
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), (" [at] ", "."), ("{at}", "{dot}")])
        body = f"{word()}{at}{word()}{dot}{tld}" if good else rng.choice([f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.{word()}", f"met at {word()} dot {word()}", f"{n(2)} @ {n(2)}.{n(2)}"])
    elif kind == "ip":
        good_body = rng.choice([":".join(f"{rng.randrange(65536):x}" for _ in range(8)), "[.]".join(str(rng.randrange(256)) for _ in range(4)), f"2001:db8:{rng.randrange(65536):x}:{rng.randrange(65536):x}::{rng.randrange(99)}".replace("::", ":", rng.randrange(2))])
        body = good_body if good else rng.choice([f"{n(2)}:{n(2)}:{n(2)}:{n(2)}", f"{n(1)}:{n(1)}:{n(1)}:{n(1)}", " . ".join(n(3) for _ in range(4)), f"{n(2)}:{n(2)}:{n(2)}:{n(3)}"])
    elif kind == "card":
        d = n(15)
        d += next(c for c in "0123456789" if luhn(d + c) == good)
        body = rng.choice([". ", "  ", "_", ".", "/", " -"]).join(d[k : k + 4] for k in range(0, 16, 4))
    else:
        body = rng.choice([f"({n(3)}){sep}{n(3)}-{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"00{rng.choice(['1', '44', '49', '33', '34'])} {n(3)} {n(3)} {n(4)}", f"{n(10)}"]) if good else rng.choice([f"{n(2)}{sep}{n(4)}{sep}{n(4)}", f"{n(4)}-{n(3)}-{n(3)}", f"{n(10)}", f"{n(3)}.{n(3)}.{n(3)}", f"{n(4)}/{n(4)}/{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}"])
    if not good and kind == "phone":
        cue = other
    elif not good and rng.random() < 0.5:
        cue = other
    return layout.format(noise=noise, cue=cue, body=body, stop=rng.choice([" ", ". ", ", "]), word=word())


@lru_cache(maxsize=4)
def models(samples: int = TRAIN_SAMPLES, precision: float = PRECISION) -> dict[str, tuple[Boosted, float]]:
    """Calibrated trees and the threshold that selects a redaction, by kind."""
    out = {}
    for kind in KINDS:
        x, y = _labelled(kind, samples, "trees")
        model = Boosted().fit(x, y).calibrate(*_labelled(kind, samples // 3, "calibration"))
        x, truth = _labelled(kind, samples // 3, "threshold")
        p = model.probability(x)
        order = np.argsort(-p, kind="stable")
        good_so_far = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(good_so_far >= precision)
        out[kind] = (model, max(0.5, float(p[order][enough[-1]])) if len(enough) else 1.1)
    return out


def _labelled(kind: str, n: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in n samples of a set; every set has a seed of its own."""
    rng, x, y = random.Random(f"{kind} {name}"), [], []
    for k in range(n):
        text = _sample(kind, good := k % 2 == 0, rng, LAYOUTS[k // 2 % len(LAYOUTS)])
        for span in candidates(text):
            if span[2] == kind:
                x.append(features(text, span))
                y.append(good)
    return np.array(x, float), np.array(y, float)


class _Taken:
    """Disjoint ranges in order, asked whether a span overlaps one of them."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def method_spans(text: str, base: list[Span], trained: dict | None = None) -> list[Span]:
    """Selected candidates that overlap neither a base span nor a likelier candidate."""
    found = candidates(text)
    if not found:
        return []
    taken = _Taken(base)
    found = [s for s in found if not taken.meets(s[0], s[1])]
    trained = trained or models()
    scored = []
    for kind in KINDS:
        own = [s for s in found if s[2] == kind]
        if own:
            model, least = trained[kind]
            scored += [(p, s) for p, s in zip(model.probability(np.array([features(text, s) for s in own], float)), own, strict=True) if p >= least]
    out: list[Span] = []
    for _, s in sorted(scored, key=lambda x: (-x[0], x[1])):
        if not taken.meets(s[0], s[1]):
            taken.add(s[0], s[1])
            out.append(s)
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind's tag."""
    out, past = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])):
        if a >= past:
            out += [text[past:a], f"[{kind.upper()}]"]
        past = max(past, b)
    return "".join([*out, text[past:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each row.

    The counts and base_sha256 are of the base spans; ``spans`` lists these and
    the method's, positions in code points, end exclusive.  A null text counts
    as empty: no spans, digest of the empty string.  Whole texts are searched,
    whatever their length; rows are independent, so repeated ids and rows stay;
    other columns are not read; an empty table gives no rows.
    """
    trained = models()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                more = method_spans(text, base, trained)
                for k, kind in enumerate(KINDS):
                    out[k].append(sum(s[2] == kind for s in base))
                out[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[5].append(listed(base + more))
                out[6].append(len(base) + len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()], strict=True))], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    schema = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return arrow_rows(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text_col`` replaced by tags such as [EMAIL]; null stays null, other columns as they are."""
    schema, trained = docs.schema, models()
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for cell in batch.column(at):
                text = cell.as_py()
                if text:
                    base = base_spans(text)
                    spans = base + method_spans(text, base, trained)
                    text = redacted(text, spans) if spans else text
                texts.append(text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return arrow_rows(docs).mapInArrow(run, schema)
