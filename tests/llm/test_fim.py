"""Fill-in-middle cuts against regular expressions, exact round trips, and edges."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from weftlex.llm import fim

PIECES = ["a", "é", "日本", "\n", "\n\n", " ", "<", "<P", "P>", "x\r", "😀", "<S>", "\t", "words of a line", " "]
UNITS = {"lines": r"[^\n]*\n|[^\n]+", "chars": r"(?s).", "words": r"^[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]*|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*"}


def texts(n=300, seed=5):
    draw = random.Random(seed)
    return ["", "\n", "x", "\n\n\n", "<M>", "<<P>>", *("".join(draw.choices(PIECES, weights=[5, 3, 2, 4, 1, 3, 1, 1, 1, 1, 1, 0.1, 1, 3, 1], k=draw.randint(1, 40))) for _ in range(n))]


def brute(text, key, units="lines", rate=100, first=50):
    parts = [x for x in re.findall(UNITS[units], text) if x]
    assert "".join(parts) == text
    n, h = len(parts), hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or any(m in text for m in fim.MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h4 % 100 < first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("units", "rate", "first"), [("lines", 100, 50), ("chars", 60, 20), ("words", 100, 100)])
def test_cuts_equal_regular_expressions(units, rate, first):
    for i, text in enumerate(texts()):
        got = fim.transform(text, str(i), units=units, rate=rate, suffix_first=first)
        assert tuple(got) == brute(text, i, units, rate, first)
        assert fim.restore(got.output, got.form) == text


def test_select_finds_every_bit():
    draw = random.Random(3)
    for size in (1, 2, 63, 64, 65, 1000):
        bits = draw.getrandbits(size)
        at = [i for i in range(size) if bits >> i & 1]
        assert [fim.select(bits, k, size) for k in range(len(at) + 2)] == [*at, size, size]


def test_markers_must_be_clear():
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<a", "a>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="clear"):
            fim._clear(bad)
    fim._clear(("<|prefix", "[suffix", "{middle"))
    got = fim.transform("one\ntwo\nthree\n", "4", markers=("<|prefix", "[suffix", "{middle"))
    assert fim.restore(got.output, got.form, ("<|prefix", "[suffix", "{middle")) == "one\ntwo\nthree\n"


def test_rows(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts(60))] + [(None, "a\nb", "x"), (3, None, "x"), (3, "\n\n\n", "clash"), (-1, "line of a long text é\n" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumnsRenamed({})
    got = fim.fill_in_middle(df).collect()
    want = sorted((repr((i, *brute(t or "", "" if i is None else i))) for i, t, _ in rows))
    assert sorted(repr(tuple(r)) for r in got) == want
    sums = {(r.doc_id, r.restored_sha256) for r in fim.digests(df).collect()}
    assert sums == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert fim.digests(df.limit(0)).count() == 0
