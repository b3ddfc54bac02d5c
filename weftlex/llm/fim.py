"""Fill-in-middle transformation by bit-parallel arithmetic on big integers.

A text is its UTF-8 bytes; a class of bytes is one integer with a bit for each
byte, made by ``bytes.translate`` and a parse in base 2.  Shifts and Boolean
operations on these mark where units begin, ``bit_count`` counts them, and the
byte at which the k-th unit begins is found by halving the integer again and
again.  All of it is linear in the text; nothing is done for each character.

The cut points are drawn from a digest of the row's id, so a row gives the same
result wherever and whenever it is processed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, lean

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Percent of texts that are cut, and percent of those that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7


def _class(members: Callable[[int], bool]) -> bytes:
    """The translation table that makes "1" of each byte of a class and "0" of all others."""
    return bytes(0x31 if members(b) else 0x30 for b in range(256))


_NEWLINE = _class(lambda b: b == 0x0A)
_FIRST = _class(lambda b: b & 0xC0 != 0x80)
_WORD = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_IS = {b: _class(lambda x, b=b: x == b) for b in {c for m in MARKERS for c in m.encode()}}


def mask(data: bytes, table: bytes) -> int:
    """The class of ``table`` as an integer: bit i is set if byte i is in it."""
    return int(data[::-1].translate(table), 2) if data else 0


def line_starts(data: bytes) -> int:
    """Where lines ``[^\\n]*\\n|[^\\n]+`` begin: at the text's start and after every line feed but a last one."""
    return (mask(data, _NEWLINE) << 1 | 1) & ((1 << len(data)) - 1)


def char_starts(data: bytes) -> int:
    return mask(data, _FIRST)


def word_starts(data: bytes) -> int:
    """Where words with the white space after them begin; white space that leads the text belongs to its first word."""
    words = mask(data, _WORD)
    return (words & ~(words << 1) & ~((words & -words) if words else 0)) | (1 if data else 0)


UNITS: dict[str, Callable[[bytes], int]] = {"lines": line_starts, "words": word_starts, "chars": char_starts}


def select(bits: int, k: int, size: int) -> int:
    """The place of the k-th set bit (from 0) of ``bits``, which is below 2**size; ``size`` if there are no more than k."""
    if k >= bits.bit_count():
        return size
    at, width = 0, 1 << max(0, size - 1).bit_length()
    while width > 1:
        width >>= 1
        low = bits & ((1 << width) - 1)
        n = low.bit_count()
        if k < n:
            bits = low
        else:
            bits, k, at = bits >> width, k - n, at + width
    return at


def has_marker(data: bytes, markers: tuple[str, ...] = MARKERS) -> bool:
    """Whether a marker occurs: the masks of its bytes, shifted onto its first one, share a bit."""
    for m in markers:
        found = -1
        for i, b in enumerate(m.encode()):
            found &= mask(data, _IS.get(b) or _class(lambda x, b=b: x == b)) >> i
            if not found:
                break
        if found:
            return True
    return False


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def transform(text: str | None, key: str, seed: int = SEED, units: str = "lines", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> Cut:
    """Cut one text into prefix, middle and suffix at unit bounds drawn from ``seed`` and ``key``.

    ``form`` is plain (text unchanged), psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle).  Null counts as empty; an empty text, one that
    holds a marker, and ``100 - rate`` percent of the others are plain.
    """
    data = (text or "").encode()
    starts = UNITS[units](data)
    n = starts.bit_count()
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not data or h3 % 100 >= rate or has_marker(data, markers):
        return Cut(n, "plain", None, None, text or "")
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    lo, hi = select(starts, a, len(data)), select(starts, b, len(data))
    chars = char_starts(data)
    until = [(chars & ((1 << at) - 1)).bit_count() for at in (lo, hi)]
    prefix, middle, suffix = (x.decode() for x in (data[:lo], data[lo:hi], data[hi:]))
    p, s, m = markers
    first = h4 % 100 < suffix_first
    return Cut(n, "spm" if first else "psm", until[0], until[1] - until[0], f"{s}{suffix}{p}{prefix}{m}{middle}" if first else f"{p}{prefix}{s}{suffix}{m}{middle}")


def restore(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text that transform() cut.  No text that was cut holds a marker, so the first of each kind is the one put there."""
    if form == "plain":
        return output
    p, s, m = markers
    order = (s, p, m) if form == "spm" else (p, s, m)
    a, rest = output[len(order[0]) :].split(order[1], 1)
    b, middle = rest.split(m, 1)
    return b + middle + a if form == "spm" else a + middle + b


def _clear(markers: tuple[str, str, str]) -> None:
    """Markers must differ, and no end of one may begin another, or text beside a marker could be taken for one."""
    ends = any(x.startswith(y[-k:]) for x in markers for y in markers for k in range(1, min(len(x), len(y)) + (x != y)) if y[-k:])
    inside = any(x in y for x in markers for y in markers if x != y)
    if len(set(markers)) < 3 or "" in markers or ends or inside:
        raise ValueError(f"markers are not clear of each other: {markers}")


def _mapped(docs: DataFrame, id_col: str, schema: str, row: Callable[[str, str | None], tuple]) -> DataFrame:
    """``row(key, text)`` for each document, in Arrow batches; the id comes first."""
    names = [x.split()[0] for x in schema.split(", ")][1:]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")][1:]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [row("" if i is None else str(i), t.as_py()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *names])

    rows = arrow_rows(docs).select(F.col(id_col).cast("long").alias(id_col), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", units: str = "lines", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for each row of ``docs``; see transform().

    A null id draws from the empty key; repeated rows give equal results; other
    columns are not read; an empty table gives no rows.
    """
    _clear(markers)
    schema = f"{id_col} long, n long, form string, prefix_chars long, middle_chars long, output string"
    return _mapped(docs, id_col, schema, lambda key, text: transform(text, key, seed, units, rate, suffix_first, markers))


def digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As fill_in_middle() with lines, the output and the text rebuilt from it as SHA-256, so long texts do not travel."""

    def row(key: str, text: str | None) -> tuple:
        got = transform(text, key)
        back = restore(got.output, got.form)
        return (*got[:4], *(hashlib.sha256(x.encode()).hexdigest() for x in (got.output, back)))

    return _mapped(docs, id_col, f"{id_col} long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", row)


SQL = """
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
  SELECT doc_id, text, ('0x' || substr(d, 1, 8))::UBIGINT::BIGINT AS h1, ('0x' || substr(d, 9, 8))::UBIGINT::BIGINT AS h2, ('0x' || substr(d, 17, 8))::UBIGINT::BIGINT AS h3,
    ('0x' || substr(d, 25, 8))::UBIGINT::BIGINT AS h4, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines
  FROM keyed
), cut AS (
  SELECT doc_id, text, lines, len(lines)::BIGINT AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
