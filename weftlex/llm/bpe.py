"""Byte-level BPE by forced-boundary splitting.

A byte pair that no vocabulary token contains can never be inside one token, so
merges never cross it.  Every such pair at which the pre-tokenizer too does the
same on both sides (``Codec.cuts`` gives the cases) is a certain cut, between
words and inside them.  The fragments of a block of texts are made one Arrow
dictionary, each distinct fragment is encoded once, and ids, their decimal text
and the decoded bytes of all fragments are put together by Arrow's take.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import arrow_rows, lean

#: Fragments that a worker keeps, and the longest that it keeps (bytes).
CACHE_ENTRIES = 100_000
CACHE_BYTES = 48
#: Bytes of text that are cut at a time; a longer text is cut in windows that end at certain cuts.
BLOCK_BYTES = 1 << 20

#: Fixed value: the pieces of the byte-level pre-tokenizer, within which merges are made.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# kinds of characters; OTHER: not told apart here, so no cut is made beside them
OTHER, LETTER, DIGIT, SYMBOL, SPACE, QUOTE = range(6)


def _kinds() -> np.ndarray:
    """The kind of a character by its first byte."""
    out = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SYMBOL
    out[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    out[ord("'")] = QUOTE
    out[0xC3:0xCB] = LETTER  # U+00C0 to U+02AF, all letters but U+00D7 and U+00F7
    out[[0xE5, 0xE6, 0xE7, 0xE8, 0xEB, 0xEC]] = LETTER  # U+5000 to U+8FFF, U+B000 to U+CFFF
    return out


_KIND = _kinds()
_SOLID = np.isin(np.arange(6), (LETTER, DIGIT, SYMBOL))
_INK = np.isin(np.arange(6), (LETTER, DIGIT, SYMBOL, QUOTE))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


#: (token count, decimal ids each with a comma after it, decoded bytes, ids)
Entry = tuple[int, bytes, bytes, list[int]]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model, before, after = file["model"], file.get("pre_tokenizer") or {}, file.get("decoder") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or after.get("type") != "ByteLevel":
            raise ValueError(f"{vocabulary}: not a byte-level BPE vocabulary")
        #: Cuts are certain only for the pieces that the cases of cuts() are derived from, and for plain merges.
        self.may_cut = bool(before.get("use_regex", True)) and not before.get("add_prefix_space") and not file.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        table = _byte_of()
        self.bytes_of = {i: bytes(table[c] for c in token) for token, i in model["vocab"].items()}
        self.never = np.ones(1 << 16, bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:], strict=False):
                self.never[a << 8 | b] = False
        added = file.get("added_tokens", [])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError(f"{vocabulary}: added tokens that take in their surroundings")
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.bytes_of |= {i: t for t, i in self.special.items()}
        self.apart = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ascii = self._ascii(model) if self.may_cut else None
        self.cache: dict[bytes, Entry] = {}

    def _ascii(self, model: dict):
        """A faster encoder for ASCII fragments, where the ids follow the order of the merges; else None."""
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][p] for p in pairs]
        if ids != sorted(ids) or ids and ids[0] <= max(i for t, i in model["vocab"].items() if len(t) == 1):
            return None
        import tiktoken

        plain = {token: i for i, token in self.bytes_of.items() if token not in self.special}
        return tiktoken.Encoding("ascii", pat_str=PIECES, mergeable_ranks=plain, special_tokens={}).encode_ordinary

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte of UTF-8 ``data``, whether a certain cut is before it.

        All of: the pair of bytes is inside no token; the second begins a
        character; and, x and y being the characters on either side,

        * y is white space and x is not: a piece ends there in any case; or
        * both are letters, digits or symbols and no apostrophe is next to the
          pair: pieces start there, or go on alike without what is before; or
        * x is a single line end or tab after ink: a piece by itself.

        Two bytes before and none after the pair are looked at, so cuts do not
        depend on how a text is dealt out.
        """
        out = np.zeros(len(data), bool)
        if not self.may_cut or len(data) < 2:
            return out
        kind, cont = _KIND[data], (data & 0xC0) == 0x80
        if cont.any():
            sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
            kind[sign] = OTHER
            for _ in range(3):
                kind[1:] = np.where(cont[1:], kind[:-1], kind[1:])
        x, y = kind[:-1], kind[1:]
        older = np.concatenate([[np.uint8(OTHER)], kind[:-2]])
        alone = (x == SPACE) & (data[:-1] != 0x20) & _INK[older] & _INK[y]
        ok = (_INK[x] & (y == SPACE)) | (_SOLID[x] & _SOLID[y] & (older != QUOTE)) | alone
        out[1:] = ok & self.never[data[:-1].astype(np.uint16) << 8 | data[1:]] & ~cont[1:]
        return out

    def _starts(self, data: np.ndarray, texts: np.ndarray, context: int = 0) -> np.ndarray:
        """Positions at which fragments of ``data[context:]`` begin; ``texts`` are starts of texts."""
        cut = self.cuts(data)
        cut[: context + 1] = False
        if self.apart:
            raw = data.tobytes()
            if any(s in raw for s in self.special):
                for lo, hi in zip(texts, [*texts[1:], len(data)], strict=True):
                    for m in self.apart.finditer(raw[lo:hi]):
                        cut[lo + m.start() : lo + m.end()] = False
                        cut[lo + m.start()] = True
                        if lo + m.end() < len(data):
                            cut[lo + m.end()] = True
        cut[texts[texts < len(data)]] = True
        return np.flatnonzero(cut)

    def _entry(self, ids: list[int]) -> Entry:
        return len(ids), "".join([f"{i}," for i in ids]).encode(), b"".join(map(self.bytes_of.__getitem__, ids)), ids

    def entries(self, fragments: list[bytes]) -> list[Entry]:
        """What each distinct fragment is encoded to; kept from call to call within CACHE_ENTRIES."""
        cache = self.cache
        new = [f for f in fragments if f not in cache]
        made: dict[bytes, Entry] = {}
        slow = []
        for f in new:
            if f in self.special:
                made[f] = self._entry([self.special[f]])
            elif self.ascii and f.isascii():
                made[f] = self._entry(self.ascii(f.decode()))
            else:
                slow.append(f)
        if slow:
            for f, e in zip(slow, self.tokenizer.encode_batch_fast([f.decode() for f in slow], add_special_tokens=False), strict=True):
                made[f] = self._entry(e.ids)
        out = [made[f] if f in made else cache[f] for f in fragments]
        keep = {f: e for f, e in made.items() if len(f) <= CACHE_BYTES}
        if len(cache) + len(keep) > CACHE_ENTRIES:
            cache.clear()
        if len(keep) <= CACHE_ENTRIES:
            cache.update(keep)
        return out

    def fragments(self, text: str) -> list[str]:
        """Pieces of ``text`` between certain cuts; their concatenation is ``text``."""
        raw = text.encode()
        at = [*self._starts(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64)).tolist(), len(raw)] if raw else []
        return [raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)]

    def encode(self, text: str) -> list[tuple[int, str, bytes]]:
        """(token count, ids joined by commas, decoded bytes) of each fragment in order."""
        return [(n, ids[:-1].decode(), plain) for n, ids, plain, _ in self.entries([f.encode() for f in self.fragments(text)])]

    def encode_block(self, data: np.ndarray, starts: np.ndarray, with_ids: bool) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array | None]:
        """Token counts, decimal ids, decoded bytes and ids of the fragments of ``data`` that begin at ``starts``."""
        at = np.append(starts, len(data)).astype(np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        found = self.entries(whole.dictionary.to_pylist())
        n, text, plain, ids = zip(*found, strict=True) if found else ([], [], [], [])
        taken = [pa.array(c, pa.binary()).take(whole.indices) for c in (text, plain)]
        counts = np.array(n, np.int64)[whole.indices.to_numpy()]
        return counts, *taken, pa.array(ids, pa.list_(pa.int32())).take(whole.indices) if with_ids else None


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def _flat(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a binary column that has no offset, and the positions of its values."""
    _, at, raw = column.buffers()
    return memoryview(raw or b""), np.frombuffer(at, np.int32, len(column) + 1)


def _windows(c: Codec, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, fragment starts) of blocks of whole texts, or of the windows of a long one."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        if hi - lo <= BLOCK_BYTES:
            yield row, stop, data[lo:hi], c._starts(data[lo:hi], offsets[row:stop] - lo)
        else:
            first, size = lo, BLOCK_BYTES
            longest = max(map(len, c.special), default=0)
            while lo < hi:
                end, context = min(hi, lo + size), min(8, lo - first)
                starts = c._starts(data[lo - context : end], np.array([context]), context) - context
                # the last fragments go to the next window: they, or a special token, may not end here
                inner = starts[starts < end - lo - longest] if end < hi else starts
                if end < hi and len(inner) < 2:
                    size *= 2
                    continue
                stop_at = end if end == hi else lo + int(inner[-1])
                yield row, stop, data[lo:stop_at], starts[starts < stop_at - lo]
                lo, size = stop_at, BLOCK_BYTES
        row = stop


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of ``docs``.

    Ids equal those of the tokenizers library without special tokens added,
    truncation or padding; the string of a special token in a text is that
    token.  ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of
    the UTF-8 text decoded from the ids.  A null text counts as empty: no token.
    Rows are independent, so repeated ids and rows stay as they are; other
    columns are not read; an empty table gives no rows.  A long text is encoded
    window by window.  ``vocabulary`` is a path that every executor can open
    (default: the installed package's); one that is not byte-level BPE raises,
    and one with another pre-tokenizer than PIECES is encoded without cuts.
    """
    path = vocabulary or default_vocabulary()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = batch.num_rows
            n = np.zeros(rows, np.int64)
            ids_sha, text_sha = ([hashlib.sha256() for _ in range(rows)] for _ in range(2))
            tails, ids = [b""] * rows, []
            for first, stop, data, starts in _windows(c, *wordhash.buffers(batch.column(1))):
                counts, joined, plain, own = c.encode_block(data, starts, with_ids)
                offsets = _offsets(batch, first, stop, data, starts)
                total = np.concatenate([[0], np.cumsum(counts)])
                raw, at = _flat(joined)
                out, to = _flat(plain)
                for k in range(stop - first):
                    a, b = offsets[k], offsets[k + 1]
                    if a == b:
                        continue
                    n[first + k] += total[b] - total[a]
                    sha, lo, hi = ids_sha[first + k], at[a], at[b]
                    sha.update(tails[first + k])
                    sha.update(raw[lo : hi - 1])
                    tails[first + k] = b","
                    text_sha[first + k].update(_utf8(out[to[a] : to[b]]))
                if own is not None:
                    ids.append(own.flatten())
            cols = [batch.column(0), pa.array(n), pa.array([x.hexdigest() for x in ids_sha], pa.string()), pa.array([x.hexdigest() for x in text_sha], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def _offsets(batch: pa.RecordBatch, first: int, stop: int, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if stop - first == 1:
            return np.array([0, len(starts)])
        _, at = wordhash.buffers(batch.column(1))
        return np.searchsorted(starts, at[first : stop + 1] - at[first])

    def _utf8(raw: memoryview) -> bytes | memoryview:
        try:
            str(raw, "utf-8")
        except UnicodeDecodeError:
            return str(raw, "utf-8", "replace").encode()
        return raw

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow_rows(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id_col, text) from arrays of ids; null ids give a null text, bytes that are no UTF-8 give U+FFFD.

    An id that is not in the vocabulary raises; repeated rows stay; an empty
    table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(path).bytes_of
        for batch in batches:
            texts = [None if x is None else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return arrow_rows(encoded).select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
