"""Token and word alignment, and the incremental word-unit table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def char_tokens(text: Column) -> Column:
    """Tokens of a character tokenizer, as the position, code point and offsets of each non-space character."""
    chars = F.transform(F.split(text, ""), lambda ch, i: F.struct(F.ascii(ch).cast("long").alias("id"), i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), ch.alias("ch")))
    kept = F.filter(chars, lambda x: (x["ch"] != "") & ~x["ch"].rlike(r"^\s$"))
    return F.transform(kept, lambda x, p: F.struct(p.alias("pos"), x["id"].alias("id"), x["start"].alias("start"), x["end"].alias("end")))


def word_spans(text: Column) -> Column:
    """Words with their character offsets: array<struct(ordinal, surface, start, end)>.

    The pieces between words and the words alternate, so running lengths give
    the offsets.
    """
    gaps, found = F.transform(F.split(text, T.WORD, -1), F.length), T.words(text)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, w: F.struct(g.alias("g"), w.alias("w")))
    empty = F.array().cast("array<struct<ordinal:int,surface:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["g"]
        b = a + F.length(p["w"])
        one = F.struct(F.size(acc["out"]).alias("ordinal"), p["w"].alias("surface"), a.alias("start"), b.alias("end"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


#: Words of one output batch, whatever the texts of an input batch hold.
WORD_ROWS = 4096

Encode = Callable[[str], list[tuple[int, int, int]]]


def encode_chars(text: str) -> list[tuple[int, int, int]]:
    """(id, start, end) of the character tokenizer: each non-space character by itself."""
    return [(ord(ch), i, i + 1) for i, ch in enumerate(text) if not ch.isspace()]


def aligned(docs: DataFrame, id_col: str, text: str = "text", encode: Encode = encode_chars) -> DataFrame:
    """(id, ordinal, surface, start, end, positions, token_ids, relative_offsets) for each word of each text.

    ``encode`` gives the tokens of a whole text in order, with character
    offsets.  Words and tokens are both in order, so one pass over the two finds
    the overlaps; nothing is shuffled, and a task holds the tokens of one text and
    ``WORD_ROWS`` words.  A word that no token overlaps raises; a
    null text has no words.
    """
    kind = docs.schema[id_col].dataType
    pattern = T.WORD.replace("\\x{2011}", "\u2011")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(pattern)
        schema = None

        def made(batch: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
            nonlocal schema
            types = [batch.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
            schema = schema or pa.schema(list(zip([id_col, *_ALIGNED], types, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema=schema)

        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, cell in zip(batch.column(0), batch.column(1), strict=True):
                value = cell.as_py() or ""
                tokens, lo = encode(value), 0
                for ordinal, m in enumerate(word.finditer(value)):
                    a, b = m.span()
                    while lo < len(tokens) and tokens[lo][2] <= a:
                        lo += 1
                    hi = lo
                    while hi < len(tokens) and tokens[hi][1] < b:
                        hi += 1
                    if hi == lo:
                        raise ValueError(f"no token overlaps {m[0]!r} at {a}:{b}")
                    own = tokens[lo:hi]
                    for k, x in enumerate((key.as_py(), ordinal, m[0], a, b, list(range(lo, hi)), [t[0] for t in own], [[t[1] - a, t[2] - a] for t in own])):
                        out[k].append(x)
                    if len(out[0]) == WORD_ROWS:
                        yield made(batch, out)
                        out = [[] for _ in range(8)]
            yield made(batch, out)

    shape = f"`{id_col}` {kind.simpleString()}, ordinal int, surface string, start int, end int, positions array<int>, token_ids array<bigint>, relative_offsets array<array<int>>"
    return docs.select(id_col, F.col(text).cast("string").alias("text")).mapInArrow(run, shape)


_ALIGNED = ("ordinal", "surface", "start", "end", "positions", "token_ids", "relative_offsets")


def overlap_join(tokens: DataFrame, words: DataFrame, key: str, width: int = 256) -> DataFrame:
    """(key, pos, ordinal) of overlapping spans in exploded form, for texts too long for one row.

    Both sides are put into the bins of ``width`` characters that they touch; a
    pair is kept only in the bin where its overlap begins, so none is doubled.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    left = tokens.where("end > start").select(key, "pos", F.col("start").alias("ts"), F.col("end").alias("te"), bins(F.col("start"), F.col("end")).alias("bin"))
    right = words.where("end > start").select(key, "ordinal", F.col("start").alias("ws"), F.col("end").alias("we"), bins(F.col("start"), F.col("end")).alias("bin"))
    first = F.floor(F.greatest("ts", "ws") / width)
    return left.join(right, [key, "bin"]).where((F.col("te") > F.col("ws")) & (F.col("ts") < F.col("we")) & (F.col("bin") == first)).select(key, "pos", "ordinal")


def word_units(occurrences: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(word_id, surface, normalized): known units, then new ones by first occurrence.

    ``occurrences(ordinal, surface)``; ids go on from the largest known one, so
    a batch never renumbers what an earlier one has stored.
    """
    from .dictionary import numbered

    firsts = occurrences.groupBy("surface").agg(F.min("ordinal").alias("first"))
    start = 1
    if known is not None:
        firsts = firsts.join(known.select("surface"), "surface", "left_anti")
        start = (known.agg(F.max("word_id")).first()[0] or 0) + 1
    fresh = numbered(firsts.withColumn("normalized", T.fold_word(F.col("surface"))), ["first", "surface"], "word_id", start).select("word_id", "surface", "normalized")
    return fresh if known is None else known.select("word_id", "surface", "normalized").unionByName(fresh)


def word_forms(units: DataFrame, observed: DataFrame, encode=char_tokens) -> DataFrame:
    """Distinct forms (word_id, context_kind, token_ids, relative_offsets): alone, after a space, and as observed.

    ``observed(surface, token_ids, relative_offsets)``.
    """
    parts = lambda t, shift: (F.transform(t, lambda x: x["id"]).alias("token_ids"), F.transform(t, lambda x: F.array(x["start"] - shift, x["end"] - shift)).alias("relative_offsets"))
    alone = units.select("word_id", F.lit("standalone").alias("context_kind"), *parts(encode(F.col("surface")), 0))
    after = units.select("word_id", F.lit("after_space").alias("context_kind"), *parts(encode(F.concat(F.lit(" "), F.col("surface"))), 1))
    seen = observed.distinct().join(units.select("word_id", "surface"), "surface").select("word_id", F.lit("observed").alias("context_kind"), "token_ids", "relative_offsets")
    return alone.unionByName(after).unionByName(seen).distinct()


def vocabulary_table(pieces: DataFrame) -> DataFrame:
    """(token_id, token_piece, decoded_text, decoded_bytes, is_special), one row for each id: the least piece wins."""
    best = pieces.groupBy("token_id").agg(F.min_by(F.struct("decoded_text", "is_special"), "token_piece").alias("b"), F.min("token_piece").alias("token_piece"))
    return best.select("token_id", "token_piece", "b.decoded_text", F.encode("b.decoded_text", "UTF-8").alias("decoded_bytes"), "b.is_special")


def pack_batches(rows: DataFrame, group: str, ordinal: str, length: str, max_rows: int, max_padded: int) -> DataFrame:
    """Adds ``batch``: greedy runs in order within a group, each of at most ``max_rows`` rows and ``max_padded`` padded tokens.

    A batch's padded size is its rows times its longest row.  The rule looks at
    all rows before, so it folds over the group in order: groups are shards of
    a fixed size.
    """
    entries = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(length).cast("long").alias("n")))).alias("rows"))
    empty = F.array().cast("array<struct<o:bigint,batch:int>>")
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("m"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        m = F.greatest(acc["m"], x["n"])
        full = (acc["k"] > 0) & ((acc["k"] >= max_rows) | ((acc["k"] + 1) * m > max_padded))
        batch = acc["batch"] + full.cast("int")
        one = F.struct(x["o"].cast("long").alias("o"), batch.alias("batch"))
        return F.struct(batch.alias("batch"), F.when(full, F.lit(1).cast("long")).otherwise(acc["k"] + 1).alias("k"), F.when(full, x["n"]).otherwise(m).alias("m"), F.concat(acc["out"], F.array(one)).alias("out"))

    packed = entries.select(group, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x")).select(group, F.col("x.o").alias(ordinal), "x.batch")
    return rows.join(packed, [group, ordinal])
