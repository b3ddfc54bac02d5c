"""Corpus operators: cleaning, deduplication, budgets, exact n-gram tables, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import frequent as Q

#: Largest count of narrow rows that is broadcast.
BROADCAST_ROWS = 500_000
#: Rows of a source that share one prefix-sum partition.
PREFIX_ROWS = 1_000_000


def extracted(rows: DataFrame, text: Column, source: Column, pos: Column, keep: Column | None = None, unescape: bool = True) -> DataFrame:
    """(source, pos, text, status): cleaned text and why a row drops out ('filtered', 'empty', 'used').

    ``keep`` is a row filter; a filtered row, or one without text, is 'filtered',
    one that cleaning leaves empty is 'empty'.  Only rows to be cleaned are.
    """
    raw = text if keep is None else F.when(keep, text)
    df = rows.select(source.alias("source"), pos.cast("long").alias("pos"), F.nullif(raw, F.lit("")).alias("raw"))
    clean = F.when(F.col("raw").isNotNull(), T.clean_text(F.col("raw"), unescape))
    df = df.select("source", "pos", clean.alias("text"), F.col("raw").isNull().alias("dropped"))
    return df.select("source", "pos", "text", F.when(F.col("dropped"), "filtered").when(F.col("text") == "", "empty").otherwise("used").alias("status"))


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``digest``, SHA-256 of the text; the same classes as any other sound digest."""
    return df.withColumn("digest", F.sha2(F.col(text), 256))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that come first in ``order`` for their keys; order columns are not null.

    Only keys and order columns are shuffled to find the rows that come later.
    If these are few, counted, they are broadcast and the wide rows stay where
    they are; else the wide rows are shuffled once.  Nothing is sorted by text,
    and a hot key meets its minimum in partial sums.
    """
    narrow = df.select(*keys, F.struct(*order).alias("_o"))
    firsts = narrow.groupBy(*keys).agg(F.min("_o").alias("_first"))
    later = narrow.join(firsts, keys).where(F.col("_o") != F.col("_first")).select("_o.*").persist()
    later = F.broadcast(later) if later.count() <= BROADCAST_ROWS else later
    return df.join(later, order, "left_anti")


def dedup(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first row of each text by ``order`` (default: source, pos)."""
    return first_of_each(with_digest(df), ["digest"], order or ["source", "pos"])


def running_before(df: DataFrame, value: str, by: str = "source", order: str = "pos", rows: int = PREFIX_ROWS) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the group.

    Blocks of the order column are summed first, so that no task holds a whole
    group: a window over the block sums gives each block's start, a window
    within the block the rest.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / rows))
    blocks = df.groupBy(by, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(by, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    own = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, [by, "_block"]).withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_block", "_start")


def budget_cut(docs: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """(source, pos, text, digest, segments, n_words, before, kept_words, status) under word budgets.

    Sources are read one after the other, each until its budget is full, inside
    a document and a segment if need be.  A text seen before, in this source or
    in an earlier one before that one's cut, is a duplicate; a text that was
    never reached suppresses nothing.  Word-less texts count as seen.
    """
    docs = with_digest(docs).withColumn("segments", T.segments(F.col("text")))
    docs = docs.withColumn("n_words", F.size(F.flatten("segments")).cast("long"))
    seen, parts = None, []
    for source, budget in budgets.items():
        own = docs.where(F.col("source") == source)
        fresh = first_of_each(own, ["digest"], ["source", "pos"])
        if seen is not None:
            fresh = fresh.join(seen, "digest", "left_anti")
        cut = running_before(fresh, "n_words").where(F.col("before") < budget)
        cut = cut.withColumn("kept_words", F.least("n_words", F.lit(budget) - F.col("before"))).withColumn("status", F.when(F.col("n_words") == 0, "empty").otherwise("used"))
        parts.append(cut)
        mine = cut.select("digest")
        seen = mine if seen is None else seen.unionByName(mine)
    return reduce(DataFrame.unionByName, parts)


def cut_words(df: DataFrame) -> Column:
    """Words of ``segments`` up to ``kept_words``, segment by segment: array<array<string>>."""
    parts = F.transform("segments", lambda s, i: F.struct(s.alias("s"), F.aggregate(F.slice("segments", F.lit(1), i), F.lit(0), lambda acc, x: acc + F.size(x)).alias("b")))
    kept = F.transform(parts, lambda p: F.slice(p["s"], F.lit(1), F.greatest(F.lit(0), F.least(F.size(p["s"]), F.col("kept_words").cast("int") - p["b"]))))
    return F.filter(kept, lambda s: F.size(s) > 0)


def ngram_counts(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(text, frequency): exact counts of n-grams within segments, case kept.

    Partial counts are merged before and after one shuffle; a hot n-gram is one
    row for each task by then.
    """
    return docs.select(F.explode(T.ngrams(T.units(F.col(text)), n)).alias("text")).groupBy("text").agg(F.count("*").alias("frequency"))


def merged_counts(*partials: DataFrame) -> DataFrame:
    """(text, frequency) summed over partial count tables."""
    return reduce(DataFrame.unionByName, partials).groupBy("text").agg(F.sum("frequency").alias("frequency"))


def top_ranked(counts: DataFrame, n: int, k: int) -> DataFrame:
    """(text, frequency, n, rank): the k most frequent, ties by text; the report is k rows whatever the input."""
    top = counts.orderBy(F.desc("frequency"), "text").limit(k).withColumn("n", F.lit(n))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("frequency"), "text")).cast("long")).select("text", "frequency", "n", "rank")


def top_ngrams(docs: DataFrame, take: dict[int, int], text: str = "text") -> DataFrame:
    """(text, frequency, n, rank): as top_ranked of ngram_counts for each order n and its k, without counting rare n-grams."""
    counts = Q.top_counts(docs, take, text)
    return reduce(DataFrame.unionByName, (top_ranked(counts.where(F.col("n") == n).select("text", "frequency"), n, k) for n, k in take.items()))


def preview(ranked: DataFrame, k: int = 100) -> DataFrame:
    """(rank, line): tab-separated rank, frequency and text of the first k."""
    return ranked.where(F.col("rank") <= k).select("rank", F.concat_ws("\t", "rank", "frequency", "text").alias("line"))


def word_frequency(rows: DataFrame, text: str = "text", weight: str | None = None) -> DataFrame:
    """(word, frequency) by normalized word; a weight that is missing or below one counts as one."""
    w = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(1)), F.lit(1)) if weight else F.lit(1)
    counted = rows.select(F.explode(T.words(F.col(text))).alias("surface"), w.alias("w")).groupBy("surface").agg(F.sum("w").alias("w"))
    return counted.select(T.normalize_word(F.col("surface")).alias("word"), "w").groupBy("word").agg(F.sum("w").alias("frequency"))


def source_metrics(docs: DataFrame) -> DataFrame:
    """Per source: rows seen, used, filtered, empty and duplicate, words, bigrams and trigrams of those used.

    ``docs(source, pos, text, status)``; the first of equal texts over all
    sources is used, a text without words is empty.
    """
    found = T.units(F.col("text"))
    df = docs.withColumn("digest", F.when(F.col("status") == "used", F.sha2("text", 256)))
    firsts = df.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("source", "pos")).alias("f")).select("f.source", "f.pos", F.lit(True).alias("first"))
    df = df.join(firsts, ["source", "pos"], "left").withColumn("u", found)
    df = df.select("source", "status", "first", *(F.size(T.ngrams(F.col("u"), n)).cast("long").alias(f"n{n}") for n in (1, 2, 3)))
    used = (F.col("status") == "used") & F.col("first").isNotNull() & (F.col("n1") > 0)
    when = lambda c: F.count_if(c)
    return df.groupBy("source").agg(
        F.count("*").alias("rows_seen"),
        when(used).alias("documents_used"),
        when(F.col("status") == "filtered").alias("skipped_filter"),
        when((F.col("status") == "empty") | ((F.col("status") == "used") & F.col("first").isNotNull() & (F.col("n1") == 0))).alias("skipped_empty"),
        when((F.col("status") == "used") & F.col("first").isNull()).alias("skipped_duplicate"),
        *(F.coalesce(F.sum(F.when(used, F.col(f"n{n}"))), F.lit(0)).alias(name) for n, name in ((1, "tokens"), (2, "bigrams"), (3, "trigrams"))),
    )


def totals(metrics: DataFrame) -> DataFrame:
    """One row: the sums of the metrics over all sources."""
    return metrics.agg(F.count("*").alias("sources"), *(F.sum(c).alias(c) for c in metrics.columns if c != "source"))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A reproducible order of a stream: by a seeded hash of the key, then the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
