"""Exact Jaccard join on word shingles under several global token orders.

``J(x, y) >= t`` implies that, under *any* order of all tokens, the first
``|x| - ceil(t|x|) + c`` tokens of x and of y share at least ``c`` of them, for
each c up to the smaller overlap.  The join applies that filter under one order
after another, each to what the one before it has left:

1. ascending hash order, a short prefix: a text stays only if enough of its
   prefix tokens occur in another text (most leave here);
2. descending hash order, a longer prefix: passages that many documents share
   no longer suffice;
3. document-frequency order over whole sets: a text stays only if it shares
   ``ceil(t|x|)`` tokens with others; its rarest prefix tokens are blocking keys;
4. ascending and descending hash order for each candidate pair.

Equal sets are one class from the start.  No group lists its pairs: all members
of a blocking group are verified against one pivot of the group, then, where
that leaves several components, against further pivots for some rounds.  What
is left is compared exactly: members apart from a group's largest component
with the rest, in blocks, under the same filters, giving one link for each
component met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import arrow_rows, components, dropped, free_name, lean, look_up, small_side, staged

#: Documents on either side of a compared block.
BLOCK_DOCS = 256
#: Further pivots of groups that the first leaves in several components.
ROUNDS = 2
#: Percent of a set by which the prefix in ascending and in descending order is longer than the least one.
SLACK = (5, 30)


def _needed(n: np.ndarray | int, percent: int):
    """ceil(t * n), in integers."""
    return -(-n * percent // 100)


def _reader(width: int, percent: int, slack: int | None, kept: list[tuple[str, pa.DataType]]):
    """mapInArrow: (kept columns, text) to (kept columns, n, sig, toks); toks: the whole set, or with ``slack`` its prefix in hash order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            for row, found in wordhash.shingle_sets(batch.column(len(kept)), width):
                n = len(found)
                sig = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None
                keep = found if slack is None or not n else found[: n - _needed(n, percent) + max(1, n * slack // 100)]
                held.append((row, n, sig, keep))
                total += len(keep)
                if total >= 1 << 18:
                    yield _pack(batch, held)
                    held, total = [], 0
            if held:
                yield _pack(batch, held)

    def _pack(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        flat = np.concatenate([x[3] for x in held]).view(np.int64)
        at = np.zeros(len(held) + 1, np.int32)
        np.cumsum([len(x[3]) for x in held], out=at[1:])
        rows = pa.array([x[0] for x in held])
        own = [batch.column(k).take(rows) for k in range(len(kept))]
        return pa.RecordBatch.from_arrays(
            [*own, pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
            names=[*(k for k, _ in kept), "n", "sig", "toks"],
        )

    return run


def _compare(percent: int):
    """applyInArrow over (group, block a, block b): one link for each outlier and component that it meets.

    A member is a candidate if its size fits and it shares a prefix token in
    ascending and one in descending hash order; only candidates are verified.
    """

    def postings(sets: list[np.ndarray], members: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        cuts = [len(sets[m]) - _needed(len(sets[m]), percent) + 1 for m in members]
        parts = [sets[m][-c:] if last else sets[m][:c] for m, c in zip(members, cuts, strict=True)]
        tok, owner = np.concatenate(parts), np.repeat(members, [len(p) for p in parts])
        by = np.argsort(tok, kind="stable")
        return tok[by], owner[by]

    def met(index: tuple[np.ndarray, np.ndarray], prefix: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(index[0], prefix, "left"), np.searchsorted(index[0], prefix, "right")
        return np.unique(np.concatenate([index[1][a:b] for a, b in zip(lo, hi, strict=True)]))

    def run(t: pa.Table) -> pa.Table:
        side, nodes, comp = (t.column(c).to_numpy() for c in ("side", "node", "comp"))
        sets = [x.values.to_numpy().view(np.uint64) for x in t.column("toks")]
        members, u, v = np.flatnonzero(side == 1), [], []
        if len(members) and (side == 0).any():
            low, high = postings(sets, members, False), postings(sets, members, True)
            for a in np.flatnonzero(side == 0):
                n, seen = len(sets[a]), set()
                cut = n - _needed(n, percent) + 1
                for b in np.intersect1d(met(low, sets[a][:cut]), met(high, sets[a][-cut:]), assume_unique=True):
                    m = len(sets[b])
                    if comp[b] != comp[a] and comp[b] not in seen and 100 * min(n, m) >= percent * max(n, m):
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * both >= percent * (n + m - both):
                            seen.add(comp[b])
                            u.append(int(nodes[a]))
                            v.append(int(nodes[b]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _counted(each: DataFrame, name: str) -> DataFrame:
    """(tok, df) of the tokens of more than one node; written, so that the join with it can split a hot token."""
    return staged(each.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), name)


def _staying(each: DataFrame, sizes: DataFrame, least: str, name: str) -> DataFrame:
    """The nodes of (node, tok) of which ``least`` (of n) tokens occur in another node; ``sizes``: (node, n)."""
    shared = _counted(each, "shared")
    met = each.join(shared.select("tok"), "tok", "left_semi").groupBy("node").agg(F.count("*").alias("k"))
    out = staged(met.join(sizes, "node").where(f"k >= {least}").select("node"), name)
    dropped(shared)
    return out


def _similar(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` (node, pivot) that are similar: size and both hash orders first, then the sets."""

    def prefix(order: str, n: str) -> str:
        return f"slice({order}, 1, CAST({n} - ({n} * {percent} + 99) DIV 100 + 1 AS INT))"

    return (
        pairs.join(full.select("node", F.col("n").alias("na"), F.col("toks").alias("ta")), "node")
        .join(full.select(F.col("node").alias("pivot"), F.col("n").alias("nb"), F.col("toks").alias("tb")), "pivot")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .where(F.expr(f"arrays_overlap({prefix('ta', 'na')}, {prefix('tb', 'nb')})"))
        .where(F.expr(f"arrays_overlap({prefix('reverse(ta)', 'na')}, {prefix('reverse(tb)', 'nb')})"))
        .withColumn("both", F.expr("CAST(size(array_intersect(ta, tb)) AS BIGINT)"))
        .where(f"100 * both >= {percent} * (na + nb - both)")
        .select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    )


def _links(full: DataFrame, percent: int) -> DataFrame:
    """Components of the similar ones among ``full`` (node, n, toks): (node, root), see components()."""
    least = f"((n * {percent} + 99) DIV 100)"
    each = full.select("node", F.explode("toks").alias("tok"))
    shared = _counted(each, "shared")
    ranked = each.join(shared, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("common")).join(full.select("node", "n"), "node")
    free = F.expr(f"CAST(size(common) - {least} + 1 AS INT)")
    keys = staged(ranked.withColumn("free", free).where("free > 0").select("node", F.explode(F.expr("slice(common, 1, free)")).alias("c")).select("node", "c.tok"), "keys")
    dropped(shared)

    pivots = staged(keys.groupBy("tok").agg(F.min_by("node", F.xxhash64("node")).alias("pivot"), F.count("*").alias("k")).where("k > 1").select("tok", "pivot"), "pivots")
    groups = staged(keys.join(pivots, "tok").select("pivot", "node").distinct(), "groups")
    dropped(keys, pivots)

    links = staged(_similar(groups.where("node <> pivot"), full, percent), "links")
    roots = components(links)

    def placed_in(g: DataFrame) -> DataFrame:
        """``g`` with each member's component, without the groups that are within one."""
        placed = staged(g.select("pivot", "node").join(roots, "node", "left").select("pivot", "node", F.coalesce("root", "node").alias("comp")), "placed")
        several = staged(placed.groupBy("pivot").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).where("a <> b AND size > 2").select("pivot"), "several")
        out = staged(placed.join(small_side(several), "pivot", "left_semi"), "open")
        dropped(g, placed, several)
        return out

    groups = placed_in(groups)
    for k in range(ROUNDS):
        if groups.isEmpty():
            break
        chosen = staged(groups.groupBy("pivot").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(k))).alias("c")), "chosen")
        pairs = groups.join(chosen, "pivot").where("comp <> c.comp").select("node", F.col("c.node").alias("pivot")).distinct()
        links = staged(_similar(pairs, full, percent), "links")
        dropped(chosen)
        if not links.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
            groups = placed_in(groups)
    per = groups.groupBy("pivot", "comp").agg(F.count("*").alias("k"))
    per = per.groupBy("pivot").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.sum("k").alias("size"), F.max("k").alias("most"))
    per = staged(per.select("pivot", "top", F.ceil((F.col("size") - F.col("most")) / BLOCK_DOCS).cast("int").alias("na"), F.ceil(F.col("size") / BLOCK_DOCS).cast("int").alias("nb")), "per")
    rest = groups.join(per, "pivot").withColumns({"h": F.xxhash64("node"), "out": F.col("comp") != F.col("top")})
    own_a, own_b = F.pmod("h", F.col("na").cast("long")).cast("int"), F.pmod("h", F.col("nb").cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = rest.where("out").select("pivot", "node", "comp", F.lit(0).alias("side"), own_a.alias("a"), F.explode(every("nb")).alias("b"))
    right = rest.select("pivot", "node", "comp", F.lit(1).alias("side"), F.explode(every("na")).alias("a"), own_b.alias("b"))
    tiles = left.unionByName(right).join(full.select("node", "toks"), "node")
    more = staged(tiles.groupBy("pivot", "a", "b").applyInArrow(_compare(percent), "u long, v long"), "more")
    dropped(groups, per)
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def _classed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """((row, id, j, n, sig) of each row, (sig, k, root, component_id) of each class that has copies or links), both staged.

    A class is all rows of one set, its node the least of their row numbers.
    ``j`` is a hash of id and text.  ``by_id`` links classes that share an id.
    """
    own_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    source = arrow_rows(docs).select(own_id.alias("id"), F.xxhash64(own_id, text).alias("j"), text.alias("text"))
    read = source.mapInArrow(_reader(width, percent, SLACK[0], [("id", pa.int64()), ("j", pa.int64())]), "id long, j long, n long, sig binary, toks array<long>")
    sets = staged(read.withColumn("row", F.monotonically_increasing_id()), "sets")
    rows = staged(sets.select("row", "id", "j", "n", "sig"), "rows")

    classes = staged(rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("k")), "classes")
    copies = staged(rows.where("n > 0").select("row").join(classes.select(F.col("node").alias("row")), "row", "left_anti"), "copies")
    need = lambda slack: f"greatest(1, ((n * {percent} + 99) DIV 100) * {slack} DIV 100)"
    posted = sets.where("n > 0").join(small_side(copies), "row", "left_anti").select(F.col("row").alias("node"), F.explode("toks").alias("tok"))
    stay = _staying(posted, rows.select(F.col("row").alias("node"), "n"), need(SLACK[0]), "stay")
    dropped(sets, copies)

    wanted = staged(rows.join(small_side(stay).withColumnRenamed("node", "row"), "row", "left_semi").select("j", F.col("row").alias("node"), F.col("sig").alias("own")), "wanted")
    reread = source.join(small_side(wanted), "j").select("node", "own", "text")
    full = reread.mapInArrow(_reader(width, percent, None, [("node", pa.int64()), ("own", pa.binary())]), "node long, own binary, n long, sig binary, toks array<long>").where("sig = own").select("node", "n", "toks")
    no_repeats = rows.groupBy("j").count().where("count > 1").isEmpty()
    full = staged(full if no_repeats else full.dropDuplicates(["node"]), "full")
    dropped(stay, wanted)

    longer = F.expr(f"slice(reverse(toks), 1, CAST(n - (n * {percent} + 99) DIV 100 + greatest(1, n * {SLACK[1]} DIV 100) AS INT))")
    stay = _staying(full.select("node", F.explode(longer).alias("tok")), full.select("node", "n"), need(SLACK[1]), "stay")
    held = staged(full.join(small_side(stay), "node", "left_semi"), "held")
    dropped(full, stay)
    roots = _links(held, percent)
    dropped(held)

    if by_id:
        again = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).where("a <> b").select("id")
        if not again.isEmpty():  # ids of several sets: a link from each set to the first
            told = rows.where("n > 0").join(staged(again, "again"), "id", "left_semi").select("id", "sig").distinct()
            told = staged(told.join(classes.select("sig", "node"), "sig").select("id", "node"), "told")
            hub = staged(told.groupBy("id").agg(F.min("node").alias("v")), "hub")
            ties = told.join(hub, "id").select(F.col("node").alias("u"), "v")
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(ties))
    linked = staged(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).where("k > 1 OR root <> node OR least IS NULL").select("sig", "least", "k", "root"), "linked")
    tops = classes.join(linked.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), F.col("least").alias("top"))
    small = staged(linked.select("root", "least").unionByName(tops.select("root", F.col("top").alias("least"))).groupBy("root").agg(F.min("least").alias("component_id")), "small")
    named = linked.join(small, "root").select("sig", "k", "root", "component_id")
    # the roots themselves, where they have no copies and so are not among the linked
    single = classes.where("k = 1 AND least IS NOT NULL").join(small, F.col("node") == F.col("root")).select("sig", "k", "root", "component_id")
    return rows, staged(named.unionByName(single).dropDuplicates(["sig"]), "named")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of ``docs``.

    Sets: distinct ``width``-word shingles of the text with A-Z lower-cased; a
    shorter text is one shingle; a null or word-less text is an empty set and
    links with nothing (its component_id is its own id).  Two sets link at
    ``100 * |both| >= percent * |either|``.  component_id is the smallest id
    reachable by links, itself included.  Rows repeated under one id are one
    node; a row whose id is null has links like any other, but is never the
    smallest: component_id is null where no id is reachable.  Other columns of
    ``docs`` are not read.  An empty table gives no rows.  Shingles are compared
    by 64-bit hashes.
    """
    rows, named = _classed(docs, id_col, text_col, width, percent, True)
    some, none = rows.where("n > 0").select("sig", "id", "n"), rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    found = look_up(some, named.select("sig", "k", "root", "component_id"), "sig", rows.count()).withColumn("component_id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return found.select("id", "n", "component_id").unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component of similar texts; columns unchanged.

    The row of the smallest id stays, one of null id only where all ids are
    null.  Here rows are linked by their texts alone: rows repeated under one id
    with texts that are not similar all stay, equal rows stay once.  Rows with
    an empty set all stay.  An empty table gives no rows.
    """
    rows, named = _classed(docs, id_col, text_col, width, percent, False)
    last = (1 << 63) - 1
    own = look_up(rows.where("n > 0").select("sig", "row", "id", "j"), named.select("sig", "k", "root"), "sig", rows.count()).where("root IS NOT NULL")
    own = staged(own.select("root", "row", "j", F.struct(F.coalesce("id", F.lit(last)).alias("i"), "row").alias("at")), "own")
    first = staged(own.groupBy("root").agg(F.min("at.i").alias("i"), F.min_by("j", "at").alias("j"), F.count("*").alias("k")).where("k > 1").select("root", F.col("j").alias("first")), "first")
    # all rows of another id or text than the first of their component go
    gone = staged(own.join(first, "root").where("j <> first").select("j").distinct(), "gone")
    again = staged(own.join(first, "root").where("j = first").groupBy("j").count().where("count > 1").select("j"), "again")
    mark = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    name = free_name(docs, "mark")
    kept = docs.join(small_side(gone.withColumnRenamed("j", name)), mark == F.col(name), "left_anti")
    if not again.isEmpty():
        repeated = small_side(again.withColumnRenamed("j", name))
        once = kept.join(repeated, mark == F.col(name), "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(repeated, mark == F.col(name), "left_anti").unionByName(once)
    dropped(own, first)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
