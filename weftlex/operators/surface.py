"""Surface memory: token projection, address tables, collisions, longest-match resolution, hash fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import hashing as H
from ..functions import text as T
from ..sources import ordered
from ..sources.scratch import scratch_folder
from ..sources.store import located

#: Word orders that hold phrase memory; order one holds dictionary senses.
PHRASE_ORDERS = (3, 2)


def canonical_key(decoded: Column, piece: Column, normal: Column) -> Column:
    """What identifies a token: the piece if its bytes do not decode, else its normal form, else the decoded text."""
    return F.when(F.contains(decoded, F.lit("�")), piece).otherwise(F.coalesce(F.nullif(normal, F.lit("")), decoded))


def token_projection(vocabulary: DataFrame) -> DataFrame:
    """(raw_token_id, canonical_token_id, canonical_key) from ``vocabulary(token_id, piece, decoded)``.

    Ids of keys are dense in the order of their first token.
    """
    keyed = vocabulary.select(F.col("token_id").cast("long").alias("raw_token_id"), canonical_key(F.col("decoded"), F.col("piece"), T.canonical_token_text(F.col("decoded"))).alias("canonical_key"))
    # a vocabulary is bounded by its tokenizer, so one window may number its keys
    firsts = keyed.groupBy("canonical_key").agg(F.min("raw_token_id").alias("first"))
    ids = firsts.withColumn("canonical_token_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")) - 1).cast("long")).drop("first")
    return keyed.join(ids, "canonical_key").select("raw_token_id", "canonical_token_id", "canonical_key")


def projection_report(projection: DataFrame) -> DataFrame:
    """One row: sizes before and after and the share saved."""
    out = projection.agg(F.count("*").alias("raw_vocab_size"), F.count_distinct("canonical_token_id").alias("effective_vocab_size"))
    return out.withColumn("reduction_fraction", 1 - F.col("effective_vocab_size") / F.col("raw_vocab_size"))


def project(ids: Column, table: Column) -> Column:
    """Ids through a broadcast array of canonical ids; negative ids pass, one past the end raises."""
    return F.transform(ids, lambda x: F.when(x < 0, x.cast("long")).otherwise(F.coalesce(F.get(table, x.cast("int")), F.raise_error(F.concat(F.lit("token id out of range: "), x.cast("string"))).cast("long"))))


def normal_words(df: DataFrame, words: str, name: str = "words") -> DataFrame:
    """Replaces an array of words by their address forms, each distinct word folded once.

    Rows are told apart by a key made of their own content, which the two
    shuffles keep small.
    """
    known = df.select(F.explode(words).alias("w")).distinct().withColumn("f", T.canonical_token_text(F.col("w")))
    keyed = df.withColumn("_row", F.xxhash64(F.col(words)))
    folded = df.select(words).distinct().select(F.xxhash64(F.col(words)).alias("_row"), F.posexplode(words).alias("i", "w")).join(known, "w")
    folded = folded.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "f"))), lambda x: x["f"]).alias(name))
    return keyed.join(folded, "_row", "left").drop("_row")


def address_table(records: DataFrame) -> DataFrame:
    """One word address for each record with its folded words; records whose word count is not their order raise.

    ``records(memory_kind, bank_name, word_order, row_index, surface_text, frequency, sense_id)``.
    """
    df = records.withColumn("split", F.split(F.btrim("surface_text"), r"\s+"))
    df = normal_words(df, "split")
    ok = (F.size("words") == F.col("word_order")) & ~F.exists("words", lambda w: w == "")
    words = F.when(ok, F.col("words")).otherwise(F.raise_error(F.concat(F.lit("words do not match the order: "), F.col("surface_text"))).cast("array<string>"))
    return df.withColumn("words", words).drop("split")


def boundary_variants(records: DataFrame, encode) -> DataFrame:
    """Token addresses: each surface encoded at the start of a text and after a space.

    ``encode`` maps a text column to its array of token ids.
    """
    both = F.explode(F.array(F.struct(F.lit("bos").alias("boundary_mode"), F.col("surface_text").alias("t")), F.struct(F.lit("internal").alias("boundary_mode"), F.concat(F.lit(" "), F.col("surface_text")).alias("t"))))
    df = records.withColumn("_v", both).select("*", "_v.boundary_mode", encode(F.col("_v.t")).alias("token_ids")).drop("_v")
    return df.withColumn("token_length", F.size("token_ids"))


def collisions(addresses: DataFrame, key: list[str]) -> DataFrame:
    """Addresses that several surfaces or orders share, with their candidates by (order, frequency, row).

    Counted first by partial sums; only the rows of colliding keys are listed.
    """
    counts = addresses.groupBy(*key).agg(F.count("*").alias("candidate_count"), F.count_distinct("surface_text").alias("surface_count"), F.count_distinct("word_order").alias("order_count"))
    hit = counts.where("surface_count > 1 OR order_count > 1").select(*key, "candidate_count", "surface_count")
    entry = F.struct((-F.col("word_order")).alias("o"), (-F.col("frequency")).alias("q"), "row_index", "memory_kind", "bank_name", "surface_text", "sense_id")
    listed = addresses.join(hit.select(*key), key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("c"))
    show = F.transform("c", lambda c: F.struct(c["memory_kind"].alias("memory_kind"), c["bank_name"].alias("bank_name"), (-c["o"]).alias("word_order"), c["row_index"].alias("row_index"), c["surface_text"].alias("surface_text"), (-c["q"]).alias("frequency"), c["sense_id"].alias("sense_id")))
    return hit.join(listed.select(*key, show.alias("candidates")), key)


def bucket_collisions(addresses: DataFrame, digest: Column, exact: str) -> DataFrame:
    """One row: how many digest buckets hold more than one exact key."""
    buckets = addresses.select(digest.alias("d"), exact).groupBy("d").agg(F.count_distinct(exact).alias("k"))
    return buckets.agg(F.count_if(F.col("k") > 1).alias("colliding_buckets"), F.count("*").alias("buckets"))


def spans(records: DataFrame) -> DataFrame:
    """Per bank: source rows and the longest token span."""
    return records.groupBy("bank_name").agg(F.count("*").alias("source_rows"), F.max("token_length").alias("maximum_token_span"))


def winners(addresses: DataFrame) -> DataFrame:
    """(words, order, row_index, surface_text, frequency): the winning phrase of each address: most frequent, then lowest row."""
    best = F.min_by(F.struct("row_index", "surface_text", "frequency"), F.struct((-F.col("frequency")).alias("q"), "row_index"))
    return addresses.where("word_order > 1").groupBy("word_order", "words").agg(best.alias("b")).select("word_order", "words", "b.row_index", "b.surface_text", "b.frequency")


def positions(docs: DataFrame, id_col: str, segments: Column) -> DataFrame:
    """(id, segment, p, word, w2, w3): each word with the two- and three-word runs that end there, inside its segment.

    Runs come from the segment's own array, so nothing is shuffled.
    """
    df = docs.select(id_col, F.posexplode(segments).alias("segment", "ws"))
    runs = F.transform("ws", lambda w, i: F.struct(i.alias("p"), w.alias("word"), F.when(i >= 1, F.slice("ws", i, F.lit(2))).alias("w2"), F.when(i >= 2, F.slice("ws", i - 1, F.lit(3))).alias("w3")))
    return df.select(id_col, "segment", F.explode(runs).alias("r")).select(id_col, "segment", "r.*")


def resolve(found: DataFrame, addresses: DataFrame, id_col: str) -> DataFrame:
    """(id, segment, p, word, word_order, row_index, surface_text): the longest phrase that ends at each word.

    Order three wins over two over one; a dictionary hit has no row of its own
    here (see all_senses).  No hit: word_order null.  Joins are by the words
    themselves, so equal hashes of different words cannot match.
    """
    best = winners(addresses)
    by3 = best.where("word_order = 3").select(F.col("words").alias("w3"), F.struct("row_index", "surface_text").alias("m3"))
    by2 = best.where("word_order = 2").select(F.col("words").alias("w2"), F.struct("row_index", "surface_text").alias("m2"))
    by1 = addresses.where("word_order = 1").select(F.get("words", F.lit(0)).alias("word")).distinct().withColumn("m1", F.lit(True))
    # a position without a run gets a key of its own that no phrase can have, so that nulls do not meet in one task
    alone = F.array(F.concat(F.lit("\0"), F.hex(F.xxhash64(id_col, "segment", "p"))))
    keyed = found.withColumns({c: F.coalesce(c, alone) for c in ("w2", "w3")})
    out = keyed.join(by3, "w3", "left").join(by2, "w2", "left").join(by1, "word", "left")
    order = F.when(F.col("m3").isNotNull(), 3).when(F.col("m2").isNotNull(), 2).when(F.col("m1"), 1)
    hit = F.coalesce("m3", "m2")
    return out.select(id_col, "segment", "p", "word", order.alias("word_order"), hit["row_index"].alias("row_index"), hit["surface_text"].alias("surface_text"))


def all_senses(resolved: DataFrame, addresses: DataFrame, id_col: str) -> DataFrame:
    """Every sense of each word whose longest match is the word itself."""
    senses = addresses.where("word_order = 1").select(F.get("words", F.lit(0)).alias("word"), F.col("row_index").alias("sense_row"), "sense_id", "frequency")
    return resolved.where("word_order = 1").select(id_col, "segment", "p", "word").join(senses, "word")


def decomposition(found: DataFrame, addresses: DataFrame, id_col: str) -> DataFrame:
    """Candidates of shorter orders under each position's longest match: (id, segment, p, word_order, row_index)."""
    keyed = addresses.select("word_order", "words", "row_index")
    every = found.select(id_col, "segment", "p", F.explode(F.array(F.struct(F.lit(3).alias("word_order"), F.col("w3").alias("words")), F.struct(F.lit(2).alias("word_order"), F.col("w2").alias("words")), F.struct(F.lit(1).alias("word_order"), F.array("word").alias("words")))).alias("k"))
    hits = every.where("k.words IS NOT NULL").select(id_col, "segment", "p", "k.*").join(keyed, ["word_order", "words"])
    top = hits.groupBy(id_col, "segment", "p").agg(F.max("word_order").alias("top"))
    return hits.join(top, [id_col, "segment", "p"]).where("word_order < top").select(id_col, "segment", "p", "word_order", "row_index")


#: Keys of one automaton: some tens of megabytes in a task.
AUTOMATON_KEYS = 100_000
#: Hits of one output batch.
HIT_ROWS = 50_000
#: Stands for a null id: no key holds it.
NO_ID = 2**32 - 1
#: Addresses that are broadcast to the hits; with more, both sides are dealt over ``HIT_SALTS`` tasks a key.
BROADCAST_ADDRESSES, HIT_SALTS = 200_000, 16


def stored_keys(keys: DataFrame, path: str, block_keys: int = AUTOMATON_KEYS) -> int:
    """Store distinct ``token_ids`` with dense ``row_no`` in blocks of ``block_keys``; returns the number of blocks.

    Empty keys and keys that hold a null match nothing and are left out; an id outside 0 to 2**32 - 2 raises.
    """
    t = F.col("token_ids")
    fits = F.when(F.forall(t, lambda x: (x >= 0) & (x < NO_ID)), t).otherwise(F.raise_error(F.lit("token ids are 0 to 2**32 - 2")).cast("array<bigint>"))
    whole = keys.where((F.size("token_ids") > 0) & ~F.exists("token_ids", lambda x: x.isNull())).select(fits.alias("token_ids")).distinct()
    return -(-ordered.write_blocks(whole, ["token_ids"], path, block_keys) // block_keys)


def key_hits(tokens: DataFrame, id_col: str, path: str, blocks: int) -> DataFrame:
    """(id, end, start, row_no): every place where a stored key occurs in ``tokens(id, ids)``.

    An automaton of one block of keys runs once over each text, so work is
    linear in the text and in what it holds.  With several blocks a text is
    given to each of them in its own task; nothing is shuffled.
    """
    import pyarrow as pa

    def automaton(block: int):
        import ahocorasick
        from pyarrow import parquet

        system, at = located(f"{path}/blocks/block={block}")
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        read = parquet.ParquetDataset(at, filesystem=system, partitioning=None).read(["row_no", "token_ids"])
        for batch in read.to_batches(10_000):
            for number, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                machine.add_word(tuple(key), (number, len(key)))
        machine.make_automaton()
        return machine

    def match(batches):
        held, machine = None, None
        for batch in batches:
            own, ids, block = (batch.column(c) for c in range(3))
            at, end, start, number = [], [], [], []

            def found():
                return pa.RecordBatch.from_arrays([own.take(pa.array(at, pa.int32())), pa.array(end, pa.int32()), pa.array(start, pa.int32()), pa.array(number, pa.int64())], names=[id_col, "end", "start", "row_no"])

            for k in range(batch.num_rows):
                if block[k].as_py() != held:
                    held = block[k].as_py()
                    machine = automaton(held)
                for e, (key, size) in machine.iter(tuple(NO_ID if x is None else x for x in ids[k].as_py())):
                    at.append(k), end.append(e), start.append(e - size + 1), number.append(key)
                    if len(at) == HIT_ROWS:
                        yield found()
                        at, end, start, number = [], [], [], []
            if at:
                yield found()

    texts = tokens.where(F.size("ids") > 0).select(id_col, F.col("ids").cast("array<bigint>").alias("ids"))
    texts = texts.withColumn("_block", F.lit(0)) if blocks == 1 else texts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).sortWithinPartitions("_block")
    schema = StructType([tokens.schema[id_col], *StructType.fromDDL("end int, start int, row_no bigint")])
    return texts.mapInArrow(match, schema)


def resolve_suffixes(tokens: DataFrame, addresses: DataFrame, id_col: str, max_span: int | None = None, block_keys: int = AUTOMATON_KEYS) -> DataFrame:
    """Token-level form: the longest of all addresses whose ids end at a position.

    With ``max_span``, addresses of more ids are left out.

    ``tokens(id, ids)``; a suffix that starts the text matches 'bos' addresses,
    any other 'internal' ones.  The longest word order wins, whatever its token
    length; within it the most frequent, then the lowest row; order one keeps
    all its senses.  Returns (id, end, start, word_order, row_index, sense_id).
    Null or empty ids have no rows; a null inside them matches no address.
    """
    spark = tokens.sparkSession
    path = scratch_folder(spark, "keys")
    use = addresses if max_span is None else addresses.where(F.size("token_ids") <= max_span)
    use = use.select("boundary_mode", F.col("token_ids").cast("array<bigint>").alias("token_ids"), "word_order", "row_index", "frequency", "surface_text", "sense_id")
    use.write.parquet(f"{path}/addresses")
    use = spark.read.schema(use.schema).parquet(f"{path}/addresses")
    blocks = stored_keys(use, f"{path}/numbered", block_keys)
    named = use.limit(0).withColumn("row_no", F.lit(0).cast("long"))
    found = tokens.limit(0).select(id_col, F.lit(0).alias("end"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("row_no"))
    if blocks:
        named = use.join(spark.read.parquet(f"{path}/numbered/blocks").select("token_ids", "row_no"), "token_ids")
        found = key_hits(tokens, id_col, f"{path}/numbered", blocks)
    found = found.withColumn("boundary_mode", F.when(F.col("start") == 0, "bos").otherwise("internal"))
    named, keys = named.drop("token_ids"), ["boundary_mode", "row_no"]
    if use.count() <= BROADCAST_ADDRESSES:
        hits = found.join(F.broadcast(named), keys)
    else:
        found = found.withColumn("_salt", F.pmod(F.xxhash64(id_col, "end"), F.lit(HIT_SALTS)).cast("int"))
        hits = found.join(named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HIT_SALTS - 1)))), [*keys, "_salt"])
    order = Window.partitionBy(id_col, "end").orderBy(F.desc("word_order"), F.desc("frequency"), "row_index", "surface_text")
    top = F.first("word_order").over(order)
    ranked = hits.withColumn("top", top).withColumn("r", F.row_number().over(order))
    return ranked.where("word_order = top AND (word_order = 1 OR r = 1)").select(id_col, "end", "start", "word_order", "row_index", "sense_id")


def memory_plan(tokens: DataFrame, word_ends: DataFrame, resolved: DataFrame, id_col: str, heads: int = H.HASH_HEADS) -> DataFrame:
    """(id, end, memories, best_order, best_row, hash2, hash3) for each token position.

    ``tokens(id, ids)`` canonical ids; ``word_ends(id, ordinal, token_end)``;
    ``resolved(id, ordinal, word_order, row_index)``.  Words that end in one
    token are all attached, the best is that of the highest order, then the
    last.  Hash addresses are given where no phrase of order two or three ends.
    """
    attached = resolved.where("word_order IS NOT NULL").join(word_ends, [id_col, "ordinal"])
    per = attached.groupBy(id_col, F.col("token_end").alias("end")).agg(F.count("*").alias("memories"), F.max_by(F.struct("word_order", "row_index"), F.struct("word_order", "ordinal")).alias("best"))
    ends = tokens.where(F.size("ids") > 0).select(id_col, F.posexplode(F.transform("ids", lambda x, i: F.struct(F.when(i >= 1, F.slice("ids", i, F.lit(2))).alias("s2"), F.when(i >= 2, F.slice("ids", i - 1, F.lit(3))).alias("s3")))).alias("end", "s"))
    out = ends.join(per, [id_col, "end"], "left")
    miss = F.coalesce(F.col("best.word_order"), F.lit(0)) < 2
    return out.select(
        id_col,
        "end",
        F.coalesce("memories", F.lit(0)).alias("memories"),
        F.col("best.word_order").alias("best_order"),
        F.col("best.row_index").alias("best_row"),
        *(F.when(miss, H.hash_addresses(F.col(f"s.s{n}"), n, heads)).alias(f"hash{n}") for n in H.HASH_ORDERS),
    )
