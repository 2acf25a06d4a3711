"""Mixing sources to target weights by a hypergeometric splitting tree (operator 5, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE_CLASS, WORD_CLASS, bound, bounded_broadcast, n_words, stage

#: Output shards (a power of two), about how many blocks the mix is cut into at most, the fewest words of a block, the most
#: often a source is repeated, and the seed of every draw.
SHARDS, BLOCKS, BLOCK_WORDS, MAX_REPEATS, SEED = 16, 4_096, 16_384, 3, "mix-1"


def draw(*parts) -> Column:
    """A reproducible pseudo-random 128-bit text for the given values."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *[p.cast("string") for p in parts]))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words of each row of ``sizes(source, source_size)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words;
    a target stops at ``repeats`` times its source and the excess is shared anew by weight.
    That fixed point is level * weight cut off at the cap, and the level follows from prefix sums
    by cap / weight.  One row for each source: this windows over the list of sources.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = F.row_number().over(by_name)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (n - 1) % len(weights) + 1).cast("long")
    ranked = sizes.withColumn("weight", w).withColumn("cap", repeats * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    below = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
    ranked = ranked.withColumn("share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
    level = F.col("left") / F.col("share")
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    ranked = ranked.withColumn("level", F.max(fits).over(every))
    return ranked.select("source", "source_size", "weight", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def split_tree(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source, shard, quota``: how many of each source's blocks, ``quotas(source, quota)``, each shard gets.

    From the root down, each node draws without replacement half of the blocks that it holds; how many of
    each source it drew, a multivariate hypergeometric count, is the quota of its left child, and the rest that
    of the right one.  Only the counts go down the tree.  The number of blocks is bounded whatever the corpus.
    """
    held = quotas.select("source", F.lit(0).alias("node"), "quota")
    for level in range(shards.bit_length() - 1):
        urn = held.where("quota > 0").select("source", "node", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("ball"))
        key = draw(F.lit(f"split{level}"), F.col("node"), F.coalesce("source", F.lit("\x00")), F.col("ball"))
        drawn = F.row_number().over(W.partitionBy("node").orderBy(key, "source", "ball")) <= F.ceil(F.count(F.lit(1)).over(W.partitionBy("node")) / 2)
        held = urn.withColumn("node", F.col("node") * 2 + F.when(drawn, 0).otherwise(1)).groupBy("source", "node").agg(F.count(F.lit(1)).alias("quota"))
    return held.select("source", F.col("node").alias("shard"), "quota")


def deal_blocks(quotas: DataFrame, tree: DataFrame) -> DataFrame:
    """``source, shards``: for each block of a source, in its order, the shard that gets it.

    Each source's blocks are permuted, and each shard takes its quota of them, one shard after the other.
    """
    blocks = quotas.where("quota > 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("block"))
    key = draw(F.lit("block"), F.coalesce("source", F.lit("\x00")), F.col("block"))
    blocks = blocks.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(key, "block")))
    slots = tree.withColumn("to", F.sum("quota").over(W.partitionBy("source").orderBy("shard")))
    slots = slots.select(F.col("source").alias("s_source"), "shard", F.explode(F.sequence(F.col("to") - F.col("quota") + 1, "to")).alias("k"))
    dealt = blocks.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (blocks["k"] == slots["k"]))
    # the blocks of all sources are bounded, so are these lists
    lists = dealt.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("block", "shard"))).alias("of"))
    return lists.select("source", F.transform("of", lambda x: x["shard"]).alias("shards"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row`` with ``doc_id, source, size`` and ``key``, a random text told by doc_id, source and text."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    key = draw(F.lit("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(source, F.lit("\x00")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), n_words(text).alias("size"), key.alias("key"))


def plan_mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, block_words: int = BLOCK_WORDS, part_rows: int = 20_000) -> DataFrame:
    """The mix of ``docs(doc_id, text, source)``: one row per row of ``docs``.

    Each source's rows get a random order, their words one running axis, and the mix takes
    the axis from 0 to the target, round again for up to three passes.  The axis is cut into blocks of an equal
    number of words, ``block_words`` or as many more as keep their number to about ``blocks``, and ``split_tree`` and ``deal_blocks`` give every block to a shard; a row that
    stands across block edges is cut there, and the row at the target gives only the words before it.

    Returns ``doc_id, source, key, size, source_size, target, taken, begin`` and ``pieces``, an array of
    (pass, block, shard, from, to) in words of the row; ``taken`` adds them up.  Null text has size 0 and is taken 0
    times; a null source is a source of its own, last; rows that repeat a doc_id are rows
    of their own, told apart by text; extra columns are not read; an empty table gives no rows.
    Running sums are made within parts of about ``part_rows`` rows of a source and then
    over the parts, so a source with a third of all rows is spread like the others.
    """
    rows = stage(keyed(docs).drop("row"), "sizes")
    digits = next(d for d in range(1, 9) if d == 8 or rows.count() <= part_rows * 16**d)
    rows = rows.withColumn("part", F.substring("key", 1, digits))
    parts = stage(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    targets = stage(source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))), "targets")
    before = F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    total = F.greatest(F.lit(1), F.sum(F.round("target").cast("long")).over(W.partitionBy()))
    quotas = targets.withColumn("block_words", F.greatest(F.lit(block_words).cast("long"), F.ceil(total / blocks).cast("long"))).withColumn("quota", F.ceil(F.round("target") / F.col("block_words")).cast("long"))
    quotas = stage(quotas, "quotas")
    tree = stage(split_tree(quotas.select("source", "quota"), shards), "tree")
    dealt = stage(deal_blocks(quotas, tree), "dealt").withColumnRenamed("source", "d_source")
    quotas = quotas.join(F.broadcast(dealt), F.col("source").eqNullSafe(F.col("d_source")), "left").drop("d_source")
    parts = parts.withColumn("before", before).alias("p").join(quotas.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    sources = stage(quotas.select(F.col("source").alias("s_source"), "source_size", "target", "block_words", "shards"), "sources")
    parts = stage(parts.select(F.col("p.source").alias("p_source"), "part", "before"), "starts")

    within = W.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
    rows = rows.join(bounded_broadcast(parts, parts.count()).alias("q"), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("r.part") == F.col("q.part")))
    rows = rows.join(bounded_broadcast(sources, sources.count()), F.col("source").eqNullSafe(F.col("s_source")))
    rows = rows.select("doc_id", "source", "key", "size", "source_size", "target", "block_words", "shards", (F.col("before") + F.col("inside")).alias("begin"))

    def of_pass(r: int) -> Column:
        at = r * F.col("source_size") + F.col("begin")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.round("target").cast("long") - at))

        def piece(b: Column) -> Column:
            begin = b * F.col("block_words") - at
            return F.struct(F.lit(r).alias("pass"), b.alias("block"), F.get("shards", b.cast("int")).alias("shard"), F.greatest(F.lit(0).cast("long"), begin).alias("from"), F.least(words, begin + F.col("block_words")).alias("to"))

        met = F.sequence(F.floor(at / F.col("block_words")), F.floor((at + words - 1) / F.col("block_words")))
        return F.transform(F.when(words > 0, met).otherwise(F.array().cast("array<bigint>")), piece)

    rows = rows.withColumn("pieces", F.concat(*map(of_pass, range(MAX_REPEATS))))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"])
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", taken.alias("taken"), "begin", "pieces")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, block_words: int = BLOCK_WORDS, place: str | None = None) -> DataFrame:
    """The mix itself: a row of ``docs`` for each piece that the mix takes of it, with ``docs``' columns.

    A row within a block is whole; one that stands across block edges gives a row for each block, whose texts on
    end are its own up to the white space at its end.  Rows are written shard by shard, in a random order within a
    shard.  Rows that the mix does not take are absent; rows that repeat a doc_id and text are taken one by one,
    in the order of their other columns; extra columns go along.  ``place`` names a column, put last, that tells a piece's
    shard, pass and block and its words ``from`` and ``to`` in the row, by which cut rows can be put together again.
    """
    plan = plan_mix(docs, shards, blocks, block_words).where("taken > 0")
    # equal rows have one key: the n-th of them, by its other columns, is the n-th on the axis
    plan = plan.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "size", "pieces"))).alias("takes"))
    kinds = dict(docs.dtypes)
    others = F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns if "map<" not in kinds[c]])
    rows = keyed(docs).select("row", "key").withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(others)))
    # both sides are dealt by the key alone, so texts are shuffled once for it
    out = rows.join(plan, "key").withColumn("take", F.get("takes", F.col("nth") - 1)).where("take is not null").select("row", "key", "nth", "take.size", "take.pieces")
    whole = lambda p, size: p["to"] - p["from"] == size
    # the words are only told apart in rows that are cut
    cut = F.when(F.exists("pieces", lambda p: ~whole(p, F.col("size"))), F.regexp_extract_all("row.text", F.lit(SPACE_CLASS + "*" + WORD_CLASS), F.lit(0)))

    def texts(words: Column) -> Column:
        part = lambda p: F.when(whole(p, F.col("size")), F.col("row.text")).otherwise(F.array_join(F.slice(words, p["from"].cast("int") + 1, (p["to"] - p["from"]).cast("int")), ""))
        return F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), draw(F.lit("order"), F.col("key"), F.col("nth"), p["pass"], p["block"]).alias("order"), p.alias("place"), part(p).alias("text")))

    out = out.select("row", F.explode(bound(cut, texts)).alias("piece"))
    fields = {"text": F.col("piece.text"), "n_chars": F.length("piece.text")}
    # a range of (shard, random key) is a slice of a shard, however large the shard is
    out = out.repartitionByRange("piece.shard", "piece.order").sortWithinPartitions("piece.shard", "piece.order")
    placed = [F.col("piece.place").alias(place)] if place else []
    return out.select(*[fields[c].cast(kinds[c]).alias(c) if c in fields else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *placed)
