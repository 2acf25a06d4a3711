"""Shards by a hierarchical weighted hash tree (operator 12, native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: The first so many shards fill regions of RACKS racks with SHARDS_A_RACK shards each; every later one opens a region of its own.
FIRST_SHARDS, RACKS, SHARDS_A_RACK = 24, 2, 4
#: Rows that a task numbers at once, and equal rows that one row stands for until the end.
ROWS_A_PART, COPIES_A_ROW = 50_000, 1_000


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight; a rack and a region weigh what is below them."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def shard_tree(shards: int) -> list[Leaf]:
    """A tree of so many shards of weight 1.

    The tree of one more shard is the same tree with one more subtree, so that no weight in the old ones changes.
    """
    size = RACKS * SHARDS_A_RACK
    first = [Leaf(i // size, i // SHARDS_A_RACK % RACKS, i) for i in range(min(shards, FIRST_SHARDS))]
    return first + [Leaf(FIRST_SHARDS // size + i - FIRST_SHARDS, 0, i) for i in range(FIRST_SHARDS, shards)]


def tree_column(leaves: list[Leaf]) -> Column:
    """The tree as a constant: regions of racks of shards, each with its path and weight."""
    leaves = [x for x in leaves if x.weight > 0]
    if len({x.shard for x in leaves}) != len(leaves) or not leaves:
        raise ValueError("a tree needs shards of positive weight, each named once")

    def node(path: str, below: list[Leaf], **kids: Column) -> Column:
        return F.struct(F.lit(path).alias("path"), F.lit(float(sum(x.weight for x in below))).alias("weight"), *[c.alias(k) for k, c in kids.items()])

    regions = []
    for region in sorted({x.region for x in leaves}):
        here = [x for x in leaves if x.region == region]
        racks = []
        for rack in sorted({x.rack for x in here}):
            own = [x for x in here if x.rack == rack]
            racks.append(node(f"{region}/{rack}", own, shards=F.array(*[node(f"{region}/{rack}/{x.shard}", [x], shard=F.lit(x.shard)) for x in own])))
        regions.append(node(str(region), here, racks=F.array(*racks)))
    return F.array(*regions)


def draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential waiting time of rate ``weight``, told by 52 bits of the md5 of key and path.

    Of several nodes each is the first with a chance in proportion to its weight, and a node's own draw
    depends on no other node.
    """
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, path).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def first_of(nodes: Column, key: Column) -> Column:
    return F.array_min(F.transform(nodes, lambda x: F.struct(draw(key, x["path"], x["weight"]).alias("wait"), x.alias("node"))))["node"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: the region with the least draw, in it the rack, in it the shard.

    When weights change, a key moves only into a subtree that grew or out of one that shrank: elsewhere all draws are
    as before.  A null key is a key of its own.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    return first_of(first_of(first_of(tree_column(leaves), text)["racks"], text)["shards"], text)["shard"].cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32``: UTF-8 bytes plus 8, and the unsigned checksum; a null text has no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def place(docs: DataFrame, leaves: list[Leaf], then: list[Leaf] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for every row of ``docs(doc_id, text)``.

    The id alone decides the shard.  ``slot`` numbers the rows of a shard from 0 without a gap, in the order of a hash
    of the columns before it.  ``grown_shard`` is the shard under the tree ``then`` (null without one).

    Texts are read once and never shuffled: rows are counted by id, size and checksum, so that a row repeated
    without end is one row until the end.  The hash order is cut into parts of some ROWS_A_PART rows at any size of the
    table; a part is numbered by a task, from the number of rows in the parts before it.

    A null text counts as empty; a null doc_id is a key like any other; repeated rows get a slot each; an
    empty table gives none; extra columns are not read.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size")
    rows = sized(docs).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    grown = shard_of(F.col("doc_id"), then) if then else F.lit(None).cast("int")
    rows = stage(rows.select("*", shard_of(F.col("doc_id"), leaves).alias("shard"), grown.alias("grown_shard"), F.md5(key.cast("binary")).alias("mark")), "placed")
    total, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    shards = sum(x.weight > 0 for x in leaves)
    bits = max(0, (int(total) // (shards * ROWS_A_PART)).bit_length())
    part = F.shiftrightunsigned(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), 32 - bits)
    rows = rows.withColumn("part", part)
    # a row for each part of each shard
    held = rows.groupBy("shard", "part").agg(F.sum("n").alias("held"))
    starts = held.select("shard", "part", (F.sum("held").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("mark", F.asc_nulls_first("doc_id"), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("n").over(order) - F.col("n")).join(starts, ["shard", "part"])
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("before")).alias("slot"), "n")
    if most > 1:
        # a row for each COPIES_A_ROW of equal rows, dealt out where one has more, and then each copy
        block = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_A_ROW))))
        cold = block.where(F.col("n") <= COPIES_A_ROW)
        block = cold.unionByName(block.where(F.col("n") > COPIES_A_ROW).repartition("doc_id", "size", "text_crc32", "block")) if most > COPIES_A_ROW else cold
        first = F.col("block") * COPIES_A_ROW
        rows = block.withColumn("at", F.explode(F.sequence(first, F.least(first + COPIES_A_ROW, F.col("n")) - 1))).withColumn("slot", F.col("slot") + F.col("at"))
    return rows.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def moves(docs: DataFrame, old: list[Leaf], new: list[Leaf]) -> DataFrame:
    """``from_shard, to_shard, rows, bytes`` of the rows that change their shard when the tree changes."""
    rows = sized(docs).select(shard_of(F.col("doc_id"), old).alias("from_shard"), shard_of(F.col("doc_id"), new).alias("to_shard"), "size")
    return rows.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def write_shards(docs: DataFrame, path: str, leaves: list[Leaf], files: int | None = None) -> str:
    """Write all rows and columns of ``docs`` as Parquet, a folder for each shard; returns the name of the folders' column.

    With ``files``, rows are dealt to so many files a shard; else each task writes what it read, without a shuffle.  The column
    is ``shard``, or ``shard_`` and so on where ``docs`` has that name in any case.
    """
    name, taken = "shard", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    rows = docs.withColumn(name, shard_of(docs["doc_id"], leaves))
    if files:
        salt = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(files))
        rows = rows.repartition(files * len(leaves), F.col(name), salt)
    rows.write.partitionBy(name).parquet(path)
    return name


__all__ = ["Leaf", "moves", "place", "shard_of", "shard_tree", "write_shards"]
