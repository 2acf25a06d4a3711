"""Line dedup by a deletion-neighbourhood join (operator 2, native).

A line goes if it equals an earlier line or lies within one edit (a character put in,
left out or changed) of one.  Earlier means a smaller (doc_id, place in the document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, stage

#: About how many characters a block has, in which the one edit may fall.
BLOCK_CHARS = 32


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line``: the lines of each text that have a visible character."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    return rows.where(F.length(F.trim("line")) > 0)


def repeats(lines: Column) -> Column:
    """Places of visible lines that repeat one of their own document."""
    order = F.array_sort(F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("pos"))))
    # an array of one binds the sorted lines to a name, so that they are sorted once
    again = F.transform(F.array(order), lambda o: F.filter(o, lambda x, i: (F.length(F.trim(x["line"])) > 0) & (i > 0) & (x["line"] == o[F.greatest(i - 1, F.lit(0))]["line"])))[0]
    return F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.transform(again, lambda x: x["pos"])).otherwise(F.array().cast("array<int>"))


def block_edge(b: Column, length: Column) -> Column:
    return F.floor(b * length / F.greatest(F.lit(2), F.ceil(length / BLOCK_CHARS))).cast("int")


def half_keys(line: Column) -> Column:
    """For the line as the longer and as the shorter of a pair, the hash of either half of the longer length's grid."""
    size = F.length(line)

    def halves(n: Column) -> list[Column]:
        e = F.shiftright(n, 1)
        return [F.xxhash64(n, F.lit(0), F.substring(line, F.lit(1), e)), F.xxhash64(n, F.lit(1), F.substring(line, size - n + e + 1, n - e))]

    return F.array(*halves(size), *halves(size + 1))


def with_blocks(lines: DataFrame) -> DataFrame:
    """A row for each (longer length n, block b) of each line, with the hash of all but the block.

    Two lines within one edit have the same longer length and agree outside the block of that
    length's grid in which the edit falls, so they share a row's hash.
    """
    size = F.length("line")
    out = lines.withColumn("n", F.explode(F.array(size, size + 1)))
    out = out.withColumn("b", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(2), F.ceil(F.col("n") / BLOCK_CHARS)).cast("int") - 1)))
    out = out.withColumn("left", block_edge(F.col("b"), F.col("n"))).withColumn("right", F.col("n") - block_edge(F.col("b") + 1, F.col("n")))
    start = F.substring(F.col("line"), F.lit(1), F.col("left"))
    end = F.substring(F.col("line"), size - F.col("right") + 1, F.col("right"))
    return out.withColumn("key", F.xxhash64("n", "b", start, end))


def of_several(rows: DataFrame) -> DataFrame:
    """Keys of ``rows(key, h)`` that more than one ``h`` has, and in ``n`` how many rows have each."""
    return rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n")


def near_lines(docs: DataFrame) -> DataFrame:
    """Places ``doc_id, pos`` of lines within one edit of an earlier, different line.

    1. Halves that two different lines of fitting length share are found by a grouped minimum and
       maximum of line hashes: no list of a group is ever gathered.  Of the lines with such a half,
       blocks whose surroundings two of them share are found in the same way.
    2. Only lines in such blocks emit their deletion neighbourhood: all variants with one
       character of the block left out, as hashed keys.  With the place kept, equal variants
       are one change apart; without it, a longer line meets the shorter one.
    3. Each key's earliest line is its witness; the edit distance of the pair is verified.
    """
    lines = lines_of(docs)
    halves = lines.select(F.xxhash64("line").alias("h"), F.explode(half_keys(F.col("line"))).alias("key"))
    shared = stage(of_several(halves), "halves")
    near = meet(lines.withColumn("key", F.explode(half_keys(F.col("line")))), shared, ["key"], ["doc_id", "pos"])
    near = stage(near.groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("at")), "near")
    blocks = with_blocks(near)
    shared = stage(of_several(blocks.select("key", F.xxhash64("line").alias("h"))), "blocks")
    cut = stage(meet(blocks, shared, ["key"], ["at"]).where("n - right > left"), "cut")

    size = F.length("line")
    whole = F.explode(F.sequence(F.col("left") + 1, F.col("n") - F.col("right")))
    longer = cut.where(size == F.col("n")).withColumn("i", whole)
    head = F.substring(F.col("line"), F.lit(1), F.col("i") - 1)
    tail = F.substring(F.col("line"), F.col("i") + 1, size)
    changed = longer.select("at", F.xxhash64(F.lit("change"), "n", "i", head, tail).alias("key"), F.lit(2).alias("side"))
    less = longer.select("at", F.xxhash64(F.lit("less"), "n", F.concat(head, tail)).alias("key"), F.lit(1).alias("side"))
    itself = cut.where(size == F.col("n") - 1).select("at", F.xxhash64(F.lit("less"), "n", "line").alias("key"), F.lit(0).alias("side"))
    # a line is known by the place where it first stands: variants carry no text
    variants = changed.unionByName(less).unionByName(itself)
    # the witness of a change is the earliest line of the key, of a line left short the earliest of the other side
    found = variants.groupBy("key", "side").agg(F.min("at").alias("w"))
    found = found.select("key", F.when(F.col("side") == 2, 2).otherwise(1 - F.col("side")).alias("side"), "w")
    pairs = variants.join(found, ["key", "side"]).where("w < at").select("at", "w").distinct()
    texts = cut.select("at", "line").distinct()
    pairs = pairs.join(texts, "at").join(texts.select(F.col("at").alias("w"), F.col("line").alias("w_line")), "w")
    return pairs.where(F.levenshtein("line", "w_line", 1).between(0, 1)).select("at.doc_id", "at.pos").distinct()


def exact_lines(docs: DataFrame) -> DataFrame:
    """Lines ``doc_id, h1`` (a hash) that equal a line of a document with a smaller id."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.split(F.col("text").cast("string"), "\n", -1))).alias("line")).where(F.length(F.trim("line")) > 0)
    lines = lines.select("doc_id", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    # a null doc_id counts as the smallest
    whose = F.coalesce("doc_id", F.lit(-(2**63)))
    low = lines.groupBy("h1", "h2").agg(F.min(whose).alias("low"), F.max(whose).alias("high"), F.count(F.lit(1)).alias("n"))
    low = stage(low.where("low <> high").select("h1", "h2", "low", "n"), "repeated")
    return meet(lines, low, ["h1", "h2"], ["doc_id"]).where("doc_id > low").select("doc_id", "h1")


def dedup_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs``' rows with ``kept_text`` (the lines left, joined by newlines), ``n_lines``, ``n_exact``,
    ``n_near`` (lines taken out) and ``n_kept``.

    Blank lines stay.  Null text stays null with 0 lines; empty text is one blank line.  A null
    doc_id sorts first.  Rows that repeat a doc_id are one document: a line taken out at a
    place is taken out in each of them, and equal lines at the same place of both stay.
    Other columns pass through, but those named like a result are replaced; with ``whole``, all of the input's columns come as
    the struct ``row`` instead, and none is lost.  An empty table gives no rows.
    """
    exact = exact_lines(docs).groupBy("doc_id").agg(F.collect_set("h1").alias("exact"))
    near = near_lines(docs).groupBy("doc_id").agg(F.collect_set("pos").alias("near"))
    gone = exact.join(near, "doc_id", "full_outer").select(F.struct("doc_id", "exact", "near").alias("gone"))
    none = F.array().cast("array<int>")
    made = ("kept_text", "n_lines", "n_exact", "n_near", "n_kept")
    # the input's columns stay in a struct, so that none of them can clash with one made here
    rest = [F.col(f"`{c}`") for c in docs.columns if whole or c not in made]
    out = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("id"), F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
    out = out.join(gone, F.col("id").eqNullSafe(F.col("gone.doc_id")), "left").select("row", "lines", F.col("gone.exact").alias("exact"), F.col("gone.near").alias("near"))
    equal = F.filter(F.transform("lines", lambda line, i: F.when(F.array_contains("exact", F.xxhash64(line)), i)), lambda i: i.isNotNull())
    equal = F.when(F.col("exact").isNull(), none).otherwise(equal)
    out = out.withColumn("equal", F.array_distinct(F.concat(equal, repeats(F.col("lines")))))
    out = out.withColumn("near", F.array_except(F.coalesce("near", none), F.col("equal")))
    out = out.withColumn("taken", F.concat("equal", "near"))
    kept = F.when(F.size("taken") == 0, F.col("lines")).otherwise(F.filter("lines", lambda line, i: ~F.array_contains("taken", i)))
    out = out.withColumn("kept", kept)
    counts = [F.greatest(F.lit(0), F.size(c)).cast("long").alias(name) for c, name in (("lines", "n_lines"), ("equal", "n_exact"), ("near", "n_near"), ("kept", "n_kept"))]
    return out.select("row" if whole else "row.*", F.array_join("kept", "\n").alias("kept_text"), *counts)
