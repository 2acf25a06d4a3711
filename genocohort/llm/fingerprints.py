"""Document fingerprints by a threshold-scaled sketch of word shingles (operator 6, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE_CHARS, SPACE_CLASS, bound, stage

#: Words in a shingle, and the part of all 64-bit hashes that a sketch keeps: one in SCALE.
SHINGLE, SCALE = 5, 4
#: About how many rows a part of the order of doc_id has; beyond a million parts they grow with the table.
PART_ROWS, PARTS = 2_000, 1_000_000


def threshold(scale: int) -> int:
    """The signed 64-bit value that one hash in ``scale`` lies under."""
    return -(2**63) + 2**64 // scale


def word_hashes(text: Column) -> Column:
    """The 64-bit hash of each word of the lower-cased text; null and blank texts have none."""
    body = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE_CHARS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{SPACE_CLASS}+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(hashes: Column, size: int = SHINGLE, scale: int = SCALE) -> Column:
    """Every distinct shingle hash under the fixed threshold, and the least one of all, sorted.

    The least hash keeps short documents from having an empty sketch.  Sketches merge:
    the sketch of a union is what lies under the threshold in either, with the lesser
    least hash.  With fewer than ``size`` words the whole sequence is one shingle.
    """
    below = threshold(scale)

    def shingles(h: Column) -> Column:
        made = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < size, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))
        return made.otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)])))

    def least(s: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.array_append(F.filter(s, lambda h: h < below), F.array_min(s)), lambda h: h.isNotNull())))

    return bound(bound(hashes, shingles), least)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Part of the smaller sketch that the other one holds.

    A hash above the threshold is compared with nothing that may have left its like out, so only those below
    it count.  Two sketches without any are alike (1) if they are equal; one beside a sketch that has some gives 0,
    which a text of n shingles meets with a chance of (1 - 1/scale)^n.
    """
    low = lambda s: F.filter(s, lambda h: h < threshold(scale))

    def compared(both: Column) -> Column:
        x, y = both["x"], both["y"]
        least = F.least(F.size(x), F.size(y))
        return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).when((F.size(x) == F.size(y)) & (a == b), 1.0).otherwise(0.0).cast("double")

    return bound(F.struct(low(a).alias("x"), low(b).alias("y")), compared)


def resemblance(a: Column, b: Column) -> Column:
    """Shared part of two sketches' union; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(1.0).cast("double")


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, sketch`` of every whole text; null text counts as empty."""
    rows = texts_of(docs)
    return rows.withColumn("sketch", sketch(word_hashes(F.col("text"))))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def place(bounds: Column, x: Column) -> Column:
    """How many values of a sorted array, at most 1,023, are ``x`` or less: a binary search."""
    return F.aggregate(F.array(*[F.lit(2**k) for k in range(9, -1, -1)]), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= x, at + step).otherwise(at))


def with_parts(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``part``: the row's range of doc_id, of about ``part_rows`` rows; null ids make the first one.

    Quantiles cut the table into some hundred stretches and quantiles of each cut these into parts, so
    that neither list of bounds has more than a thousand values.
    """
    n = rows.count()
    parts = max(1, min(PARTS, n // part_rows))
    wide = min(1000, int(parts**0.5) + 1)
    fine = min(1000, parts // wide + 1)
    at = F.percentile_approx("doc_id", [i / wide for i in range(1, wide)] or [0.5], 20_000)
    bounds = sorted(set(rows.select(at.alias("q")).first()["q"] or []))
    stretch = place(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), F.col("doc_id"))
    rows = rows.withColumn("stretch", F.when(F.col("doc_id").isNull(), -1).otherwise(stretch))
    inner = rows.groupBy("stretch").agg(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)] or [0.5], 20_000).alias("bounds"))
    # a row for each of at most 1,001 stretches, with at most 999 bounds
    inner = stage(inner.withColumn("bounds", F.array_sort(F.array_distinct("bounds"))), "bounds")
    out = rows.join(F.broadcast(inner), "stretch")
    part = F.col("stretch").cast("long") * 1024 + F.when(F.col("bounds").isNotNull(), place(F.col("bounds"), F.col("doc_id"))).otherwise(0)
    return out.withColumn("part", part).drop("stretch", "bounds")


def with_next(rows: DataFrame, carry: list[str], add=lambda df: df, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows(doc_id, text)`` with what ``add`` makes of them and ``next_<c>`` for each column of ``carry``: its
    value in the next row by (doc_id, text), after the last row the first's.

    A copy of each part's first row closes the part before it, so no task sees more than a part, and ``add`` works
    on each row once.  A null doc_id comes first; of repeated rows, each one is followed by its repeat.
    """
    rows = with_parts(rows, part_rows)
    first = rows.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    whole = W.orderBy("part")  # two numbers for each part
    last = F.max("part").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = stage(first.select("part", "first_id", F.coalesce(F.lag("part").over(whole), last).alias("before")), "first")
    copies = rows.join(F.broadcast(first.withColumnRenamed("part", "own")), (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    copies = copies.groupBy("before", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("before").alias("part"))
    closed = add(rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1))))
    w = W.partitionBy("part").orderBy("copy", "doc_id", "text")
    closed = closed.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return closed.where("copy = 0").drop("part", "copy")


def fingerprint_report(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half is the next text's start.

    One row per row of ``docs(doc_id, text)``: ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next`` (containment estimates of
    the smaller sketch) and ``resembles_edited``.  Null text counts as empty; equal texts
    have equal fingerprints; an only row is its own next; extra columns are not read; an empty table gives no rows.
    """
    sketched = lambda df: df.withColumn("sketch", sketch(word_hashes(F.col("text"))))
    spread = with_next(texts_of(docs), ["text", "sketch"], sketched, part_rows)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    made = spread.withColumn("n_chars", F.length("text").cast("long"))
    made = made.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    made = made.withColumn("edited_sketch", sketch(word_hashes(F.col("edited"))))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("resembles_edited"),
    )
