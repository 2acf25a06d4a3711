"""Helpers that several operators share: staging, components, word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six separators of a word, as a Java class and as a trim set.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

#: A frame may be broadcast only when it was counted and has at most this many rows of a few longs.
BROADCAST_ROWS = 1_000_000

_staged: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where it is unset, a session in one process gets a
    new local folder; any other is an error, as its executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends
    there, and a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _staged.append((fs, where))
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    files = df.inputFiles()
    if not files:
        return
    for fs, where in _staged:
        if f"/{where.getName()}/" in files[0]:
            fs.delete(where, True)
            _staged.remove((fs, where))
            return


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for fs, where in _staged:
        try:
            fs.delete(where, True)
        except Exception:  # the JVM may be gone
            return


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within BROADCAST_ROWS, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], most: int | None = None, least: int = 2048) -> DataFrame:
    """``rows`` joined on ``keys`` with ``facts``, which holds each key once and in ``n`` how many of the rows have it.

    Facts of at most ``most`` (BROADCAST_ROWS) rows are broadcast.  Beyond, the rows of a key with more than a
    50,000th of all of them are dealt by ``by`` over as many tasks as they fill, each with a copy of the key's facts: there
    are fewer than 50,000 such keys, so that their list is broadcast.  Read ``facts`` from a staged table.
    """
    n_facts, total = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_facts <= (BROADCAST_ROWS if most is None else most):
        return rows.join(F.broadcast(facts.drop("n")), keys)
    share = max(least, int(total) // 50_000)
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = facts.where(F.col("n") > share).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts) - 1))).drop("n")
    return dealt.join(copies, [*keys, "_part"]).drop("_part")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, start: Column, step, kind: str, block: int = 64) -> Column:
    """The state after each item of an array, from ``start`` by ``step(state, item)``; ``kind`` is the state's type.

    Appending to an array copies it, so states are gathered in blocks.
    """

    def one(acc: Column, x: Column) -> Column:
        return bound(step(acc["state"], x), lambda s: F.struct(s.alias("state"), F.array_append(acc["out"], s).alias("out")))

    def blocks(found: Column) -> Column:
        def some(acc: Column, b: Column) -> Column:
            part = F.aggregate(F.slice(found, b * block + 1, F.lit(block)), F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)
            return bound(part, lambda m: F.struct(m["state"].alias("state"), F.array_append(acc["out"], m["out"]).alias("out")))

        at = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(at, F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), some)["out"])

    return bound(items, blocks)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and for each the smallest node reachable by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a
    grouped minimum joined back to the edges, until no edge changes.  Self-loops and
    null ends are ignored; nodes without an edge do not appear; no edges give no rows.
    """
    now = stage(
        edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(now)
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large = stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        then = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        drop_stage(now)
        drop_stage(large)
        now, is_ = then, mark(then)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
