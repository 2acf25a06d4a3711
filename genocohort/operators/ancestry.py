"""Ancestry segments, proportions and panels (WN4, AG30, AG31, AG37, AG41)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.population import wilson_interval
from .provenance import digest_tree

MIN_MARKERS, MIN_FRACTION = 50, 0.20


def ancestry_segments(calls: DataFrame) -> DataFrame:
    """Consecutive markers with one ancestry on a haplotype, merged: gaps and islands."""
    w = W.partitionBy("sample_id", "haplotype", "chrom_no").orderBy("position")
    again = W.partitionBy("sample_id", "haplotype", "chrom_no", "ancestry").orderBy("position")
    rows = calls.withColumn("_run", F.row_number().over(w) - F.row_number().over(again))
    return rows.groupBy("sample_id", "haplotype", "chrom_no", "ancestry", "_run").agg(F.min("position").alias("start_bp"), F.max("position").alias("end_bp"), F.count(F.lit(1)).alias("markers")).drop("_run")


def marker_coverage(typed: DataFrame, informative: DataFrame, least: int = MIN_MARKERS, share: float = MIN_FRACTION) -> DataFrame:
    """Per sample and population: informative markers read, and whether that is enough to say anything."""
    total = informative.groupBy("pop").agg(F.countDistinct("rsid").alias("total"))
    read = typed.select("sample_id", "rsid").distinct().join(informative.select("pop", "rsid").distinct(), "rsid").groupBy("sample_id", "pop").agg(F.count(F.lit(1)).alias("read"))
    out = typed.select("sample_id").distinct().crossJoin(total).join(read, ["sample_id", "pop"], "left")  # a row for each population
    n = F.coalesce("read", F.lit(0))
    part = n / F.col("total")
    reason = F.when(n < least, "too few markers").when(part < share, "too small a part").otherwise("")
    return out.select("sample_id", "pop", n.alias("read"), "total", F.round(part, 6).alias("fraction"), ((n >= least) & (part >= share)).alias("resolvable"), reason.alias("reason"))


def replicate_interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """Bounds of each (sample, population) from its replicates: the values at the floor and ceil rank of the tails."""
    w = W.partitionBy("sample_id", "pop").orderBy("proportion")
    rows = replicates.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("sample_id", "pop"))})
    tail = (1 - level) / 2
    low, high = F.floor(tail * (F.col("n") - 1)), F.ceil((1 - tail) * (F.col("n") - 1))
    return rows.groupBy("sample_id", "pop").agg(F.max(F.when(F.col("i") == low, F.col("proportion"))).alias("low"), F.max(F.when(F.col("i") == high, F.col("proportion"))).alias("high"))


def report_proportions(q: DataFrame, coverage: DataFrame, replicates: DataFrame | None = None) -> DataFrame:
    """Proportions with intervals; a population that can't be resolved has none, its raw value is kept and its mass withheld."""
    rows = q.join(coverage.select("sample_id", "pop", "read", "resolvable"), ["sample_id", "pop"], "left")
    ok = F.coalesce("resolvable", F.lit(False))
    wilson = wilson_interval("proportion", F.coalesce("read", F.lit(0)))
    if replicates is not None:
        rows = rows.join(replicate_interval(replicates).select("sample_id", "pop", F.col("low").alias("_l"), F.col("high").alias("_h")), ["sample_id", "pop"], "left")
    else:
        rows = rows.withColumns({"_l": F.lit(None).cast("double"), "_h": F.lit(None).cast("double")})
    return rows.select(
        "sample_id", "pop", F.when(ok, F.col("proportion")).alias("proportion"), F.col("proportion").alias("raw"), F.when(ok, F.coalesce("_l", wilson["low"])).alias("low"), F.when(ok, F.coalesce("_h", wilson["high"])).alias("high"), F.when(ok, F.when(F.col("_l").isNotNull(), "replicates").otherwise("wilson")).alias("method"),
        F.when(ok, 0.0).otherwise(F.col("proportion")).alias("withheld"),
    )


def painting_totals(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Span and part of each ancestry of a sample, and of what chromosomes of known length hold."""
    rows = segments.join(lengths, "chrom_no", "left").withColumn("span", F.col("end_bp") - F.col("start_bp"))
    out = rows.groupBy("sample_id", "ancestry").agg(F.sum("span").alias("span"), F.sum(F.when(F.col("length") > 0, F.col("span") / F.col("length"))).alias("chromosomes"))
    return out.withColumn("fraction", F.round(F.col("span") / F.sum("span").over(W.partitionBy("sample_id")), 6))


def panel_inventory(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Populations, samples, and the number and one digest of ``files(digest)``, as ``listed_files`` gives them."""
    digest = digest_tree(files).select("digest", F.col("n").alias("files"))
    return labels.agg(F.countDistinct("pop").alias("populations"), F.countDistinct("sample_id").alias("samples")).crossJoin(digest)
