"""Allele counts and what they say about populations (AG17-AG22, FL4, WN6, TK3, JN26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.population import hardy_weinberg, x_log_x
from .family import place_on_map

SITE = ("chrom", "pos", "ref", "alt")


def marker_filter(records: DataFrame, coverage: DataFrame | None = None, min_maf: float | None = None) -> DataFrame:
    """Biallelic substitutions; with ``coverage(rsid)`` only named ones in it, with ``min_maf`` only common ones."""
    base = lambda c: F.upper(F.trim(c)).isin("A", "C", "G", "T")
    out = records.where(base("ref") & base("alt"))
    if coverage is not None:
        out = out.join(coverage.select("rsid").distinct(), "rsid", "left_semi")
    return out.where(F.least(F.col("af"), 1 - F.col("af")) >= min_maf) if min_maf is not None else out


def marker_unique(records: DataFrame, order: str) -> DataFrame:
    """The first record of each site."""
    w = W.partitionBy(*SITE).orderBy(order)
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def allele_counts(genotypes: DataFrame, labels: DataFrame) -> DataFrame:
    """(alt copies, called copies) of each marker and population from ``genotypes(sample_id, marker, gt)``.

    A haploid call counts once, a missing one nothing, and a third allele is left out of both.
    """
    tokens = F.split(F.replace(F.element_at(F.split("gt", ":"), 1), F.lit("|"), F.lit("/")), "/")
    one = lambda t: F.size(F.filter(tokens, lambda x: x == t))
    rows = genotypes.join(labels.select("sample_id", "pop"), "sample_id").select("marker", "pop", one("1").alias("alt"), one("0").alias("ref"))
    return rows.groupBy("marker", "pop").agg(F.sum("alt").alias("alt"), F.sum(F.col("alt") + F.col("ref")).alias("n")).where("n > 0")


def derive_genotype_table(allele_freq: DataFrame) -> DataFrame:
    """Hardy-Weinberg percents of the genotypes of the two commonest alleles of each rsid and population."""
    w = W.partitionBy("rsid", "pop").orderBy(F.desc("freq"), "allele")
    top = allele_freq.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    two = top.groupBy("rsid", "pop").agg(*[F.max(F.when(F.col("_n") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("allele", "freq")])
    row = lambda a, b, same: F.struct(F.concat(a, b).alias("genotype"), hardy_weinberg(f"freq{a[-1]}", f"freq{b[-1]}", F.lit(same)).alias("percent"))
    made = F.filter(F.array(row("allele1", "allele1", True), row("allele1", "allele2", False), row("allele2", "allele2", True)), lambda r: r["genotype"].isNotNull())
    return two.select("rsid", "pop", F.explode(made).alias("g")).select("rsid", "pop", "g.genotype", "g.percent")


def gmaf(allele_freq: DataFrame) -> DataFrame:
    """Global minor allele and its frequency over pooled rows ``(rsid, allele, freq)``; null for a lone allele."""
    out = allele_freq.groupBy("rsid").agg(F.min(F.struct("freq", "allele")).alias("m"), F.count(F.lit(1)).alias("n"))
    return out.select("rsid", F.when(F.col("n") >= 2, F.col("m.allele")).otherwise("").alias("minor_allele"), F.when(F.col("n") >= 2, F.round("m.freq", 6)).alias("gmaf"))


def _fst(total_alt: Column, total: Column, within: Column, populations: Column) -> Column:
    p = total_alt / total
    whole = 2.0 * p * (1.0 - p)
    return F.when((populations >= 2) & (whole > 0), F.greatest(F.lit(0.0), (whole - within / total) / whole)).otherwise(0.0)


def fst(counts: DataFrame) -> DataFrame:
    """Copy-weighted Fst of each marker; 0 where nothing varies or fewer than two populations were read."""
    p = F.col("alt") / F.col("n")
    sums = counts.where("n > 0").groupBy("marker").agg(F.sum("alt").alias("alt"), F.sum("n").alias("total"), F.sum(F.col("n") * 2.0 * p * (1.0 - p)).alias("within"), F.count(F.lit(1)).alias("k"))
    return sums.select("marker", _fst(F.col("alt"), F.col("total"), F.col("within"), F.col("k")).alias("fst"))


def informativeness(counts: DataFrame) -> DataFrame:
    """Rosenberg's informativeness of each marker in nats, populations unweighted."""
    p = F.col("alt") / F.col("n")
    sums = counts.where("n > 0").groupBy("marker").agg(F.avg(p).alias("p"), F.avg(x_log_x(p) + x_log_x(1.0 - p)).alias("each"), F.count(F.lit(1)).alias("k"))
    value = F.col("each") - x_log_x(F.col("p")) - x_log_x(1.0 - F.col("p"))
    return sums.select("marker", F.when((F.col("k") >= 2) & (value > 0), value).otherwise(0.0).alias("informativeness"))


def one_vs_rest(counts: DataFrame, statistic: str = "fst") -> DataFrame:
    """Each population of a marker against all others pooled."""
    w = W.partitionBy("marker")
    rows = counts.withColumns({"rest_alt": F.sum("alt").over(w) - F.col("alt"), "rest_n": F.sum("n").over(w) - F.col("n")})
    p, q = F.col("alt") / F.col("n"), F.col("rest_alt") / F.col("rest_n")
    usable = (F.col("n") > 0) & (F.col("rest_n") > 0)
    if statistic == "fst":
        total = F.col("n") + F.col("rest_n")
        value = _fst(F.col("alt") + F.col("rest_alt"), total, F.col("n") * 2.0 * p * (1.0 - p) + F.col("rest_n") * 2.0 * q * (1.0 - q), F.lit(2))
    else:
        m = (p + q) / 2.0
        value = F.greatest(F.lit(0.0), (x_log_x(p) + x_log_x(1.0 - p) + x_log_x(q) + x_log_x(1.0 - q)) / 2.0 - x_log_x(m) - x_log_x(1.0 - m))
    return rows.select("marker", "pop", F.when(usable, value).otherwise(0.0).alias("score"))


def top_markers(stats: DataFrame, markers: DataFrame, n: int) -> DataFrame:
    """The ``n`` best markers of each population with a score above 0; the earlier place wins a tie."""
    rows = stats.where("score > 0").join(markers.select("marker", "chrom", "pos"), "marker")
    w = W.partitionBy("pop").orderBy(F.desc("score"), "chrom", "pos", "marker")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merge_panels(panel: DataFrame, extra: DataFrame) -> DataFrame:
    """Add another set's samples to a panel ``(marker, sample_id, gt)``: the panel's markers only, missing ones ``./.``."""
    markers = panel.select("marker").distinct()
    grid = markers.crossJoin(extra.select("sample_id").distinct())  # samples of one added set
    filled = grid.join(extra, ["marker", "sample_id"], "left").select("marker", "sample_id", F.coalesce("gt", F.lit("./.")).alias("gt"))
    return panel.select("marker", "sample_id", "gt").unionByName(filled)


def build_panel(records: DataFrame, genotypes: DataFrame, labels: DataFrame, coverage: DataFrame | None = None, statistic: str = "fst", n: int = 100, genetic_map: DataFrame | None = None) -> DataFrame:
    """Most informative markers of each population: filter, first record of a site, counts, statistic, top n.

    With ``genetic_map(chrom_no, bp, cm)`` each marker has its place ``cm``, interpolated and held to the map's ends; 0 on a
    chromosome without a map.
    """
    kept = marker_filter(records, coverage)
    counts = allele_counts(genotypes.join(kept.select("marker").distinct(), "marker", "left_semi"), labels)
    panel = top_markers(one_vs_rest(counts, statistic), kept, n)
    if genetic_map is None:
        return panel
    placed = place_on_map(panel.select("marker", F.col("chrom").alias("chrom_no"), "pos").distinct(), genetic_map, "pos", "cm")
    return panel.join(placed.select("marker", F.coalesce("cm", F.lit(0.0)).alias("cm")), "marker")
