"""Text outputs for other tools (SNK3, SNK4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import real_call


def plink_map(markers: DataFrame) -> DataFrame:
    """.map lines in genome order; the genetic place is 0, not a guess."""
    return markers.orderBy("chrom_no", "position", "rsid").select(F.concat_ws("\t", F.col("chrom_no").cast("string"), "rsid", F.lit("0"), F.col("position").cast("string")).alias("value"))


def plink_ped(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """.ped lines: a wide row for each sample over all markers, ``0 0`` for a no-call.

    The format is one line for each sample.  It is put together from a text for each chromosome, in which only called markers
    meet, by their place among the chromosome's markers; the gaps between them are filled with no-calls.
    """
    order = Window.partitionBy("chrom_no").orderBy("position", "rsid")
    placed = markers.select("rsid", "chrom_no", "position").distinct().withColumn("k", F.row_number().over(order))
    sizes = placed.groupBy("chrom_no").agg(F.count(F.lit(1)).cast("int").alias("size"))
    called = calls.where(real_call("allele1", "allele2", "ibd")).select("sample_id", "rsid", F.concat_ws(" ", F.lit(""), F.upper("allele1"), F.upper("allele2")).alias("cell")).join(placed, "rsid")
    found = called.groupBy("sample_id", "chrom_no").agg(F.array_sort(F.collect_list(F.struct("k", "cell"))).alias("g"))
    parts = calls.select("sample_id").distinct().crossJoin(sizes).join(found, ["sample_id", "chrom_no"], "left")  # a row for each chromosome
    blank = lambda n: F.expr("repeat(' 0 0', {})".format(n))
    cells = F.expr("array_join(transform(g, (x, i) -> concat(repeat(' 0 0', x.k - 1 - if(i = 0, 0, g[i - 1].k)), x.cell)), '')")
    text = F.when(F.col("g").isNull(), blank("size")).otherwise(F.concat(cells, blank("size - element_at(g, -1).k")))
    wide = parts.select("sample_id", "chrom_no", text.alias("text")).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("chrom_no", "text"))).alias("g"))
    one = F.col("sample_id").cast("string")
    head = F.concat_ws(" ", one, one, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("-9"))
    return wide.orderBy("sample_id").select(F.concat(head, F.array_join(F.transform("g", lambda x: x["text"]), "")).alias("value"))


def plink_bim(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """.bim lines with each marker's two alleles in order; ``0`` stands for one that was not seen."""
    seen = calls.where(real_call("allele1", "allele2", "ibd")).select("rsid", F.explode(F.array(F.upper("allele1"), F.upper("allele2"))).alias("a")).groupBy("rsid").agg(F.array_sort(F.collect_set("a")).alias("s"))
    pick = lambda i: F.coalesce(F.get("s", F.lit(i)), F.lit("0"))
    return markers.join(seen, "rsid", "left").orderBy("chrom_no", "position", "rsid").select(F.concat_ws("\t", F.col("chrom_no").cast("string"), "rsid", F.lit("0"), F.col("position").cast("string"), pick(0), pick(1)).alias("value"))


def positions_bed(markers: DataFrame) -> DataFrame:
    """0-based intervals of single positions, in order."""
    return markers.select("chrom_no", "position", "rsid").repartitionByRange("chrom_no", "position").sortWithinPartitions("chrom_no", "position").select(F.concat_ws("\t", F.col("chrom_no").cast("string"), (F.col("position") - 1).cast("string"), F.col("position").cast("string"), "rsid").alias("value"))


def study_vcf(calls: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Variant lines of one sample's calls in order, with ``ref_known``.

    Without a reference base the first allele by alphabet stands for REF, and the row says so.
    """
    rows = calls.where(real_call("allele1", "allele2"))
    rows = rows.join(reference.select("rsid", F.upper("ref").alias("_ref")), "rsid", "left") if reference is not None else rows.withColumn("_ref", F.lit(None).cast("string"))
    a, b = F.upper("allele1"), F.upper("allele2")
    ref = F.coalesce("_ref", F.least(a, b))
    alts = F.array_sort(F.array_distinct(F.filter(F.array(a, b), lambda x: x != ref)))
    gt = lambda x: (F.when(x == ref, 0).otherwise(F.array_position(alts, x))).cast("string")
    alt = F.when(F.size(alts) == 0, ".").otherwise(F.array_join(alts, ","))
    out = rows.select("chrom_no", "position", F.col("_ref").isNotNull().alias("ref_known"), F.concat_ws("\t", F.col("chrom_no").cast("string"), F.col("position").cast("string"), "rsid", ref, alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.concat_ws("/", gt(a), gt(b))).alias("value"))
    return out.repartitionByRange("chrom_no", "position").sortWithinPartitions("chrom_no", "position")


def hsd(calls: DataFrame, reference: DataFrame, span: str = "1-16569") -> DataFrame:
    """A line for each sample: its differences from the reference base, as position and base."""
    rows = calls.where(real_call("allele1", "allele2")).join(reference.select("position", F.upper("ref").alias("ref")), "position").where(F.upper("allele1") != F.col("ref"))
    out = rows.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct("position", F.upper("allele1").alias("b")))).alias("d"))
    text = F.array_join(F.transform("d", lambda x: F.concat(x["position"].cast("string"), x["b"])), "\t")
    return out.select(F.concat_ws("\t", F.col("sample_id").cast("string"), F.lit(span), F.lit("?"), text).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
