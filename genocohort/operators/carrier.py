"""Carrier panels with an explicit third state, and joint risks (AG33, AG34, JN25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import copies, real_call
from ..functions.population import as_fraction

UNCERTAINTY = 2.0


def carrier_status(pooled: DataFrame, panel: DataFrame) -> DataFrame:
    """Per sample and gene of ``panel(gene, rsid, allele, array_testable)``: carrier, not_carrier_for_tested_variants, untestable."""
    # only read variants meet the panel; what was not read follows from the gene's number of testable ones
    calls = pooled.where(real_call("allele1", "allele2", "star")).select("sample_id", "rsid", "allele1", "allele2")
    read = calls.join(panel.where("array_testable").select("gene", "rsid", "allele"), "rsid").withColumn("n", copies("allele1", "allele2", "allele"))
    read = read.groupBy("sample_id", "gene").agg(F.count("n").alias("tested"), F.count_if(F.col("n") > 0).alias("detected"), F.sum("n").alias("copies"))
    genes = panel.groupBy("gene").agg(F.count_if("array_testable").alias("testable"), F.count_if(~F.col("array_testable")).alias("not_array_testable"))
    rows = pooled.select("sample_id").distinct().crossJoin(genes).join(read, ["sample_id", "gene"], "left")  # the result's own rows
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.select("sample_id", "gene", none("tested"), none("detected"), (F.col("testable") - F.coalesce("tested", F.lit(0))).alias("not_read"), "not_array_testable", "copies")
    return out.withColumn("status", F.when(F.col("detected") > 0, "carrier").when(F.col("tested") > 0, "not_carrier_for_tested_variants").otherwise("untestable"))


def gene_screen_coverage(pooled: DataFrame, probes: DataFrame) -> DataFrame:
    """Positions read of each gene of ``probes(gene, rsid, known)``; genes with none are there with 0."""
    genes = probes.groupBy("gene").agg(F.max("known").alias("known"))
    read = pooled.where(real_call("allele1", "allele2")).select("sample_id", "rsid").distinct().join(probes.select("gene", "rsid"), "rsid").groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("read"))
    out = pooled.select("sample_id").distinct().crossJoin(genes).join(read, ["sample_id", "gene"], "left")
    n = F.coalesce("read", F.lit(0))
    return out.select("sample_id", "gene", n.alias("read"), F.when(F.col("known") > 0, F.round(n / F.col("known"), 6)).alias("fraction"))


def couple_risk(couples: DataFrame, risks: DataFrame) -> DataFrame:
    """Chance of an affected child of each couple and gene, as a range unless every input is verified.

    ``risks(sample_id, gene, inheritance, risk, verified)``; recessive needs both risks, X-linked only the mother's (``a``).
    """
    side = lambda s: risks.select(F.col("sample_id").alias(s), "gene", "inheritance", F.col("risk").alias(f"risk_{s}"), F.col("verified").alias(f"verified_{s}"))
    rows = couples.join(side("a"), "a").join(side("b").drop("inheritance"), ["b", "gene"], "left")
    linked = F.lower("inheritance").contains("x-linked")
    recessive = F.lower("inheritance").contains("recessive")
    point = F.when(linked, F.col("risk_a") * 0.25).when(recessive, F.col("risk_a") * F.col("risk_b") * 0.25)
    sure = F.coalesce("verified_a", F.lit(False)) & (linked | F.coalesce("verified_b", F.lit(False)))
    reason = F.when(~linked & ~recessive, "inheritance not covered").when(F.col("risk_a").isNull(), "first risk unknown").when(~linked & F.col("risk_b").isNull(), "second risk unknown").otherwise("")
    rows = rows.withColumn("point", point)
    return rows.select("a", "b", "gene", "inheritance", "point", F.when(sure, F.col("point")).otherwise(F.col("point") / UNCERTAINTY).alias("low"), F.when(sure, F.col("point")).otherwise(F.least(F.lit(0.25), F.col("point") * UNCERTAINTY)).alias("high"), reason.alias("reason"))


def unverified_figures(variants: DataFrame, totals: DataFrame, frequencies: DataFrame, rates: DataFrame) -> DataFrame:
    """``gene, kind, item, note`` of every figure of a carrier panel that was not verified at its source."""
    open_ = lambda df: df.where(~F.coalesce("verified", F.lit(False)))
    row = lambda df, kind, item, note: open_(df).select("gene", F.lit(kind).alias("kind"), item.alias("item"), note.alias("note"))
    value = F.col("value").cast("string")
    found = row(variants, "variant", F.concat("name", F.lit(" ("), "rsid", F.lit(")")), F.coalesce("note", F.lit("")))
    found = found.unionByName(row(totals, "total_known_pathogenic", value, F.col("basis")))
    found = found.unionByName(row(frequencies, "carrier_frequency", F.concat("pop", F.lit(" = "), as_fraction(F.col("value"))), F.col("basis")))
    return found.unionByName(row(rates, "detection_rate", F.concat("pop", F.lit(" = "), value), F.col("basis")))
