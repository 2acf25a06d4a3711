"""Vendor genotype exports (SRC1, SRC18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines

# Text in a file's comments or header that names its provider.
PROVIDERS = (("23andme", "23andme"), ("ancestrydna", "ancestrydna"), ("myheritage", "myheritage"), ("family tree dna", "ftdna"), ("familytreedna", "ftdna"), ("living dna", "livingdna"), ("livingdna", "livingdna"))
# Names of the columns.
NAMES = {"rsid": ("rsid", "snp", "name", "marker"), "chromosome": ("chromosome", "chrom", "chr"), "position": ("position", "pos"), "genotype": ("genotype", "result"), "allele1": ("allele1", "allele 1"), "allele2": ("allele2", "allele 2")}
# Genotypes that are no call in single-column files.
BLANK = ("", "--", "-", "0", "00", "NN", "DD", "II", "DI", "ID")


def parse_array_exports(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, refused files) from ``file, line`` rows of vendor exports.

    The header, with or without ``#``, is the one line with an rsid and a chromosome name; tab or comma is told by
    it.  A file without one, or without genotype columns, is refused.
    """
    names = F.lower(F.regexp_replace("line", '^#+\\s*|"', ""))
    sep = F.when(F.col("line").contains("\t"), "\t").otherwise(",")
    parts = F.transform(F.split(names, F.when(F.col("line").contains("\t"), "\t").otherwise(",")), lambda x: F.trim(x))
    is_header = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in NAMES["rsid"]])) & F.arrays_overlap(parts, F.array(*[F.lit(n) for n in NAMES["chromosome"]]))
    comment = F.col("line").startswith("#") | is_header
    said = F.lower(F.when(comment, F.col("line")))
    provider = F.coalesce(*[F.when(F.max(said.contains(text)), F.lit(name)) for text, name in PROVIDERS], F.lit("generic"))
    facts = lines.groupBy("file").agg(F.max(F.when(is_header, F.struct(F.size(parts).alias("k"), parts.alias("names"), sep.alias("sep")))).alias("h"), provider.alias("provider"))
    spot = lambda key: F.array_min(F.filter(F.array(*[F.array_position("h.names", n) for n in NAMES[key]]), lambda i: i > 0)).cast("int")
    facts = facts.select("file", "provider", "h.sep", *[spot(k).alias(f"i_{k}") for k in NAMES])
    usable = F.col("i_rsid").isNotNull() & (F.col("i_genotype").isNotNull() | (F.col("i_allele1").isNotNull() & F.col("i_allele2").isNotNull()))
    refused = facts.where(~usable).select("file", F.lit("no usable header").alias("reason"))
    rows = lines.where(~comment).join(facts.where(usable), "file")  # one row for each file
    cells = F.transform(F.split(F.regexp_replace("line", '"', ""), F.col("sep")), lambda x: F.trim(x))
    at = lambda k: F.get(cells, F.col(f"i_{k}") - 1)
    gt = F.upper(at("genotype"))
    split = F.col("i_allele1").isNotNull() & F.col("i_allele2").isNotNull()
    ok = F.when(split, ~F.coalesce(at("allele1").isin("", "0"), F.lit(True)) & ~F.coalesce(at("allele2").isin("", "0"), F.lit(True))).otherwise(~F.coalesce(gt.isin(*BLANK), F.lit(True)) & F.length(gt).between(1, 2))
    calls = rows.select(
        "file", "provider", F.lower(at("rsid")).alias("rsid"), F.coalesce(at("chromosome"), F.lit("")).alias("chromosome"), at("position").try_cast("long").alias("position"), F.when(split, F.upper(at("allele1"))).otherwise(F.substring(gt, 1, 1)).alias("allele1"),
        F.when(split, F.upper(at("allele2"))).otherwise(F.substring(gt, F.length(gt), F.lit(1))).alias("allele2"), ok.alias("ok"),
    )
    return calls.where("ok and rsid like 'rs%' and position is not null").drop("ok"), refused


def read_array_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_array_exports(read_lines(spark, path))


def array_coverage(spark: SparkSession, path: str) -> DataFrame:
    """All rsids that the exports list."""
    return read_lines(spark, path).select(F.lower(F.regexp_extract("line", r'^"?(rs\d+)"?[\t, ]', 1)).alias("rsid")).where("rsid <> ''").distinct()
