"""Variant files: records, samples, builds, imputation facts, pileups (SRC2-SRC8, SRC22)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import normalize_contig
from .lines import read_lines

SKIPS = ("reference_block", "shape", "no_call", "no_id")
# Lengths of contigs that tell the builds apart.
CONTIGS = {"GRCh37": {"1": 249250621, "2": 243199373, "10": 135534747, "X": 155270560}, "GRCh38": {"1": 248956422, "2": 242193529, "10": 133797422, "X": 156040895}}
BUILD_TEXT = (("GRCh37", ("grch37", "hg19", "b37", "hs37")), ("GRCh38", ("grch38", "hg38", "b38", "hs38")))
MIN_DEPTH, MIN_FRACTION = 8, 0.20


def records(lines: DataFrame) -> DataFrame:
    """Fields of data lines: ``file, chrom, pos, ids, ref, alts, filter, info, format, cells``."""
    f = F.split("line", "\t")
    out = lines.where(~F.col("line").startswith("#")).select("file", f.alias("f")).where(F.size("f") >= 8)
    return out.select("file", F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("pos"), F.col("f")[2].alias("ids"), F.upper(F.col("f")[3]).alias("ref"), F.split(F.upper(F.col("f")[4]), ",").alias("alts"), F.col("f")[6].alias("filter"), F.col("f")[7].alias("info"), F.split(F.get("f", F.lit(8)), ":").alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("cells"))


def sample_names(lines: DataFrame) -> DataFrame:
    head = lines.where(F.col("line").startswith("#CHROM")).select("file", F.split("line", "\t").alias("h"))
    return head.select("file", F.slice("h", 10, F.greatest(F.size("h") - 9, F.lit(0))).alias("samples"))


def rsid_of(ids: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(F.lower(ids), "[;,]"), lambda x: F.trim(x)), lambda x: x.rlike(r"^rs\d+$")), F.lit(0))


def decode(lines: DataFrame) -> DataFrame:
    """One row for each record and sample with its alleles and, if it is not a call, the one reason why.

    Reasons are tried in order: a reference block or symbolic allele, the shape of the selected alleles (substitutions
    of one base, at most two copies), no call (half calls included), no rsid.
    """
    rows = records(lines).join(sample_names(lines), "file", "left").select("*", F.posexplode_outer("cells").alias("k", "cell"))
    gt = F.get(F.split("cell", ":"), F.array_position("format", "GT").cast("int") - 1)
    idx = F.transform(F.split(gt, "[/|]"), lambda x: x.try_cast("int"))
    alleles = F.transform(idx, lambda i: F.get(F.concat(F.array("ref"), F.col("alts")), i))
    rows = rows.withColumns({"gt": gt, "alleles": alleles, "phased": F.coalesce(gt.contains("|"), F.lit(False))})
    symbolic = F.exists("alts", lambda a: a.startswith("<") | (a == "*")) & ~F.exists("alts", lambda a: a.rlike("^[ACGT]+$"))
    block = symbolic | F.coalesce((F.size("alts") == 1) & F.col("alts")[0].isin(".", "<NON_REF>", "<*>"), F.lit(False))
    read = F.filter("alleles", lambda a: a.isNotNull())
    odd = (F.size("alleles") > 2) | (F.length("ref") != 1) | F.exists(read, lambda a: ~a.rlike("^[ACGT]$"))
    lost = F.coalesce(F.size(read) < F.size("alleles"), F.lit(True)) | (F.size(read) < 1)
    rsid = rsid_of(F.col("ids"))
    skip = F.when(block, SKIPS[0]).when(F.coalesce(odd, F.lit(False)), SKIPS[1]).when(lost, SKIPS[2]).when(rsid.isNull(), SKIPS[3])
    second = F.coalesce(F.get("alleles", F.lit(1)), F.col("alleles")[0])
    return rows.select("file", F.get("samples", F.col("k")).alias("sample"), rsid.alias("rsid"), normalize_contig("chrom").alias("chromosome"), F.col("pos").alias("position"), F.col("alleles")[0].alias("allele1"), second.alias("allele2"), "phased", "gt", "filter", skip.alias("skip"))


def read_vcf(spark: SparkSession, path: str, samples: tuple[str, ...] | None = None) -> DataFrame:
    """Calls of all samples, or of those named."""
    out = decode(read_lines(spark, path)).where("skip is null").drop("skip")
    return out.where(F.col("sample").isin(*samples)) if samples else out


def skip_accounting(decoded: DataFrame) -> DataFrame:
    """How many rows of each file became calls or were skipped, each counted once."""
    return decoded.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("skip").isNull()).alias("calls"), *[F.count_if(F.col("skip") == s).alias(s) for s in SKIPS], F.count_if(F.col("skip").isNull() & ~F.col("filter").isin("PASS", ".")).alias("kept_not_pass"))


def detect_build(lines: DataFrame) -> DataFrame:
    """Build of each file: contig lengths first, then text of the header; contradictory lengths give none."""
    head = lines.where(F.col("line").startswith("##"))
    contig = normalize_contig(F.regexp_extract("line", r"^##contig=<.*?ID=([^,>]+)", 1))
    length = F.regexp_extract("line", r"length=(\d+)", 1)
    known = {f"{c}:{n}": b for b, table in CONTIGS.items() for c, n in table.items()}
    by_length = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.concat(contig, F.lit(":"), length)]
    words = F.lower(F.when(F.col("line").rlike("(?i)^##(reference|contig|assembly)"), F.col("line")))
    by_text = F.coalesce(*[F.when(words.contains(t), F.lit(b)) for b, ts in BUILD_TEXT for t in ts])
    facts = lines.select("file").distinct().join(head.groupBy("file").agg(F.array_sort(F.collect_set(by_length)).alias("l"), F.array_sort(F.collect_set(by_text)).alias("t")), "file", "left")
    one = lambda c: F.size(c) == 1
    build = F.when(one("l"), F.col("l")[0]).when(F.size("l") > 1, None).when(one("t"), F.col("t")[0])
    sure = F.when(one("l") & F.exists("t", lambda b: b != F.col("l")[0]), "medium").when(one("l"), "high").when(F.size("l") > 1, "conflict").when(one("t"), "medium").when(F.size("t") > 1, "conflict").otherwise("unknown")
    return facts.select("file", build.alias("build"), sure.alias("confidence"), F.when(F.size("l") > 0, "contig_lengths").when(F.size("t") > 0, "header_text").otherwise("none").alias("evidence"))


def require_build(calls: DataFrame, builds: DataFrame, expected: str = "GRCh37") -> tuple[DataFrame, DataFrame]:
    """(calls of files on the expected build, files refused)."""
    good = builds.where(F.col("build") == expected).select("file")
    return calls.join(good, "file", "left_semi"), builds.join(good, "file", "left_anti")


def require_phased(decoded: DataFrame) -> DataFrame:
    """Files with ``phased``: whether every called record is.  All records count, not a leading part."""
    return decoded.groupBy("file").agg(F.coalesce(F.bool_and(F.when(F.col("gt").contains("/") | F.col("gt").contains("|"), F.col("phased"))), F.lit(False)).alias("phased"), F.count(F.lit(1)).alias("records"))


def parse_imputed(lines: DataFrame) -> DataFrame:
    """Imputation facts of records: ``dr2`` (DR2, R2, INFO in order), ``af`` (AF, MAF, AF1), ``imputed`` and the folded ``maf``."""
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    rows = records(lines).withColumn("m", info)
    number = lambda *keys: F.coalesce(*[F.split(F.col("m")[k], ",")[0].try_cast("double") for k in keys])
    rows = rows.withColumns({"dr2": number("DR2", "R2", "INFO"), "af": number("AF", "MAF", "AF1"), "imputed": F.map_contains_key("m", F.lit("IMP")) | F.map_contains_key("m", F.lit("IMPUTED"))})
    return rows.select("file", normalize_contig("chrom").alias("chromosome"), F.col("pos").alias("position"), rsid_of(F.col("ids")).alias("rsid"), "ref", F.col("alts")[0].alias("alt"), "dr2", "af", F.least("af", 1 - F.col("af")).alias("maf"), "imputed")


def read_imputed_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_imputed(read_lines(spark, path))


def parse_pileup(lines: DataFrame) -> DataFrame:
    """Counts of A, C, G, T at each position of text pileups; indels, read ends and gaps are no observations."""

    def strip(bases: pd.Series) -> pd.Series:
        import re

        def one(text: str) -> str:
            text, out, i = re.sub(r"\^.|\$", "", text or ""), [], 0
            while i < len(text):
                m = re.compile(r"[+-](\d+)").match(text, i)
                if m:
                    i = m.end() + int(m[1])
                else:
                    out.append(text[i])
                    i += 1
            return "".join(out)

        return bases.map(one)

    strip_indels = F.pandas_udf(strip, "string")  # lengths inside the text decide what to drop: no built-in can
    f = F.split("line", "\t")
    rows = lines.select("file", f.alias("f")).where("size(f) >= 5").select("file", normalize_contig(F.col("f")[0]).alias("chromosome"), F.col("f")[1].try_cast("long").alias("position"), F.upper(F.col("f")[2]).alias("ref"), F.col("f")[4].alias("raw"))
    rows = rows.withColumn("bases", F.upper(strip_indels("raw")))
    n = lambda b: (F.length("bases") - F.length(F.replace("bases", F.lit(b))) + F.when(F.col("ref") == b, F.length(F.regexp_replace("bases", "[^.,]", ""))).otherwise(0)).cast("int")
    return rows.select("file", "chromosome", "position", "ref", *[n(b).alias(b) for b in "ACGT"])


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    return parse_pileup(read_lines(spark, path))


def call_from_counts(counts: DataFrame, min_depth: int = MIN_DEPTH, min_fraction: float = MIN_FRACTION) -> DataFrame:
    """Genotype from base counts: the two best supported bases, N,N below the depth."""
    depth = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    pairs = F.array(*[F.struct((-F.col(b)).alias("m"), F.lit(b).alias("b")) for b in "ACGT"])
    best = F.transform(F.slice(F.array_sort(F.filter(pairs, lambda p: (-p["m"] >= min_fraction * depth) & (p["m"] < 0))), 1, 2), lambda p: p["b"])
    out = counts.withColumn("_b", F.when(depth >= min_depth, F.array_sort(best)).otherwise(F.array(F.lit("N"), F.lit("N"))))
    return out.withColumns({"depth": depth, "allele1": F.coalesce(F.get("_b", F.lit(0)), F.lit("N")), "allele2": F.coalesce(F.get("_b", F.lit(1)), F.get("_b", F.lit(0)), F.lit("N"))}).drop("_b")
