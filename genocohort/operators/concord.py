"""Agreement between the kits of a person (JN14, AG4-AG7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import C, complement_key, genotype_key, strand_clean


def base_key(a1, a2) -> Column:
    """Order-free key of two real bases, else null."""
    x, y = strand_clean(a1), strand_clean(a2)
    return F.when((x != "N") & (y != "N"), genotype_key(x, y))


def classify_conflict(a, b) -> Column:
    """not_comparable, agreement, indeterminate (a palindrome), orientation_artifact (other strand), else genuine."""
    x, y = C(a), C(b)
    return F.when(x.isNull() | y.isNull(), "not_comparable").when(x == y, "agreement").when(x.isin("AT", "CG") | y.isin("AT", "CG"), "indeterminate").when(complement_key(x) == y, "orientation_artifact").otherwise("genuine")


def coverage_by_provider(calls: DataFrame) -> DataFrame:
    """Positions with a readable call per provider; kits without a provider stand alone."""
    group = F.when(F.trim(F.coalesce("provider", F.lit(""))) != "", F.trim("provider")).otherwise(F.concat(F.lit("unknown:"), F.col("label")))
    return calls.where(base_key("allele1", "allele2").isNotNull()).groupBy("sample_id", group.alias("provider_group")).agg(F.countDistinct("rsid").alias("positions"), F.countDistinct("label").alias("kits"))


def rate(n: Column, of: Column) -> Column:
    """A rate over an empty denominator is unknown, not 0."""
    return F.when(of > 0, F.round(n / of, 6))


def kit_pairs(calls: DataFrame) -> DataFrame:
    """Every position that two kits of a person both list, as ``a, b, key_a, key_b``."""
    # a person's kits at one position, gathered once: as many as the person has kits
    kits = calls.groupBy("sample_id", "rsid").agg(F.collect_list(F.struct("label", base_key("allele1", "allele2").alias("key"))).alias("kits"))
    of = lambda a: F.transform(F.filter("kits", lambda b: b["label"] > a["label"]), lambda b: F.struct(a["label"].alias("a"), b["label"].alias("b"), a["key"].alias("key_a"), b["key"].alias("key_b")))
    return kits.where(F.size("kits") > 1).select("sample_id", "rsid", F.explode(F.flatten(F.transform("kits", of))).alias("p")).select("sample_id", "rsid", "p.*")


def concordance(calls: DataFrame, kits: DataFrame) -> DataFrame:
    """Counts and rates of each pair of a person's kits; pairs that share nothing are there with null rates."""
    kinds = kit_pairs(calls).withColumn("kind", classify_conflict("key_a", "key_b")).groupBy("sample_id", "a", "b").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("agreement", "genuine", "orientation_artifact", "indeterminate", "not_comparable")])
    names = kits.select("sample_id", "label", "provider").distinct()
    pairs = names.select("sample_id", F.col("label").alias("a"), F.col("provider").alias("provider_a")).join(names.select("sample_id", F.col("label").alias("b"), F.col("provider").alias("provider_b")), "sample_id").where("a < b")
    out = pairs.join(kinds, ["sample_id", "a", "b"], "left").na.fill(0, ["agreement", "genuine", "orientation_artifact", "indeterminate", "not_comparable"])
    conflicts = F.col("genuine") + F.col("orientation_artifact") + F.col("indeterminate")
    shared = F.col("agreement") + conflicts
    same = (F.coalesce("provider_a", F.lit("")) != "") & (F.lower("provider_a") == F.lower("provider_b"))
    return out.select("sample_id", "a", "b", same.alias("same_provider"), shared.alias("shared"), F.col("agreement").alias("agree"), conflicts.alias("conflicts"), "genuine", "orientation_artifact", "indeterminate", "not_comparable", rate(F.col("agreement"), shared).alias("agreement_rate"), rate(conflicts, shared).alias("conflict_rate"), rate(F.col("genuine"), shared).alias("genuine_rate"))


def concordance_totals(pairs: DataFrame, kits: DataFrame) -> DataFrame:
    """Sums over a person's pairs; with fewer than two kits nothing was attempted and all sums are null."""
    n = kits.groupBy("sample_id").agg(F.countDistinct("label").alias("kits"))
    sums = pairs.groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in ("shared", "agree", "conflicts", "genuine", "not_comparable")], F.count_if(F.col("shared") > 0).alias("comparable_pairs"))
    out = n.join(sums, "sample_id", "left")
    return out.select("*", (F.col("kits") >= 2).alias("attempted"), rate(F.col("agree"), F.col("shared")).alias("agreement_rate"), rate(F.col("genuine"), F.col("shared")).alias("genuine_rate"))


def findings_concordance(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """Findings that two kits read, and how many of them have a genuine conflict."""
    wanted = findings.select("sample_id", "rsid")
    keys = calls.select("sample_id", "rsid", "label", base_key("allele1", "allele2").alias("key")).where("key is not null").groupBy("sample_id", "rsid").agg(F.count(F.lit(1)).alias("n"), F.collect_set("key").alias("keys"))
    genuine = F.exists("keys", lambda x: F.exists("keys", lambda y: classify_conflict(x, y) == "genuine"))
    out = wanted.join(keys.select("sample_id", "rsid", (F.col("n") >= 2).alias("covered"), ((F.col("n") >= 2) & genuine).alias("bad")), ["sample_id", "rsid"], "left")
    return out.groupBy("sample_id").agg(F.count(F.lit(1)).alias("findings_total"), F.count_if("covered").alias("findings_covered"), F.count_if("bad").alias("findings_conflicted"))
