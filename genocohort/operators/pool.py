"""Kits of a person: repeats within a kit, pooling over kits, conflicts kept (WN1, WN2, AG1-AG3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.alleles import clean, genotype_key, normalize_role, real_call


def dedupe_kit(calls: DataFrame, to_pool: bool = False) -> DataFrame:
    """One row for each (sample_id, kit, rsid): the first real call in file order ``seq``, else the first no-call.

    With ``to_pool`` all kits' calls of a sample and rsid meet at once, so that ``pool_calls`` shuffles nothing more.
    """
    calls = calls.withColumn("rsid", F.lower(F.trim("rsid"))).where("rsid <> ''")
    calls = calls.repartition("sample_id", "rsid") if to_pool else calls
    order = W.partitionBy("sample_id", "kit", "rsid").orderBy(F.when(real_call("allele1", "allele2"), 0).otherwise(1), "seq")
    return calls.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def label_kits(kits: DataFrame) -> DataFrame:
    """Give each kit of a sample a label of its own: blank ones ``fileN``, repeats `` (2)``, `` (3)``.

    A number that another kit already has as its label is passed over.  Kits of role ``ignore`` go.
    """
    kits = kits.withColumn("role", normalize_role("role"))
    order = W.partitionBy("sample_id").orderBy("kit_ord")
    kits = kits.withColumn("_base", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("file"), F.row_number().over(order).cast("string"))))
    kits = kits.where("role <> 'ignore'")
    again = W.partitionBy("sample_id", "_base").orderBy("kit_ord")
    kits = kits.withColumn("_k", F.row_number().over(again)).withColumn("_taken", F.collect_set("_base").over(W.partitionBy("sample_id")))
    free = F.filter(F.transform(F.sequence(F.lit(2), F.col("_k") + F.size("_taken") + 1), lambda i: F.concat("_base", F.lit(" ("), i.cast("string"), F.lit(")"))), lambda x: ~F.array_contains("_taken", x))
    return kits.withColumn("label", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.element_at(free, F.greatest(F.col("_k") - 1, F.lit(1))))).drop("_base", "_k", "_taken")


def pool_calls(calls: DataFrame) -> DataFrame:
    """Union of a person's kits by rsid, from ``dedupe_kit`` rows with ``label`` and ``kit_ord``.

    The first real call in kit order is the genotype, ``count`` and ``labels`` are over real calls, all of
    which stay in ``calls``; they conflict if one differs from the first.  Empty places are filled from later kits.
    """
    key, real = genotype_key("allele1", "allele2"), real_call("allele1", "allele2")
    call = F.when(real, F.struct("kit_ord", "label", F.least(clean("allele1"), clean("allele2")).alias("allele1"), F.greatest(clean("allele1"), clean("allele2")).alias("allele2"), key.alias("genotype")))
    place = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("kit_ord")))
    out = calls.groupBy("sample_id", "rsid").agg(
        F.array_sort(F.collect_list(call)).alias("_calls"), place("chromosome", F.coalesce(F.trim(F.col("chromosome").cast("string")), F.lit("")) != "").alias("chromosome"), place("position", F.coalesce("position", F.lit(0)) != 0).alias("position"), F.min("kit_ord").alias("first_kit_ord"), F.count(F.lit(1)).alias("n_kits")
    )
    first = F.get("_calls", F.lit(0))
    return out.select(
        "sample_id", "rsid", F.coalesce("chromosome", F.lit("")).alias("chromosome"), F.coalesce("position", F.lit(0)).alias("position"), F.coalesce(first["allele1"], F.lit("N")).alias("allele1"), F.coalesce(first["allele2"], F.lit("N")).alias("allele2"),
        F.coalesce(first["genotype"], F.lit("NN")).alias("genotype"), F.size("_calls").alias("count"), F.transform("_calls", lambda c: c["label"]).alias("labels"), F.exists("_calls", lambda c: c["genotype"] != first["genotype"]).alias("conflict"),
        F.transform("_calls", lambda c: F.struct(c["label"].alias("label"), c["allele1"].alias("allele1"), c["allele2"].alias("allele2"), c["genotype"].alias("genotype"))).alias("calls"), "first_kit_ord", "n_kits",
    )


def pool_kit_stats(calls: DataFrame, pooled: DataFrame) -> DataFrame:
    """Per kit: positions it touched first, positions touched before it, and those in conflict that it read."""
    rows = calls.select("sample_id", "rsid", "label", "kit_ord", real_call("allele1", "allele2").alias("real"))
    rows = rows.join(pooled.select("sample_id", "rsid", "first_kit_ord", "conflict"), ["sample_id", "rsid"])
    return rows.groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("snp_count"), F.count_if(F.col("kit_ord") == F.col("first_kit_ord")).alias("contributed"), F.count_if(F.col("kit_ord") > F.col("first_kit_ord")).alias("overlapped"), F.count_if(F.col("conflict") & F.col("real")).alias("conflicting"))


def pool_totals(pooled: DataFrame) -> DataFrame:
    return pooled.groupBy("sample_id").agg(F.count(F.lit(1)).alias("union"), F.count_if(F.col("count") >= 2).alias("shared"), F.count_if("conflict").alias("conflicts"), F.count_if(F.size(F.array_distinct("labels")) == 1).alias("unique"))


def conflict_list(pooled: DataFrame) -> DataFrame:
    return pooled.where("conflict").select("sample_id", "rsid", "chromosome", "position", F.transform("calls", lambda c: F.struct(c["label"].alias("label"), c["genotype"].alias("genotype"))).alias("calls"))
