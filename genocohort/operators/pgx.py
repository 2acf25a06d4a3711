"""Star alleles, phenotypes and medicines (AG35, WN11, WN12, JN18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import copies, real_call

# Strength of a call, weakest first.
CONFIDENCE = ("none", "low", "moderate", "high")


def defined_copies(pooled: DataFrame, defs: DataFrame) -> DataFrame:
    """``sample_id, gene, allele, rsid, n``: copies of each defining base, null where the position was not read."""
    grid = pooled.select("sample_id").distinct().crossJoin(defs.select("gene", "allele", "rsid", "base"))  # a small dimension
    rows = grid.join(pooled.select("sample_id", "rsid", "allele1", "allele2"), ["sample_id", "rsid"], "left")
    read = F.col("allele1").isNotNull() & real_call("allele1", "allele2", "star")
    return rows.select("sample_id", "gene", "allele", "rsid", F.when(read & F.col("base").isNotNull(), copies("allele1", "allele2", "base")).alias("n"))


def allele_status(pooled: DataFrame, defs: DataFrame) -> DataFrame:
    """untestable if any position of an allele was not read, else present or absent by the least of its copies."""
    calls = pooled.where(real_call("allele1", "allele2", "star")).select("sample_id", "rsid", "allele1", "allele2")
    # only read positions meet the definitions; what was not read follows from an allele's number of positions
    read = calls.join(defs.where("base is not null").select("gene", "allele", "rsid", "base"), "rsid").groupBy("sample_id", "gene", "allele").agg(F.count(F.lit(1)).alias("read"), F.min(copies("allele1", "allele2", "base")).alias("least"))
    whole = defs.groupBy("gene", "allele").agg(F.count(F.lit(1)).alias("variants"))
    out = pooled.select("sample_id").distinct().crossJoin(whole).join(read, ["sample_id", "gene", "allele"], "left")  # the result's own rows
    n = F.when(F.col("read") == F.col("variants"), F.col("least"))
    return out.select("sample_id", "gene", "allele", F.when(n.isNull(), "untestable").when(n > 0, "present").otherwise("absent").alias("status"), n.alias("copies"), "variants")


def star_order(allele: Column) -> Column:
    return F.coalesce(F.regexp_extract(allele, r"^\*(\d+)", 1).try_cast("int"), F.lit(10**6))


def assign_slots(pooled: DataFrame, defs: DataFrame, reference: str = "*1") -> DataFrame:
    """The diplotype of each sample and gene.

    Present alleles take up to two slots, those with most positions first, then by star number; an allele takes as often as
    each of its positions still has unused copies.  The reference fills the rest, which is flagged as inferred.  No gene
    has more than a few dozen alleles, so a fold over them is small.
    """
    rows = defined_copies(pooled, defs)
    per = rows.groupBy("sample_id", "gene", "allele").agg(F.collect_list(F.struct("rsid", "n")).alias("at"), F.count_if(F.col("n").isNull()).alias("unread"), F.min("n").alias("least"))
    size = -F.size("at")
    one = F.when((F.col("unread") == 0) & (F.col("least") > 0), F.struct(size.alias("o1"), star_order(F.col("allele")).alias("o2"), "allele", F.transform("at", lambda x: x["rsid"]).alias("rsids"), F.transform("at", lambda x: x["n"]).alias("ns")))
    genes = per.groupBy("sample_id", "gene").agg(F.array_sort(F.collect_list(one)).alias("found"), F.count_if(F.col("unread") > 0).alias("untestable"), F.count_if(F.col("unread") == 0).alias("tested"))

    def step(acc: Column, x: Column) -> Column:
        used = lambda r: F.size(F.filter(acc["used"], lambda u: u == r))
        free = F.array_min(F.transform(F.arrays_zip(x["rsids"].alias("r"), x["ns"].alias("k")), lambda p: p["k"] - used(p["r"])))
        take = F.greatest(F.lit(0), F.least(free, 2 - F.size(acc["slots"])))
        return F.struct(F.concat(acc["slots"], F.array_repeat(x["allele"], take)).alias("slots"), F.concat(acc["used"], F.flatten(F.array_repeat(x["rsids"], take))).alias("used"))

    texts = F.array().cast("array<string>")
    slots = F.aggregate("found", F.struct(texts.alias("slots"), texts.alias("used")), step)["slots"]
    out = genes.withColumn("_slots", slots)
    filled = F.concat("_slots", F.array_repeat(F.lit(reference), 2 - F.size("_slots")))
    key = lambda a: F.struct((a != reference).alias("r"), star_order(a).alias("s"), a.alias("a"))
    ordered = F.transform(F.array_sort(F.transform(filled, key)), lambda k: k["a"])
    inferred = F.size("_slots") < 2
    sure = F.when(F.col("tested") == 0, "none").when((F.col("untestable") > 0) & inferred, "low").when(F.col("untestable") > 0, "moderate").otherwise("high")
    return out.select("sample_id", "gene", F.when(F.col("tested") > 0, F.array_join(ordered, "/")).alias("diplotype"), (inferred & (F.col("tested") > 0)).alias("reference_inferred"), "untestable", (F.size("found") > F.size(F.array_distinct("_slots"))).alias("excess_alleles"), sure.alias("confidence"))


def phenotype(diplotypes: DataFrame, activities: DataFrame, bands: DataFrame, provisional: tuple[str, ...] = ()) -> DataFrame:
    """Activity score and phenotype; Indeterminate unless both alleles are known and no inferred reference hides an unread one.

    ``activities(gene, allele, activity)``; ``bands(gene, low, high, phenotype)`` half open, null for no bound.
    """
    d = diplotypes.withColumns({"_a": F.element_at(F.split("diplotype", "/"), 1), "_b": F.element_at(F.split("diplotype", "/"), 2)})
    for side in "ab":
        d = d.join(activities.select("gene", F.col("allele").alias(f"_{side}"), F.col("activity").alias(f"_act_{side}")), ["gene", f"_{side}"], "left")
    d = d.withColumn("activity_score", F.round(F.col("_act_a") + F.col("_act_b"), 4))
    veto = F.col("diplotype").isNull() | F.col("activity_score").isNull() | (F.col("reference_inferred") & ((F.col("untestable") > 0) | F.col("gene").isin(*provisional) if provisional else (F.col("untestable") > 0)))
    b = bands.select(F.col("gene").alias("_g"), "low", "high", F.col("phenotype").alias("_p"))
    hit = (F.col("gene") == F.col("_g")) & (F.col("low").isNull() | (F.col("activity_score") >= F.col("low"))) & (F.col("high").isNull() | (F.col("activity_score") < F.col("high")))
    out = d.join(b, hit, "left")
    return out.select("sample_id", "gene", "diplotype", "reference_inferred", "untestable", "confidence", "activity_score", F.when(veto | F.col("_p").isNull(), "Indeterminate").otherwise(F.col("_p")).alias("phenotype"))


def match_drugs(medicines: DataFrame, phenotypes: DataFrame, aliases: DataFrame, pairs: DataFrame) -> DataFrame:
    """What a person's phenotypes say about their medicines.

    ``medicines(sample_id, text)`` is free text split on , ; and newlines, strength taken off; ``aliases(alias, drug)``;
    ``pairs(drug, gene, phenotype, effect)``.  Unknown medicines are listed with no drug; Indeterminate gives insufficient evidence.
    """
    name = F.trim(F.regexp_replace(F.lower("item"), r"\s+\d+(\.\d+)?\s*(mg|mcg|ug|g|ml|iu|units?)?\b.*$", ""))
    items = medicines.select("sample_id", F.explode(F.split("text", r"[,;\n]")).alias("item")).withColumn("medicine", name).where("medicine <> ''").select("sample_id", "medicine").distinct()
    known = items.join(aliases.select(F.lower("alias").alias("medicine"), "drug"), "medicine", "left")
    genes = pairs.select("drug", "gene").distinct()
    rows = known.join(genes, "drug", "left").join(phenotypes.select("sample_id", "gene", "phenotype"), ["sample_id", "gene"], "left").join(pairs, ["drug", "gene", "phenotype"], "left")
    effect = F.when(F.col("drug").isNull(), "unmatched").when(F.col("phenotype") == "Indeterminate", "insufficient evidence").otherwise(F.coalesce("effect", F.lit("no listed effect")))
    return rows.where("drug is null or phenotype is not null").select("sample_id", "medicine", "drug", "gene", "phenotype", effect.alias("effect"))


def unverified_alleles(defs: DataFrame) -> DataFrame:
    """``gene, allele, variants``: star alleles with a variant that is not confirmed, all their variants as ``rsid=base``."""
    rows = defs.groupBy("gene", "allele").agg(F.bool_and(F.coalesce("verified", F.lit(False))).alias("sure"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "rsid", "base"))), ",").alias("variants"))
    return rows.where("not sure").drop("sure")
