"""Calls meet references, frequencies and overlays (JN1-JN3, JN6-JN10, AG23, WN5, SC24, SC31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.alleles import clean, complement, copies, genotype_key, is_palindromic, strand_clean, zygosity
from ..functions.population import hardy_weinberg, rarity_band
from ..functions.scoring import SILO_RANK, classify_silo, field

REFERENCE_FIELDS = ("gene", "category", "risk_allele", "clinical_sig", "review_status", "cpic_level", "publications", "interpretation")


def annotate(calls: DataFrame, ref_variants: DataFrame) -> DataFrame:
    """Findings: pooled calls joined to the reference by rsid.

    The reference may outgrow a broadcast, so the join is left to the optimizer and its size statistics.
    """
    fields = [c for c in ref_variants.columns if c != "rsid"]
    out = calls.select("sample_id", "rsid", "chromosome", "position", "allele1", "allele2", "genotype").join(ref_variants.select("rsid", *fields), "rsid")
    risk = clean("risk_allele")
    return out.select(
        "sample_id", "rsid", F.lit("snp").alias("entity_type"), "chromosome", "position", "allele1", "allele2", F.concat(F.coalesce("allele1", F.lit("")), F.coalesce("allele2", F.lit(""))).alias("genotype"), *[c for c in fields if c != "risk_allele"], risk.alias("risk_allele"),
        F.when(risk != "", copies("allele1", "allele2", risk)).alias("variant_copies"), zygosity("allele1", "allele2").alias("zygosity"), classify_silo(field(ref_variants, "interpretation")).alias("silo"),
    )


def annotate_tiered(calls: DataFrame, tier1: DataFrame, tier2: DataFrame) -> DataFrame:
    """Tier 1 first; only calls it doesn't know go to tier 2, where a non-carrier becomes informational with a note."""
    first = annotate(calls, tier1).withColumn("tier", F.lit(1))
    second = annotate(calls.join(tier1.select("rsid").distinct(), "rsid", "left_anti"), tier2).withColumn("tier", F.lit(2))
    none = F.coalesce(F.col("variant_copies") == 0, F.lit(False))
    second = second.withColumn("interpretation", F.when(none, F.concat(F.lit("Variant allele not carried. "), F.coalesce("interpretation", F.lit("")))).otherwise(F.col("interpretation")))
    return first.unionByName(second.withColumn("silo", F.when(none, "informational").otherwise(F.col("silo"))))


def dedupe_findings(findings: DataFrame, order: str = "tier") -> DataFrame:
    """One finding for each (sample_id, rsid): the foremost silo, then the first by ``order``."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in SILO_RANK.items() for x in kv])[F.col("silo")], F.lit(3))
    w = W.partitionBy("sample_id", "rsid").orderBy(rank, order, *[F.col(c) for c in ("gene", "clinical_sig") if c in findings.columns])
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Text fields in which null reads as ''.
BLANK_FIELDS = ("gene", "genotype", "zygosity", "clinical_sig", "conditions", "interpretation", "summary", "category", "silo", "repute", "cpic_level", "evidence")


def finding_defaults(df: DataFrame) -> DataFrame:
    """Blank named texts instead of null, conditions as a list, ``carrier`` from the copies (null if unknown)."""
    df = df.withColumns({c: F.coalesce(field(df, c), F.lit("")) for c in BLANK_FIELDS})
    n = field(df, "variant_copies", "int")
    parts = F.filter(F.transform(F.split("conditions", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns({"entity_type": F.coalesce(field(df, "entity_type"), F.lit("snp")), "conditions_list": parts, "carrier": n > 0, "variant_copies": n, "topics": F.coalesce(field(df, "topics", "array<string>"), F.array().cast("array<string>")), "medicines": F.coalesce(field(df, "medicines", "array<string>"), F.array().cast("array<string>"))})


def attach_calls(findings: DataFrame, pooled: DataFrame, relatives: DataFrame) -> DataFrame:
    """Add each finding's kits and one entry per relative with ``shared`` (the same unordered genotype).

    ``relatives(sample_id, relative, role, rsid, genotype)`` holds the calls of a sample's relatives.
    """
    kits = pooled.select("sample_id", "rsid", F.col("count"), "labels", "conflict", "calls", F.col("genotype").alias("_key"))
    out = findings.join(kits, ["sample_id", "rsid"], "left")
    rel = relatives.groupBy("sample_id", "rsid").agg(F.array_sort(F.collect_list(F.struct("role", "relative", F.col("genotype").alias("genotype")))).alias("_rel"))
    out = out.join(rel, ["sample_id", "rsid"], "left")
    shared = F.transform(F.coalesce("_rel", F.array().cast("array<struct<role:string,relative:bigint,genotype:string>>")), lambda r: F.struct(r["role"].alias("role"), r["relative"].alias("relative"), r["genotype"].alias("genotype"), (r["genotype"] == F.col("_key")).alias("shared")))
    return out.withColumns({"comparison": shared, "count": F.coalesce("count", F.lit(0)), "conflict": F.coalesce("conflict", F.lit(False))}).drop("_rel", "_key")


def resolve_strand(calls: DataFrame, allele_freq: DataFrame) -> DataFrame:
    """Read each genotype on the strand of the frequency table.

    Direct if both alleles are in the table, else the complement if both of its are, else whichever has more
    hits (unresolved); a palindrome keeps its direct reading and is flagged.
    """
    return on_strand(calls.join(observed_alleles(allele_freq), "rsid", "left")).drop("observed", "table")


def observed_alleles(allele_freq: DataFrame) -> DataFrame:
    """``rsid, table, observed``: a marker's frequencies of all populations in one row, and the bases among its alleles."""
    table = allele_freq.groupBy("rsid").agg(F.collect_list(F.struct("pop", F.upper("allele").alias("allele"), "freq")).alias("table"))
    bases = F.array_distinct(F.filter(F.transform("table", lambda t: t["allele"]), lambda a: a.isin("A", "C", "G", "T")))
    return table.withColumn("observed", bases)


def on_strand(rows: DataFrame) -> DataFrame:
    """Calls with ``observed``, read on that strand."""
    x, y = strand_clean("allele1"), strand_clean("allele2")
    has = lambda a: F.coalesce(F.array_contains("observed", a), F.lit(False)).cast("int")
    direct, other = has(x) + has(y), has(complement(x)) + has(complement(y))
    called = (x != "N") & (y != "N")
    flip = called & (direct < 2) & ((other == 2) | (other > direct))
    return rows.withColumns({
        "freq_allele1": F.when(called, F.when(flip, complement(x)).otherwise(x)).otherwise(""), "freq_allele2": F.when(called, F.when(flip, complement(y)).otherwise(y)).otherwise(""), "freq_flipped": flip,
        "freq_ambiguous": called & is_palindromic("allele1", "allele2"), "freq_resolved": called & ((direct == 2) | (other == 2)),
    })


def genotype_frequency(calls: DataFrame, allele_freq: DataFrame, population: str | None = None, genotype_freq: DataFrame | None = None, pop_n: DataFrame | None = None) -> DataFrame:
    """Percent of a population with each call's genotype: a stored genotype table first, else Hardy-Weinberg.

    With ``population`` one row for each call, else one for each call and population of the tables.  The frequency is
    null where unknown and 0.0 where a table says that none was seen.
    """
    # one join brings a marker's alleles and frequencies; populations and both alleles are looked up in that row
    base = on_strand(calls.join(observed_alleles(allele_freq), "rsid", "left"))
    if population is not None:
        base = base.withColumn("pop", F.lit(population))
    else:
        pops = allele_freq.agg(F.array_sort(F.collect_set("pop")).alias("pops"))  # one row, a handful of populations
        base = base.crossJoin(F.broadcast(pops)).withColumn("pop", F.explode("pops")).drop("pops")
    of = lambda i: F.get(F.filter("table", lambda t: (t["pop"] == F.col("pop")) & (t["allele"] == F.col(f"freq_allele{i}"))), F.lit(0))["freq"]
    base = base.withColumns({"_p1": of(1), "_p2": of(2)}).drop("table", "observed")
    derived = hardy_weinberg("_p1", "_p2", F.col("freq_allele1") == F.col("freq_allele2"))
    stored, by = F.lit(None).cast("double"), F.lit("observed")
    if genotype_freq is not None:
        table = genotype_freq.select("rsid", "pop", genotype_key(F.substring("genotype", 1, 1), F.substring("genotype", 2, 1)).alias("_key"), F.col("percent").alias("_stored"), *([F.col("derived").alias("_by")] if "derived" in genotype_freq.columns else []))
        base = base.withColumn("_key", genotype_key("freq_allele1", "freq_allele2")).join(table, ["rsid", "pop", "_key"], "left").drop("_key")
        stored = F.round("_stored", 2)
        by = F.when(F.col("_by"), "hardy_weinberg").otherwise("observed") if "_by" in base.columns else by
    out = base.withColumns({
        "freq": F.coalesce(stored, derived), "freq_method": F.when(stored.isNotNull(), by).when(derived.isNotNull(), "hardy_weinberg").otherwise("unavailable"), "freq_queried": F.concat("freq_allele1", "freq_allele2"), "freq_population": F.col("pop"),
    })
    out = out.withColumns({"freq_derived": F.col("freq_method") == "hardy_weinberg", "freq_band": rarity_band("freq")}).drop("_p1", "_p2", "_stored", "_by", "freq_allele1", "freq_allele2", "freq_resolved")
    return out.join(pop_n.select("rsid", "pop", F.col("n").alias("freq_n")), ["rsid", "pop"], "left") if pop_n is not None else out


def population_series(calls: DataFrame, allele_freq: DataFrame, requested: str) -> DataFrame:
    """The genotype's frequency in every population with data; ``yours`` is the requested one, or else the first."""
    first = allele_freq.select(F.min_by(F.col("pop"), F.struct(F.col("pop") != requested, F.col("pop"))).alias("_yours"))
    return genotype_frequency(calls, allele_freq).crossJoin(F.broadcast(first)).withColumn("yours", F.col("pop") == F.col("_yours")).drop("_yours")


def aggregate_frequency(calls: DataFrame, allele_freq: DataFrame) -> DataFrame:
    """Highest, mean and lowest percent over the populations that have a value."""
    rows = genotype_frequency(calls, allele_freq)
    return rows.groupBy("sample_id", "rsid").agg(F.round(F.max("freq"), 2).alias("freq_max"), F.round(F.avg("freq"), 2).alias("freq_avg"), F.round(F.min("freq"), 2).alias("freq_min"))


def annotate_frequency(findings: DataFrame, allele_freq: DataFrame, population: str, gmaf: DataFrame | None = None) -> DataFrame:
    """Frequency columns on single-position findings; other entities get none of them filled."""
    out = genotype_frequency(findings, allele_freq, population).drop("pop")
    snp = F.col("entity_type") == "snp"
    made = ("freq", "freq_method", "freq_queried", "freq_population", "freq_derived", "freq_band", "freq_flipped", "freq_ambiguous")
    out = out.withColumns({c: F.when(snp, F.col(c)) for c in made})
    return out.join(gmaf.select("rsid", "gmaf", "minor_allele"), "rsid", "left") if gmaf is not None else out


def overlay_genotypes(findings: DataFrame, overlay: DataFrame) -> DataFrame:
    """A curated overlay by (rsid, token): the genotype's own token first, then that of the other strand."""
    from ..functions.alleles import candidate_tokens

    rows = findings.select("sample_id", "rsid", F.posexplode(candidate_tokens("allele1", "allele2")).alias("at", "token"))
    hit = rows.join(overlay, ["rsid", "token"]).groupBy("sample_id", "rsid").agg(F.min_by(F.struct("at", "token", "overlay_magnitude", "overlay_repute", "overlay_summary"), "at").alias("o"))
    out = findings.join(hit, ["sample_id", "rsid"], "left")
    return out.withColumns({"token": F.col("o.token"), "overlay_magnitude": F.col("o.overlay_magnitude"), "overlay_repute": F.col("o.overlay_repute"), "overlay_summary": F.col("o.overlay_summary"), "flipped": F.coalesce(F.col("o.at") > 0, F.lit(False))}).drop("o")
