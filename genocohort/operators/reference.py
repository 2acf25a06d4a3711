"""Layered references: best record, replicated associations, levels, refresh (AG13-AG16, JN13, JN19, JN20, JN27, JN28, AG39, FL5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import CPIC_LEVELS, cpic_level, review_stars

MIN_MLOG, MIN_STUDIES = 7.3, 2


def sig_rank(code) -> Column:
    """Clinical order of numeric codes, which are names and no scale."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 5, 6).when(c == 4, 5).when(c == 6, 4).when(c == 7, 3).when(c == 1, 2).otherwise(1)


def best_record(rows: DataFrame, key: str, stars: str, code: str, order: list) -> DataFrame:
    """One row for each key: most stars, then the foremost class, then the first by ``order``."""
    w = W.partitionBy(key).orderBy(F.desc(stars), sig_rank(code).desc(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def significant(rows: DataFrame, mlog: str = "mlog", study: str = "study") -> DataFrame:
    return rows.where((F.col(mlog) >= MIN_MLOG) & (F.coalesce(F.col(study).cast("string"), F.lit("")) != ""))


def replicated(rows: DataFrame, key: str, study: str, trait: Column, paper: str, allele: str, order: str, least: int = MIN_STUDIES) -> DataFrame:
    """Keys with ``least`` distinct studies: traits joined in order, distinct papers, the first allele."""
    out = rows.withColumn("_trait", trait).groupBy(key).agg(
        F.countDistinct(study).alias("studies"), F.array_join(F.array_sort(F.collect_set(F.nullif("_trait", F.lit("")))), "; ").alias("traits"), F.countDistinct(paper).alias("papers"), F.min_by(F.nullif(allele, F.lit("")), F.when(F.coalesce(F.col(allele), F.lit("")) != "", F.col(order))).alias("risk_allele")
    )
    return out.where(F.col("studies") >= least)


def gene_levels(variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """The strongest of a gene's levels, on every variant of that gene."""
    names = F.array(*[F.lit(v) for v in CPIC_LEVELS])
    best = pairs.withColumn("_r", F.array_position(names, cpic_level("level"))).where("_r > 0").groupBy("gene").agg(F.min("_r").cast("int").alias("_r"))
    return variants.join(best, "gene", "left").withColumn("cpic_level", F.coalesce(F.get(names, F.col("_r") - 1), F.lit(""))).drop("_r")


def build_reference_table(clinvar: DataFrame, gwas: DataFrame, levels: DataFrame) -> DataFrame:
    """Layered merge by rsid: each source owns its columns, publications is the larger, the older risk allele stays."""
    a = clinvar.select("rsid", "gene", "clinical_sig", "review_stars", F.col("publications").alias("_pa"), F.col("risk_allele").alias("_ra"), F.lit("clinvar").alias("_sa"))
    b = gwas.select("rsid", "traits", "studies", F.col("papers").alias("_pb"), F.col("risk_allele").alias("_rb"), F.lit("gwas").alias("_sb"))
    out = a.join(b, "rsid", "full_outer")
    out = out.join(levels.select("gene", "level").distinct(), "gene", "left").withColumn("_sc", F.when(F.col("level").isNotNull(), "cpic"))
    return out.select(
        "rsid", "gene", "clinical_sig", F.coalesce("review_stars", F.lit(0)).alias("review_stars"), "traits", "studies", F.greatest(F.coalesce("_pa", F.lit(0)), F.coalesce("_pb", F.lit(0))).alias("publications"), F.coalesce(F.nullif("_ra", F.lit("")), "_rb").alias("risk_allele"),
        F.coalesce("level", F.lit("")).alias("cpic_level"), F.concat_ws("+", "_sa", "_sb", "_sc").alias("source"),
    )


def reference_meta(table: DataFrame) -> DataFrame:
    """Facts about a reference as key and value."""
    facts = table.agg(F.count(F.lit(1)).cast("string").alias("rows"), F.countDistinct("rsid").cast("string").alias("rsids"), F.countDistinct("gene").cast("string").alias("genes"), F.count_if(F.col("source").contains("clinvar")).cast("string").alias("clinvar"), F.count_if(F.col("source").contains("gwas")).cast("string").alias("gwas"), F.count_if(F.col("cpic_level") != "").cast("string").alias("with_level"))
    return facts.unpivot([], facts.columns, "key", "value")


def coverage_stats(meta: DataFrame) -> DataFrame:
    """Counts, versions and dates among ``meta(key, value)``, with ``number`` where the value is a whole number."""
    kept = meta.where(F.col("key").rlike("(_?rows|_?rsids|_version|_date)$") | (F.col("key") == "assembly"))
    return kept.select("key", "value", F.when(F.col("value").rlike(r"^\d+$"), F.col("value").cast("long")).alias("number"))


def refresh_reference(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Significance and conditions from the fresh rows where they have one; curated texts stay; ``updated`` says which."""
    new = fresh.select("rsid", F.nullif(F.trim("clinical_sig"), F.lit("")).alias("_s"), F.nullif(F.trim("conditions"), F.lit("")).alias("_c"))
    out = current.join(new, "rsid", "left")
    moved = F.coalesce(F.col("_s") != F.coalesce("clinical_sig", F.lit("")), F.lit(False)) | F.coalesce(F.col("_c") != F.coalesce("conditions", F.lit("")), F.lit(False))
    out = out.withColumn("updated", moved)
    return out.withColumns({"clinical_sig": F.coalesce("_s", "clinical_sig"), "conditions": F.coalesce("_c", "conditions")}).drop("_s", "_c")


def build_curated(rows: DataFrame, evidence: DataFrame, order: str) -> DataFrame:
    """The first row of each rsid with its evidence; levels outside the vocabulary are blanked."""
    w = W.partitionBy("rsid").orderBy(order)
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = first.join(evidence.select("rsid", F.col("cpic_level").alias("_l"), F.col("review_status").alias("_r"), F.col("publications").alias("_p")), "rsid", "left")
    return out.withColumns({"cpic_level": cpic_level("_l"), "review_stars": review_stars("_r"), "publications": F.coalesce("_p", F.lit(0))}).drop("_l", "_r", "_p")


def reference_summary(text) -> Column:
    """First sentence of a text, ended by a full stop."""
    first = F.trim(F.element_at(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\. "), 1))
    return F.when((first == "") | first.endswith("."), first).otherwise(F.concat(first, F.lit(".")))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile_definitions(local: DataFrame, external: DataFrame) -> DataFrame:
    """Per (gene, allele) of a local star-allele table against an external one.

    conflict, then missing positions, then ambiguous base codes, else confirmed; genes and alleles that the other
    table lacks are named as such.
    """
    ext = external.select("gene", "allele", "rsid", F.upper("base").alias("e_base"))
    genes = ext.select("gene").distinct().withColumn("_g", F.lit(True))
    alleles = ext.select("gene", "allele").distinct().withColumn("_a", F.lit(True))
    rows = local.join(genes, "gene", "left").join(alleles, ["gene", "allele"], "left").join(ext, ["gene", "allele", "rsid"], "left")
    concrete = F.col("e_base").isin("A", "C", "G", "T")
    out = rows.groupBy("gene", "allele").agg(F.bool_or(F.coalesce("_g", F.lit(False))).alias("g"), F.bool_or(F.coalesce("_a", F.lit(False))).alias("a"), F.count_if(concrete & (F.col("e_base") != F.upper("base"))).alias("conflicts"), F.count_if(F.col("e_base").isNull()).alias("missing"), F.count_if(F.col("e_base").isNotNull() & ~concrete).alias("ambiguous"))
    kind = F.when(~F.col("g"), "gene_not_fetched").when(~F.col("a"), "allele_not_in").when(F.col("conflicts") > 0, "conflict").when(F.col("missing") > 0, "rsid_not_in").when(F.col("ambiguous") > 0, "ambiguous").otherwise("confirmed")
    return out.select("gene", "allele", kind.alias("verdict"), "conflicts", "missing", "ambiguous")


def audit_markers(tree: DataFrame, records: DataFrame) -> DataFrame:
    """Lineage markers against variant records ``(rsid, ref, alts array)``."""
    rows = tree.where("coalesce(rsid, '') <> ''").join(records, "rsid", "left")
    have = F.array_distinct(F.concat(F.array(F.upper("ref")), F.transform("alts", F.upper)))
    want = F.array(F.upper("ancestral"), F.upper("derived"))
    flip = F.transform(want, lambda x: F.translate(x, "ACGT", "TGCA"))
    inside = lambda a: F.size(F.array_except(a, have)) == 0
    kind = F.when(F.col("ref").isNull(), "not_found").when(F.exists(have, lambda x: F.length(x) != 1), "class_error").when(inside(want), F.when(F.size(have) > 2, "multi_allelic").otherwise("consistent")).when(inside(flip), "strand").otherwise("conflict")
    state = F.when(F.upper("ref") == F.upper("derived"), "derived").when(F.upper("ref") == F.upper("ancestral"), "ancestral").otherwise("unknown")
    return rows.select("node", "rsid", kind.alias("verdict"), F.when(F.col("ref").isNotNull(), state).alias("reference_state"))
