"""Imputed genotypes: caps, reports, violations (SC24, AG28, AG29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.population import max_imputed_magnitude, quality_band
from ..functions.scoring import field

THRESHOLD = 0.80


def is_imputed(df: DataFrame):
    """``imputed`` if it is said, else whether a quality is given."""
    return F.coalesce(field(df, "imputed", "boolean"), field(df, "dr2", "double").isNotNull())


def apply_imputation_cap(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Hold imputed findings to what their quality allows; typed ones are untouched."""
    imputed, dr2 = is_imputed(df), field(df, "dr2", "double")
    cap = max_imputed_magnitude(dr2, threshold)
    band = quality_band(dr2)
    weak = imputed & ~band.isin("high", "moderate")
    trail = "array<struct<step:string,operand:double,score:double>>"
    step = F.struct(F.lit("imputed_cap").alias("step"), cap.cast("double").alias("operand"), F.least(F.col("magnitude"), cap).cast("double").alias("score"))
    steps = F.coalesce(field(df, "magnitude_factors", trail), F.array().cast(trail))
    return df.withColumns({
        "magnitude": F.when(imputed, F.least(F.col("magnitude"), cap)).otherwise(F.col("magnitude")), "dubious": F.coalesce(field(df, "dubious", "boolean"), F.lit(False)) | weak, "imputation_capped": imputed & F.coalesce(F.col("magnitude") > cap, F.lit(False)),
        "magnitude_factors": F.when(imputed, F.array_append(steps, step)).otherwise(steps), "quality_band": F.when(imputed, band),
    })


def imputation_report(variants: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts by origin, quality and rarity per sample, with the mean and exact median of the quality."""
    imp = is_imputed(variants)
    d = F.when(imp, F.col("dr2"))
    rare = imp & (F.col("maf") < 0.01)
    return variants.groupBy("sample_id").agg(
        F.count_if(~imp).alias("typed"), F.count_if(imp).alias("imputed"), F.count_if(d >= threshold).alias("above"), F.count_if(d < threshold).alias("below"), F.count_if(imp & d.isNull()).alias("unknown"), *[F.count_if(imp & (quality_band("dr2") == b)).alias(f"band_{b}") for b in ("high", "moderate", "low", "unusable", "unknown")],
        F.round(F.avg(d), 4).alias("mean_dr2"), F.percentile(d, 0.5).alias("median_dr2"), F.count_if(rare).alias("rare"), F.count_if(rare & (d >= threshold)).alias("rare_above"),
    )


def imputation_violations(findings: DataFrame, threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """Imputed findings called pathogenic without the quality for it, with every reason; ``strict`` raises if there is one."""
    d = field(findings, "dr2", "double")
    reasons = F.concat_ws("; ", F.when(d.isNull(), "no quality"), F.when(d < threshold, "quality below the threshold"), F.when(quality_band(d).isin("low", "unusable"), "untrusted band"), F.when(field(findings, "imputation_capped", "boolean").isNull(), "cap never ran"))
    rows = findings.where(is_imputed(findings) & F.coalesce(F.col("clinvar_sig_code").isin(4, 5), F.lit(False))).withColumn("reasons", reasons).where("reasons <> ''")
    if strict and (n := rows.count()):
        raise ValueError(f"{n} imputed pathogenic findings without quality")
    return rows
