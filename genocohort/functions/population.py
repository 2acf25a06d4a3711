"""Population arithmetic on frequencies, doses, tails and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alleles import C, lookup


def rarity_band(percent) -> Column:
    p = C(percent)
    return F.when(p.isNull(), "unknown").when(p < 1, "very_rare").when(p < 5, "rare").when(p < 20, "uncommon").when(p <= 50, "common").otherwise("majority")


def hardy_weinberg(p, q, homozygous) -> Column:
    """Expected percent of a genotype with allele frequencies p and q, to 2 places."""
    return F.round(F.when(homozygous, C(p) * C(p)).otherwise(2.0 * C(p) * C(q)) * 100.0, 2)


def quality_band(dr2) -> Column:
    x = C(dr2)
    return F.when(x.isNull(), "unknown").when(x >= 0.90, "high").when(x >= 0.80, "moderate").when(x >= 0.30, "low").otherwise("unusable")


def max_imputed_magnitude(dr2, threshold: float = 0.80) -> Column:
    """What an imputed finding's magnitude may reach: 9.5 at the threshold or above, else 3.0."""
    return F.when(C(dr2) >= threshold, 9.5).otherwise(3.0)


def normal_cdf(z) -> Column:
    """Standard normal distribution function; Chebyshev fit of erfc, relative error under 1.2e-7."""
    x = C(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    tail = t * F.exp(fit - x * x)
    return 0.5 * F.when(x >= 0, 2.0 - tail).otherwise(tail)


def percentile_from_z(z) -> Column:
    return F.round(normal_cdf(z) * 100.0, 1)


def inverse_normal_cdf(p) -> Column:
    """Quantile of the standard normal distribution: rational fit, then one Newton step on normal_cdf."""
    x = C(p)
    low = F.sqrt(-2.0 * F.ln(F.least(x, 1 - x)))
    fit = low - (2.515517 + low * (0.802853 + low * 0.010328)) / (1.0 + low * (1.432788 + low * (0.189269 + low * 0.001308)))
    guess = F.when(x < 0.5, -fit).otherwise(fit)
    return F.when((x > 0) & (x < 1), guess - (normal_cdf(guess) - x) * math.sqrt(2 * math.pi) * F.exp(guess * guess / 2))


def prs_band(percentile) -> Column:
    p = C(percentile)
    return F.when(p.isNull(), "unknown").when(p < 10, "low").when(p < 30, "below_average").when(p <= 70, "average").when(p <= 90, "above_average").otherwise("high")


def wilson_interval(p, n, z: float = 1.959963984540054) -> Column:
    """Score interval of a proportion as a struct (low, high), to 6 places; (0, 1) without observations."""
    p, n = C(p), C(n).cast("double")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct(F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - half), 6)).otherwise(0.0).alias("low"), F.when(n > 0, F.round(F.least(F.lit(1.0), centre + half), 6)).otherwise(1.0).alias("high"))


def as_fraction(p, most: int = 1_000_000) -> Column:
    """``1 in N`` for a probability, '' for none."""
    x = C(p)
    n = F.round(1.0 / F.when(x > 0, x)).cast("long")
    return F.when(x.isNull(), "").when(x <= 0, "0").when(x >= 1, "1 in 1").when(n > most, f"below 1 in {most}").otherwise(F.concat(F.lit("1 in "), n.cast("string")))


def residual_risk(frequency, detection, tested) -> Column:
    """Chance of being a carrier after a negative test: f(1-d)/(1-fd); nothing tested means d = 0."""
    f, d = C(frequency), F.when(C(tested), C(detection)).otherwise(0.0)
    return F.when(f.isNotNull() & d.isNotNull() & (f * d < 1), f * (1 - d) / (1 - f * d))


# Kinds of weight that are ratios, and logs of another base.
RATIOS = ("or", "odds_ratio", "oddsratio", "hr", "hazard_ratio", "hazardratio", "rr", "risk_ratio")
LOG_SCALES = {"log2(or)": math.log(2), "log2or": math.log(2), "log2(hr)": math.log(2), "log10(or)": math.log(10), "log10or": math.log(10), "log10(hr)": math.log(10)}


def to_log_beta(weight, kind) -> Column:
    """Effect as a natural log: ratios are logged, logs of base 2 and 10 rescaled, the rest kept."""
    w, k = C(weight), F.regexp_replace(F.lower(F.coalesce(C(kind), F.lit(""))), " ", "")
    return F.when(k.isin(*RATIOS), F.when(w > 0, F.ln(w))).otherwise(w * F.coalesce(lookup(k, LOG_SCALES), F.lit(1.0)))


def x_log_x(x) -> Column:
    return F.when(C(x) > 0, C(x) * F.ln(C(x))).otherwise(0.0)
