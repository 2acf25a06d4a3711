"""The cohort scan as one lazy chain (PL1, PL2, PL5, ST2).

The order is part of the meaning: strand before frequency, frequency before score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score_findings
from ..operators import annotate as an
from ..operators import findings as fi
from ..operators import pool, prs, rules, traits


@dataclass
class References:
    """What a scan reads besides calls; ``tier2`` and ``overlay`` may be missing."""

    variants: DataFrame
    allele_freq: DataFrame
    tier2: DataFrame | None = None
    overlay: DataFrame | None = None
    gmaf: DataFrame | None = None


@dataclass
class Entities:
    """Rules, traits and polygenic models, whose findings join those of single positions."""

    rule_nodes: DataFrame
    rule_texts: DataFrame
    trait_tests: DataFrame
    traits: DataFrame
    weights: DataFrame

    def findings(self, pooled: DataFrame) -> list[DataFrame]:
        """Matched rules, traits with a called marker, and every model's score, of all samples of ``pooled``."""
        scores = prs.score_prs(pooled, self.weights, prs.prs_moments(self.weights))
        return [
            traits.rule_findings(rules.rule_coverage(pooled, self.rule_nodes), self.rule_texts), traits.trait_findings(rules.evaluate_traits(pooled, self.trait_tests, self.traits)), traits.prs_findings(scores),
        ]


def scan(calls: DataFrame, refs: References, population: str, relatives: DataFrame | None = None, extra: list[DataFrame] | Callable[[DataFrame], list[DataFrame]] | None = None, hold=lambda name, df: df.persist()) -> dict[str, DataFrame]:
    """pooled, findings, qc, ranges and summary of a cohort from kit calls with ``label`` and ``kit_ord``.

    ``extra`` are findings of other entities (rules, traits, scores), or what makes them of the pooled calls; they are united
    with the single-position ones.
    Two tables feed several results and are held: pooled and findings (``hold`` says how).
    """
    pooled = hold("pooled", pool.pool_calls(pool.dedupe_kit(calls, to_pool=True)))
    found = an.annotate_tiered(pooled, refs.variants, refs.tier2) if refs.tier2 is not None else an.annotate(pooled, refs.variants)
    found = an.finding_defaults(found)
    if relatives is not None:
        found = an.attach_calls(found, pooled, relatives)
    found = an.annotate_frequency(found, refs.allele_freq, population, refs.gmaf)
    if refs.overlay is not None:
        found = an.overlay_genotypes(found, refs.overlay)
    scored = score_findings(found)
    for other in (extra(pooled) if callable(extra) else extra or []):
        scored = scored.unionByName(other, allowMissingColumns=True)
    scored = hold("findings", scored)
    return {"pooled": pooled, "findings": scored, "qc": fi.qc_summary(scored, pooled), "ranges": fi.ranges(scored), "summary": fi.summary(scored)}


FREQUENCY_COLUMNS = ("freq", "freq_method", "freq_queried", "freq_population", "freq_derived", "freq_band", "freq_flipped", "freq_ambiguous", "gmaf", "minor_allele")
SCORE_COLUMNS = ("magnitude", "magnitude_base", "magnitude_factors", "magnitude_source", "repute", "confidence", "evidence", "evidence_key", "dubious")


def rescore(findings: DataFrame, allele_freq: DataFrame, population: str, gmaf: DataFrame | None = None) -> DataFrame:
    """Frequency and score of stored findings for another population, without a new scan."""
    bare = findings.drop(*FREQUENCY_COLUMNS, *SCORE_COLUMNS)
    return score_findings(an.annotate_frequency(bare, allele_freq, population, gmaf))


def lookup(rsids: list[str], variants: DataFrame, allele_freq: DataFrame) -> DataFrame:
    """What the references say about some rsids, their frequencies as one text."""
    wanted = [r.strip().lower() for r in rsids]
    freq = allele_freq.where(F.col("rsid").isin(*wanted)).groupBy("rsid").agg(F.array_join(F.array_sort(F.collect_list(F.concat("pop", F.lit(":"), "allele", F.lit("="), F.format_string("%.2f", "freq")))), " ").alias("frequencies"))
    return variants.where(F.col("rsid").isin(*wanted)).join(freq, "rsid", "left")
