"""What must be said beside a result, with the row's own coverage (SC34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand beside every polygenic score and every imputation run, before the sentence on coverage.
SCORE_CAVEATS = (
    "A polygenic score ranks people within a population; it neither finds nor rules out a disease.",
    "A high score can go with lifelong health and a low one with disease.",
    "Scores carry over poorly to people whose ancestry differs from that of the study behind them.",
)
IMPUTATION_CAVEATS = (
    "Imputed genotypes are predicted from typed neighbours; no assay has read them.",
    "Reference panels hold few people of most ancestries, and both the calls and their quality figures are worse for those left out.",
    "Predictions of variants below 1 percent frequency are often wrong, however good the run is as a whole.",
    "Confirm any imputed call by a clinical assay of that position before acting on it.",
)


def fixed(texts: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def tenths(x: Column) -> Column:
    """A number from 0 to 1e12 as text with one decimal, rounded by its exact binary value and half to even, as C and Python do."""
    # 20 x as a sum of exact parts and its exact rounding error: x is half way between two tenths where this is odd
    a, b = x * 16.0, x * 4.0
    s = a + b
    error = b - (s - a)
    low = F.floor(s / 2.0)
    over = s - low * 2.0
    up = (over > 1.0) | ((over == 1.0) & ((error > 0.0) | ((error == 0.0) & (low % 2 == 1))))
    n = low + up.cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def attach_score_caveats(scores: DataFrame) -> DataFrame:
    """Add ``caveats`` to rows with ``coverage`` (0 to 1; null counts as none)."""
    said = F.format_string("This score used %s percent of its variants.", tenths(F.coalesce("coverage", F.lit(0.0)) * 100))
    return scores.withColumn("caveats", F.array_append(fixed(SCORE_CAVEATS), said))


def attach_imputation_caveats(reports: DataFrame, threshold: float = 0.80, note: str = "") -> DataFrame:
    """Add ``caveats`` to rows with ``imputed`` and ``above`` counts; a panel's own ``note`` comes last."""
    share = F.when(F.col("imputed") > 0, F.col("above") * 100 / F.col("imputed")).otherwise(0.0)
    said = F.format_string(f"%d of %d imputed variants (%s percent) have a quality of {threshold:.2f} or more.", F.col("above"), F.col("imputed"), tenths(share))
    out = F.array_append(fixed(IMPUTATION_CAVEATS), said)
    return reports.withColumn("caveats", F.array_append(out, F.lit(note)) if note else out)
