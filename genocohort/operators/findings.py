"""Filters, sorts, pages, facets and summaries of findings, and their store (FL1-3, FL9, TK1-2, AG8-12, SNK1-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import chrom_order, normalize_contig, rsid_order
from ..functions.scoring import field, low

# Entities that frequency and publication limits don't touch.
EXEMPT = ("genoset", "trait", "prs")
# Text and list fields that a pattern is looked for in.
SEARCH_TEXTS = ("rsid", "gene", "summary", "interpretation", "conditions", "token", "genotype", "evidence", "clinical_sig", "criteria", "name", "aka")
SEARCH_LISTS = ("topics", "medicines", "conditions_list", "matched_rsids", "labels")
# Flags and fields of a search that come from frequency and score.
MADE = ("dubious", "flipped", "ambiguous", "mag", "freq")
OP_FIELDS = {"stars": "review_stars", "mag": "magnitude", "count": "count", "freq": "freq", "dr2": "dr2"}


def magnitude(df: DataFrame) -> Column:
    """Magnitude for filters and sorts, where null counts as 1."""
    return F.coalesce(field(df, "magnitude", "double"), F.lit(1.0))


def flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(field(df, name, "boolean"), F.lit(False))


def has_any(df: DataFrame, column: str, values) -> Column:
    wanted = F.array(*[F.lit(v.lower()) for v in values])
    return F.arrays_overlap(F.transform(F.coalesce(field(df, column, "array<string>"), F.array().cast("array<string>")), F.lower), wanted)


def meeting(df: DataFrame, tests: list[Column], made: list[Column]) -> DataFrame:
    """Rows that meet all ``tests`` and all tests ``made`` of frequency and score.

    The latter are one column of the rows, by ``explode``, before they are a filter: a filter alone goes below the score, where each column in it
    is replaced by what it is made of, at every place over again.
    """
    if tests:
        df = df.where(reduce(lambda a, b: a & b, tests))
    if made:
        df = df.withColumn("_met", F.explode(F.array(reduce(lambda a, b: a & b, made)))).where("_met").drop("_met")
    return df


def filter_findings(
    df: DataFrame, *, silo=None, entity_types=(), min_magnitude=None, max_magnitude=None, reputes=(), min_publications=None, max_publications=None, min_freq=None, max_freq=None, require_frequency=False,
    clinvar_only=False, clinvar_sig=(), min_stars=None, genes=(), topics=(), medicines=(), conditions=(), zygosities=(), carrier_only=False, conflicts_only=False, ambiguous_only=False,
) -> DataFrame:
    """Findings that meet every given predicate; one left out filters nothing."""
    entity = F.coalesce(field(df, "entity_type"), F.lit("snp"))
    mag, pubs, freq, code = magnitude(df), F.coalesce(field(df, "publications", "double"), F.lit(0.0)), field(df, "freq", "double"), field(df, "clinvar_sig_code", "int")
    tests: list[Column] = []
    made: list[Column] = []
    bound: list[Column] = []  # limits from which other entities are exempt
    if silo:
        tests.append(field(df, "silo").eqNullSafe(F.lit(silo)))
    if entity_types:
        tests.append(entity.isin(*entity_types))
    if min_magnitude is not None:
        made.append(mag >= min_magnitude)
    if max_magnitude is not None:
        made.append(mag <= max_magnitude)
    if reputes:
        known = F.lower(F.coalesce(field(df, "repute"), F.lit("")))
        made.append(F.when(known.isin("good", "bad"), known).otherwise("unset").isin(*[r.lower() for r in reputes]))
    if min_publications is not None:
        bound.append(pubs >= min_publications)
    if max_publications is not None:
        bound.append(pubs <= max_publications)
    if require_frequency:
        bound.append(freq.isNotNull())
    if min_freq is not None:
        bound.append(F.when(freq.isNull(), F.lit(min_freq <= 0)).otherwise(freq >= min_freq))
    if max_freq is not None:
        bound.append(freq.isNull() | (freq <= max_freq))
    if bound:
        made.append(entity.isin(*EXEMPT) | reduce(lambda a, b: a & b, bound))
    if clinvar_only:
        tests.append(code.isNotNull())
        clinvar_sig = clinvar_sig or (5, 4)
    if clinvar_sig:
        tests.append(F.coalesce(code.isin(*clinvar_sig), F.lit(False)))
    if min_stars is not None:
        tests.append(F.coalesce(field(df, "review_stars", "int"), F.lit(0)) >= min_stars)
    if genes:
        tests.append(F.upper(F.coalesce(field(df, "gene"), F.lit(""))).isin(*[g.upper() for g in genes]))
    if topics:
        tests.append(has_any(df, "topics", topics))
    if medicines:
        tests.append(has_any(df, "medicines", medicines))
    if conditions:
        tests.append(has_any(df, "conditions_list", conditions) | F.lower(F.coalesce(field(df, "conditions"), F.lit(""))).isin(*[c.lower() for c in conditions]))
    if zygosities:
        tests.append(low(field(df, "zygosity")).isin(*[z.lower() for z in zygosities]))
    if carrier_only:
        tests.append(flag(df, "carrier"))
    if conflicts_only:
        tests.append(flag(df, "conflict"))
    if ambiguous_only:
        made.append(flag(df, "ambiguous") | flag(df, "freq_ambiguous") | flag(df, "flipped"))
    return meeting(df, tests, made)


def compare(value: Column, operator: str, target: float) -> Column:
    test = {">=": value >= target, "<=": value <= target, ">": value > target, "<": value < target, "=": F.abs(value - target) < 1e-9}[operator]
    return F.coalesce(test, F.lit(False))  # an unknown value meets no comparison


def search_findings(df: DataFrame, flags=(), ops=(), sig_codes=(), region=None, pattern: str | None = None) -> DataFrame:
    """Findings by flags, comparisons ``(field, operator, value)``, a region ``(chrom, start, end)`` or else a pattern."""
    import re

    simple = {"dubious": flag(df, "dubious"), "flipped": flag(df, "flipped"), "ambiguous": flag(df, "ambiguous") | flag(df, "freq_ambiguous"), "conflict": flag(df, "conflict"), "carrier": flag(df, "carrier"), "nocall": low(field(df, "zygosity")) == "no_call", "imputed": flag(df, "imputed"), "typed": ~flag(df, "imputed"), "provisional": flag(df, "provisional")}
    tests, made = [simple[f] for f in flags if f not in MADE], [simple[f] for f in flags if f in MADE]
    for name, operator, value in ops:
        (made if name in MADE else tests).append(compare(magnitude(df) if name == "mag" else field(df, OP_FIELDS[name], "double").cast("double"), operator, value))
    if sig_codes:
        tests.append(F.coalesce(field(df, "clinvar_sig_code", "int").isin(*sig_codes), F.lit(False)))
    if region is not None:
        chrom, start, end = region
        tests.append(normalize_contig("chromosome") == chrom)
        if start is not None:
            tests.append(F.coalesce(F.col("position").between(start, end), F.lit(False)))
    elif pattern:
        try:
            re.compile(pattern)
        except re.error:
            pattern = re.escape(pattern)
        texts = [F.nullif(field(df, c), F.lit("")) for c in SEARCH_TEXTS if c in df.columns]
        lists = [F.array_join(c, " ") for c in SEARCH_LISTS if c in df.columns]
        made.append(F.concat_ws(" ", *texts, *lists).rlike(f"(?i){pattern}"))
    return meeting(df, tests, made)


def sort_columns(df: DataFrame, key: str = "magnitude", descending: bool = True) -> list[Column]:
    """Sort columns of one of ten keys (an unknown one is magnitude), with the row's identity to break ties."""
    number = lambda c, d: F.coalesce(field(df, c, "double").cast("double"), F.lit(d))
    keys = {
        "magnitude": [magnitude(df)], "frequency": [number("freq", -1.0)], "publications": [number("publications", -1.0)], "modified": [F.coalesce(field(df, "discovered_at"), F.lit(""))], "gmaf": [number("gmaf", -1.0)],
        "stars": [number("review_stars", -1.0)], "gene": [F.coalesce(F.nullif(field(df, "gene"), F.lit("")), F.lit("~"))], "coverage": [number("coverage", -1.0)],
    }
    if key == "location":
        found = [chrom_order(field(df, "chromosome")), number("position", 0.0)]
    elif key == "rsid":
        found = [rsid_order("rsid")]
    else:
        found = keys.get(key, keys["magnitude"])
    ends = [F.col(c).asc() for c in ("sample_id", "entity_type", "rsid") if c in df.columns]
    return [c.desc() if descending else c.asc() for c in found] + ends


def sort_findings(df: DataFrame, key: str = "magnitude", descending: bool = True) -> DataFrame:
    return df.orderBy(*sort_columns(df, key, descending))


def page(df: DataFrame, limit: int | None = 200, offset: int = 0, key: str = "magnitude", descending: bool = True) -> DataFrame:
    """A page of the sorted findings; no limit means all from the offset on."""
    out = sort_findings(df, key, descending)
    out = out.offset(max(0, offset)) if offset else out
    return out.limit(limit) if limit else out


def findings_by_silo(df: DataFrame, sample_id, silo: str | None = None) -> DataFrame:
    out = df.where(F.col("sample_id") == sample_id)
    return (out.where(F.col("silo") == silo) if silo else out).orderBy("silo", "gene", "rsid")


def qc_summary(findings: DataFrame, pooled: DataFrame) -> DataFrame:
    """Counts of doubtful readings per sample over single-position findings, with the pool's counts."""
    snp = findings.where("entity_type = 'snp'")
    q = snp.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(flag(snp, "freq_flipped")).alias("flipped"), F.count_if(flag(snp, "ambiguous") | flag(snp, "freq_ambiguous")).alias("ambiguous"), F.count_if(field(snp, "zygosity") == "no_call").alias("no_call"),
        F.count_if(flag(snp, "dubious")).alias("dubious"), F.count_if(field(snp, "variant_copies", "int") == 0).alias("non_carrier"),
    )
    p = pooled.groupBy("sample_id").agg(F.count(F.lit(1)).alias("positions"), F.count_if("conflict").alias("conflicts"))
    return p.join(q, "sample_id", "left").na.fill(0)


def ranges(findings: DataFrame) -> DataFrame:
    """Upper ends of the sliders; 10, 0 and 100 where nothing is known."""
    return findings.agg(F.coalesce(F.max("magnitude"), F.lit(10.0)).alias("max_magnitude"), F.coalesce(F.max(field(findings, "publications", "int")), F.lit(0)).cast("long").alias("max_publications"), F.coalesce(F.max(field(findings, "freq", "double")), F.lit(100.0)).alias("max_freq"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by silo, by entity type and by repute in one pass of grouping sets."""
    rep = F.when(F.col("repute").isin("Good", "Bad"), F.col("repute")).otherwise("unset")
    rows = findings.select(F.coalesce(F.nullif("silo", F.lit("")), F.lit("informational")).alias("silo"), F.coalesce("entity_type", F.lit("snp")).alias("entity_type"), rep.alias("repute"))
    out = rows.groupingSets([["silo"], ["entity_type"], ["repute"]], "silo", "entity_type", "repute").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "silo").when(F.col("g") == 5, "entity_type").otherwise("repute")
    return out.select(kind.alias("kind"), F.coalesce("silo", "entity_type", "repute").alias("value"), "n")


# Facet name to the column it counts.
FACETS = {"genes": "gene", "silos": "silo", "entity_types": "entity_type", "zygosity": "zygosity", "categories": "category", "clinvar_significance": "clinical_sig", "cpic_levels": "cpic_level", "freq_bands": "freq_band", "confidence": "confidence"}
LIST_FACETS = {"topics": "topics", "medicines": "medicines", "conditions": "conditions_list"}


def facets(findings: DataFrame) -> DataFrame:
    """Every filterable value with its count, from one exploded pass."""
    pair = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    rep = F.coalesce(F.nullif(field(findings, "repute"), F.lit("")), F.lit("Not Set"))
    single = [pair(name, field(findings, c).cast("string")) for name, c in FACETS.items()] + [pair("reputes", rep), pair("review_stars", field(findings, "review_stars", "int").cast("string"))]

    def each(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: pair(name, x))

    many = [each(name, field(findings, c, "array<string>")) for name, c in LIST_FACETS.items()]
    ill = F.when(field(findings, "clinvar_sig_code", "int").isNotNull(), F.coalesce(field(findings, "conditions_list", "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    many.append(each("clinvar_diseases", ill))
    rows = findings.select(F.explode(F.concat(F.array(*single), *many)).alias("x")).select("x.facet", F.trim("x.value").alias("value")).where("value <> ''")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def drug_groups(findings: DataFrame) -> DataFrame:
    """Findings of each medicine: how many, the best level and the highest magnitude, level A first."""
    from ..functions.scoring import CPIC_LEVELS, cpic_level

    rank = F.create_map(*[F.lit(x) for i, v in enumerate(CPIC_LEVELS) for x in (v, i)])[cpic_level("cpic_level")]
    rows = findings.select("sample_id", "rsid", F.explode(F.array_distinct("medicines")).alias("medicine"), rank.alias("rank"), magnitude(findings).alias("magnitude"))
    out = rows.groupBy("sample_id", "medicine").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.max("magnitude").alias("max_magnitude"))
    return out.withColumn("best_level", F.when(F.col("rank").isNull(), "").otherwise(F.get(F.array(*[F.lit(v) for v in CPIC_LEVELS]), F.col("rank")))).drop("rank")


def upsert_findings(target: DataFrame, fresh: DataFrame, key=("sample_id", "rsid")) -> DataFrame:
    """Fresh rows replace those of their key, but keep the older ``discovered_at``; the rest stays."""
    old = target.select(*key, F.col("discovered_at").alias("_since"))
    new = fresh.join(old, list(key), "left").withColumn("discovered_at", F.coalesce("_since", "discovered_at")).drop("_since")
    return target.join(fresh.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


EXPORT_COLUMNS = ("sample_id", "rsid", "entity_type", "gene", "chromosome", "position", "genotype", "zygosity", "magnitude", "repute", "confidence", "evidence", "clinical_sig", "review_stars", "cpic_level", "conditions_list", "topics", "medicines", "silo", "category", "freq", "freq_band", "freq_population", "publications", "variant_copies", "carrier", "conflict", "ambiguous", "interpretation")


def export_rows(df: DataFrame) -> DataFrame:
    """The fixed export columns as text: lists joined by ``; ``, booleans yes or no, null blank."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        kind = kinds.get(c)
        if kind is None:
            return F.lit("")
        if kind.startswith("array"):
            return F.coalesce(F.array_join(c, "; "), F.lit(""))
        if kind == "boolean":
            return F.when(F.col(c), "yes").when(~F.col(c), "no").otherwise("")
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(*[text(c).alias(c) for c in EXPORT_COLUMNS])


def export_findings(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the export as csv, tsv or json files."""
    rows = export_rows(df)
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        rows.write.mode("overwrite").option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)


def erase_samples(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the samples in ``ids(sample_id)``, ledger rows included."""
    return {name: df.join(ids.select("sample_id").distinct(), "sample_id", "left_anti") for name, df in tables.items()}
