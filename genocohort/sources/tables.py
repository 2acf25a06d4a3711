"""Maps, chains, annotation and panel tables (SRC9-SRC17, SRC19-SRC21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.alleles import normalize_contig
from ..functions.population import to_log_beta
from .lines import read_lines, read_numbered, read_table

# Names that the wanted columns go by.
CLINVAR = {"rsid": ("RS# (dbSNP)", "rsid"), "gene": ("GeneSymbol", "Symbol"), "clinical_sig": ("ClinicalSignificance", "GermlineClassification"), "review_status": ("ReviewStatus", "GermlineReviewStatus"), "assembly": ("Assembly",), "chromosome": ("Chromosome",), "position": ("PositionVCF",), "conditions": ("PhenotypeList",)}
GWAS = {"rsids": ("SNPS",), "mlog": ("PVALUE_MLOG",), "study": ("STUDY ACCESSION", "STUDY_ACCESSION"), "trait": ("MAPPED_TRAIT", "DISEASE/TRAIT"), "risk": ("STRONGEST SNP-RISK ALLELE",), "ci_text": ("95% CI (TEXT)",), "pubmed": ("PUBMEDID",)}
CALLERS = {
    "yleaf": {"sample": ("sample_name", "sample", "sampleid", "id"), "haplogroup": ("hg", "haplogroup", "predicted_haplogroup", "hg_prediction"), "quality": ("hg_marker", "qc-score", "score", "quality")},
    "haplogrep": {"sample": ("sampleid", "sample_id", "sample"), "haplogroup": ("haplogroup", "hg"), "quality": ("quality", "rank")}, "cladefinder": {"sample": ("sample", "sampleid", "id"), "haplogroup": ("clade", "haplogroup", "hg", "result"), "quality": ("score", "confidence")},
}
SCORING = {"rsid": ("rsid", "hm_rsid", "snp"), "effect_allele": ("effect_allele", "a1"), "other_allele": ("other_allele", "reference_allele", "hm_inferotherallele"), "weight": ("effect_weight", "weight", "beta")}
NON_ADDITIVE = ("is_dominant", "is_recessive", "is_interaction")
PERMITTED = ("gene", "drug", "level")
PHASE3, POOLED = "1000GENOMES:phase_3:", "ALL"
KEEP_SIG = ("pathogenic", "likely pathogenic", "pathogenic/likely pathogenic", "drug response", "risk factor", "protective", "pathogenic, low penetrance", "likely pathogenic, low penetrance")


def cells(line: str | Column = "line") -> Column:
    return F.split(F.trim(line), r"\s+")


def read_genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, bp, cm`` of map rows (chrom, marker, cM, bp); rows that don't parse are skipped."""
    f = cells()
    rows = read_lines(spark, path).select(f.alias("f")).where("size(f) >= 4")
    return rows.select(normalize_contig(F.col("f")[0], numeric_sex=True).alias("chrom"), F.col("f")[3].try_cast("long").alias("bp"), F.col("f")[2].try_cast("double").alias("cm")).where("bp is not null and cm is not null")


def parse_chain_blocks(numbered: DataFrame) -> DataFrame:
    """Blocks of chain files with their absolute intervals, from ``file, n, line``.

    A chain's blocks follow its header, so a running sum within the chain gives each one's start.
    """
    w = W.partitionBy("file").orderBy("n")
    f = cells()
    rows = numbered.withColumns({"f": f, "is_head": F.col("line").startswith("chain")}).withColumn("chain_no", F.sum(F.col("is_head").cast("int")).over(w)).where("chain_no > 0 and line not like '#%'")
    head = rows.where("is_head").select("file", "chain_no", *[F.col("f")[i].alias(c) if c in ("t", "q", "strand", "cid") else F.col("f")[i].cast("long").alias(c) for i, c in ((1, "score"), (2, "t"), (5, "t0"), (7, "q"), (8, "q_size"), (9, "strand"), (10, "q0"))], F.get("f", F.lit(12)).alias("cid"))
    body = rows.where("not is_head").select("file", "chain_no", "n", F.col("f")[0].cast("long").alias("size"), F.coalesce(F.get("f", F.lit(1)).cast("long"), F.lit(0)).alias("dt"), F.coalesce(F.get("f", F.lit(2)).cast("long"), F.lit(0)).alias("dq"))
    before = W.partitionBy("file", "chain_no").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    body = body.withColumns({"t_off": F.coalesce(F.sum(F.col("size") + F.col("dt")).over(before), F.lit(0)), "q_off": F.coalesce(F.sum(F.col("size") + F.col("dq")).over(before), F.lit(0))})
    out = body.join(head, ["file", "chain_no"])
    return out.select(normalize_contig("t").alias("chrom"), F.col("chain_no").alias("chain_id"), (F.col("t0") + F.col("t_off")).alias("t_start"), (F.col("t0") + F.col("t_off") + F.col("size")).alias("t_end"), normalize_contig("q").alias("q_chrom"), (F.col("q0") + F.col("q_off")).alias("q_start"), "q_size", "strand", "score")


def read_chain_blocks(spark: SparkSession, path: str) -> DataFrame:
    return parse_chain_blocks(read_numbered(spark, path))


def read_clinvar_summary(spark: SparkSession, path: str) -> DataFrame:
    """GRCh37 rows with an rsid; ``na``, ``NA``, ``-`` and ``NULL`` are null."""
    rows = read_table(spark, path, CLINVAR, ("rsid", "assembly", "clinical_sig", "review_status"))
    rows = rows.select(*[F.when(~F.col(c).isin("na", "NA", "-", "NULL"), F.col(c)).alias(c) for c in rows.columns])
    return rows.where("assembly = 'GRCh37' and rsid is not null and rsid <> '-1'").withColumns({"rsid": F.concat(F.lit("rs"), F.regexp_replace("rsid", "^rs", "")), "position": F.col("position").try_cast("long")})


def gwas_direction(text: Column) -> Column:
    x = F.lower(F.coalesce(text, F.lit("")))
    return F.when(x.rlike("decrease|lower|reduc"), "decrease").when(x.rlike("increase|higher"), "increase").otherwise("")


def gwas_risk_allele(cell: Column) -> Column:
    letter = F.upper(F.trim(F.regexp_extract(cell, r"-([^-]*)$", 1)))
    return F.when(letter.rlike("^[ACGT]+$"), letter).otherwise("")


def gwas_rsids(cell: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(F.lower(cell), r" x |,| ", ";"), ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"^rs\d+$"))


def read_gwas_associations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each association and rsid, with direction and risk allele."""
    rows = read_table(spark, path, GWAS, ("rsids", "mlog", "study"))
    return rows.select(F.explode(gwas_rsids(F.col("rsids"))).alias("rsid"), F.col("mlog").try_cast("double").alias("mlog"), "study", "trait", gwas_direction(F.col("ci_text")).alias("direction"), gwas_risk_allele(F.col("risk")).alias("risk_allele"), "pubmed")


def read_gene_drug_levels(spark: SparkSession, path: str) -> DataFrame:
    """``gene, drug, level`` pairs; a file with any other column is refused."""
    raw = spark.read.json(path)
    odd = sorted(set(raw.columns) - set(PERMITTED))
    if odd:
        raise ValueError(f"columns that may not enter: {', '.join(odd)}")
    return raw.select(*PERMITTED)


def parse_scoring(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(additive variants, counts per file) of scoring files, from ``file, n, line``.

    ``#key=value`` lines give the weight's kind; columns are found by name; dominant, recessive and interaction rows are
    refused and rows without rsid, allele or weight skipped, both counted.
    """
    meta = F.regexp_extract("line", r"^#+\s*weight_type\s*=\s*(.*)$", 1)
    body = numbered.where("line not like '#%'")
    first = body.groupBy("file").agg(F.min(F.struct("n", "line")).alias("h")).select("file", F.col("h.n").alias("h_n"), F.transform(F.split(F.lower("h.line"), "\t"), lambda x: F.trim(x)).alias("names"))
    kind = numbered.groupBy("file").agg(F.max(meta).alias("kind"))
    rows = body.join(first.join(kind, "file"), "file").where("n > h_n").withColumn("f", F.transform(F.split("line", "\t"), lambda x: F.trim(x)))  # one row for each file
    at = lambda names: F.coalesce(*[F.get("f", F.array_position("names", n).cast("int") - 1) for n in names])
    flag = F.coalesce(*[F.when(F.lower(at((n,))).isin("true", "1", "yes", "t", "y"), True) for n in NON_ADDITIVE], F.lit(False))
    rows = rows.select("file", flag.alias("refused"), F.lower(at(SCORING["rsid"])).alias("rsid"), F.upper(at(SCORING["effect_allele"])).alias("effect_allele"), F.coalesce(F.upper(at(SCORING["other_allele"])), F.lit("")).alias("other_allele"), to_log_beta(at(SCORING["weight"]).try_cast("double"), "kind").alias("weight"))
    ok = F.coalesce(F.col("rsid").startswith("rs") & (F.col("effect_allele") != "") & F.col("weight").isNotNull(), F.lit(False))
    rows = rows.withColumn("usable", ok)
    counts = rows.groupBy("file").agg(F.count_if(~F.col("refused") & F.col("usable")).alias("variants"), F.count_if("refused").alias("non_additive_refused"), F.count_if(~F.col("refused") & ~F.col("usable")).alias("unusable_skipped"))
    return rows.where("not refused and usable").drop("refused", "usable"), counts


def read_scoring_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_scoring(read_numbered(spark, path))


def read_panel_labels(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, pop, superpop`` from whitespace or comma tables, columns by name."""
    rows = read_numbered(spark, path).where("line not like '#%'")
    split = F.when(F.col("line").contains(","), F.split("line", ",")).otherwise(cells())
    rows = rows.withColumn("f", F.transform(split, lambda x: F.trim(F.regexp_replace(x, '"', ""))))
    head = rows.groupBy("file").agg(F.min(F.struct("n", "f")).alias("h")).select("file", F.col("h.n").alias("h_n"), F.transform("h.f", F.lower).alias("names"))
    rows = rows.join(head, "file").where("n > h_n")  # one row for each file
    at = lambda *names: F.coalesce(*[F.get("f", F.array_position("names", n).cast("int") - 1) for n in names])
    out = rows.select(at("sample", "sample_id", "sampleid", "sample id", "id").alias("sample_id"), F.regexp_replace(F.upper(at("pop", "population", "population id")), " ", "_").alias("pop"), F.coalesce(F.upper(at("super_pop", "superpop", "super_population", "region")), F.lit("UNKNOWN")).alias("superpop"))
    return out.where("sample_id <> '' and pop <> ''")


ANNOTATION = "struct<dbsnp:struct<gene:variant,alt:variant>,clinvar:struct<rcv:variant>>"


def one_or_many(json: Column) -> Column:
    """A JSON value as an array of JSON texts: an array's items, or the value alone."""
    text = F.trim(json)
    many = F.from_json(text, "array<string>")
    return F.when(text.startswith("["), many).when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.array(text))


def flatten_annotation_json(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """Annotation hits as rows: first gene symbol and one row for each kept significance.

    ``dbsnp.gene`` and ``clinvar.rcv`` may be an object or a list; condition names are joined by ``; ``.
    """
    j = F.col(json_col)
    gene = F.get_json_object(F.get(one_or_many(F.get_json_object(j, "$.dbsnp.gene")), F.lit(0)), "$.symbol")
    rows = df.select(F.col(id_col), gene.alias("gene"), F.explode_outer(one_or_many(F.get_json_object(j, "$.clinvar.rcv"))).alias("rcv"))
    sig = F.lower(F.get_json_object("rcv", "$.clinical_significance"))
    names = F.transform(one_or_many(F.get_json_object("rcv", "$.conditions")), lambda c: F.get_json_object(c, "$.name"))
    return rows.select(F.col(id_col), F.coalesce("gene", F.lit("")).alias("gene"), sig.alias("clinical_sig"), F.array_join(names, "; ").alias("conditions")).where(F.col("clinical_sig").isin(*KEEP_SIG))


POPULATIONS = "array<struct<population:string,allele:string,frequency:double,allele_count:double>>"


def flatten_population_json(df: DataFrame, json_col: str, id_col: str, codes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(allele frequencies of the named populations with n, pooled frequencies) of nested population rows."""
    rows = df.select(F.col(id_col).alias("rsid"), F.explode(F.from_json(F.get_json_object(json_col, "$.populations"), POPULATIONS)).alias("p")).select("rsid", "p.*")
    code = F.when(F.col("population").startswith(PHASE3), F.upper(F.substring("population", len(PHASE3) + 1, 100)))
    rows = rows.where("frequency is not null and trim(allele) <> ''").select("rsid", code.alias("pop"), F.upper(F.trim("allele")).alias("allele"), F.round("frequency", 6).alias("freq"), "allele_count")
    pooled = rows.where(F.col("pop") == POOLED).select("rsid", "allele", "freq")
    named = rows.where(F.col("pop").isin(*codes))
    n = named.groupBy("rsid", "pop").agg(F.floor(F.sum(F.greatest(F.coalesce("allele_count", F.lit(0.0)), F.lit(0.0))) / 2).cast("long").alias("n"))
    return named.drop("allele_count").join(n, ["rsid", "pop"]), pooled


def read_q_matrix(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """A proportion matrix in long form ``row, pop, proportion``; text that is no number or a ragged row is an error."""
    rows = read_numbered(spark, path).where("trim(line) <> '' and line not like '#%'").withColumn("f", F.transform(cells(), lambda x: x.try_cast("double")))
    bad = rows.agg(F.count_if(F.size("f") != len(labels)).alias("ragged"), F.count_if(F.exists("f", lambda x: x.isNull())).alias("odd")).first()
    if bad["ragged"] or bad["odd"]:
        raise ValueError(f"{bad['ragged']} ragged rows, {bad['odd']} with text that is no number")
    order = F.row_number().over(W.partitionBy("file").orderBy("n"))
    return rows.withColumn("row", order).select("row", F.posexplode("f").alias("k", "proportion")).select("row", F.get(F.array(*[F.lit(x) for x in labels]), F.col("k")).alias("pop"), "proportion")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Shared segments written by a tool; rows with fewer than nine cells or odd numbers are skipped."""
    rows = read_lines(spark, path).where("line not like '#%'").select(cells().alias("f")).where("size(f) >= 9")
    n = lambda i, t: F.get("f", F.lit(i)).try_cast("double").cast(t)
    out = rows.select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), normalize_contig(F.col("f")[2], numeric_sex=True).alias("chrom"), n(3, "long").alias("start_bp"), n(4, "long").alias("end_bp"), F.col("f")[5].alias("ibd_type"), F.round(n(8, "double"), 4).alias("cm"), F.coalesce(n(9, "int"), F.lit(0)).alias("snps"))
    return out.where("start_bp is not null and end_bp is not null and cm is not null")


def read_caller_tables(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """The first usable row of each sample in a lineage caller's table; ``?`` is no call."""
    names = CALLERS[tool]
    rows = read_numbered(spark, path).where("ltrim(line) not like '#%'")
    f = F.transform(F.when(F.col("line").contains("\t"), F.split("line", "\t")).otherwise(cells()), lambda x: F.trim(x))
    rows = rows.withColumn("f", f)
    head = rows.groupBy("file").agg(F.min(F.struct("n", "f")).alias("h")).select("file", F.col("h.n").alias("h_n"), F.transform("h.f", F.lower).alias("names"))
    rows = rows.join(head, "file").where("n > h_n")  # one row for each file
    pick = lambda key: F.coalesce(*[F.nullif(F.get("f", F.array_position("names", x).cast("int") - 1), F.lit("")) for x in names[key]])
    rows = rows.select("file", "n", pick("sample").alias("sample_id"), F.nullif(pick("haplogroup"), F.lit("?")).alias("haplogroup"), pick("quality").alias("quality")).where("haplogroup is not null")
    w = W.partitionBy("sample_id").orderBy("file", "n")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("sample_id", "haplogroup", "quality")


# How a second source names its global row, and the order in which its tables are preferred.
SECOND_PREFIX, SECOND_GLOBAL, SECOND_FIRST = "gnomad", ":ALL", ("gnomADg:ALL", "gnomADe:ALL")


def global_minor(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """``rsid, minor_allele, gmaf, gmaf_source``: as stated, else from the pooled row of the first source.

    Of pooled alleles the rarest is the minor one, the first by alphabet at a tie; a single pooled allele tells nothing.
    """
    stated = df.select(F.col(id_col).alias("rsid"), F.nullif(F.upper(F.trim(F.coalesce(F.get_json_object(json_col, "$.minor_allele"), F.lit("")))), F.lit("")).alias("said"), F.round(F.get_json_object(json_col, "$.MAF").try_cast("double"), 6).alias("maf"))
    _, pooled = flatten_population_json(df, json_col, id_col, ())
    low = pooled.groupBy("rsid", "allele").agg(F.min("freq").alias("freq")).groupBy("rsid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("freq", "allele")).alias("low")).where("n > 1")
    rows = stated.join(low, "rsid", "left")
    whole = F.col("said").isNotNull() & F.col("maf").isNotNull()
    return rows.select("rsid", F.coalesce("said", "low.allele").alias("minor_allele"), F.coalesce("maf", "low.freq").alias("gmaf"), F.when(whole, "stated").when(F.col("low").isNotNull(), "pooled").alias("gmaf_source"))


def cross_check(df: DataFrame, json_col: str, id_col: str, tolerance: float = 0.05) -> DataFrame:
    """The minor allele's frequency beside that of a second source, which it never replaces.

    Of the second source's global tables that list the allele, the preferred one counts: genomes, exomes, then any other by name.
    ``agreement`` is agree or differ by ``tolerance``, or unchecked where either has no figure.
    """
    rows = df.select(F.col(id_col).alias("rsid"), F.explode(F.from_json(F.get_json_object(json_col, "$.populations"), POPULATIONS)).alias("p")).select("rsid", "p.*")
    other = rows.where(F.lower("population").startswith(SECOND_PREFIX) & F.upper("population").endswith(SECOND_GLOBAL) & F.col("frequency").isNotNull())
    rank = F.array_position(F.array(*[F.lit(x) for x in SECOND_FIRST]), F.col("population"))
    rank = F.when(rank == 0, len(SECOND_FIRST) + 1).otherwise(rank)
    other = other.select("rsid", F.upper(F.trim("allele")).alias("minor_allele"), F.struct(rank.alias("rank"), "population", F.round("frequency", 6).alias("freq")).alias("o"))
    best = other.groupBy("rsid", "minor_allele").agg(F.min("o").alias("o"))
    out = global_minor(df, json_col, id_col).join(best, ["rsid", "minor_allele"], "left")
    apart = F.round(F.abs(F.col("gmaf") - F.col("o.freq")), 6)
    return out.select("rsid", "minor_allele", "gmaf", "gmaf_source", F.col("o.population").alias("second_source"), F.col("o.freq").alias("second_freq"), apart.alias("difference"), F.when(apart.isNull(), "unchecked").when(apart <= tolerance, "agree").otherwise("differ").alias("agreement"))
