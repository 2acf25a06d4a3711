"""Registered queries of the readers: rows of the cohort are written as files of each format and read again.

The files lie in the folder that all executors share, so that the readers' work is spread and grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import new_folder
from ..sources import arrays, lines, tables, vcf
from ..streaming import ingest
from .queries import query


def shared(c, name: str) -> str:
    """A new path in the folder that all executors share, deleted at the end."""
    return new_folder(c.spark, name)


def write_files(rows: DataFrame, by: list[str], path: str) -> str:
    """One file for each value of ``by`` with the lines ``value`` in the order of ``k``.

    Rows are dealt by a hash of ``by``: a union whose sides are dealt by ``by`` itself counts as dealt so, but hands on each side's
    partitions apart, and a file would come in two.
    """
    rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, "k").select(*by, "value").write.partitionBy(*by).text(path)
    return path


def from_path(name: str, kind: str = "long") -> Column:
    return F.regexp_extract("file", f"{name}=([^/]+)", 1).cast(kind)


def tabbed(*cells) -> Column:
    return F.concat_ws("\t", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in cells])


# --- vendor exports -----------------------------------------------------------------------------


def exports(c) -> str:
    """Each kit as its vendor writes it: single column, split alleles, quoted comma file."""
    kit, no = F.col("kit"), F.col("allele1") == "N"
    gt = F.when(no, "--").otherwise(F.concat("allele1", "allele2"))
    split = tabbed("rsid", "chrom_no", "position", F.when(no, "0").otherwise(F.col("allele1")), F.when(no, "0").otherwise(F.col("allele2")))
    quoted = F.concat(F.lit('"'), F.concat_ws('","', "rsid", F.col("chrom_no").cast("string"), F.col("position").cast("string"), gt), F.lit('"'))
    value = F.when(kit == "kit0", tabbed("rsid", "chrom_no", "position", gt)).when(kit == "kit1", split).otherwise(quoted)
    heads = {"kit0": ["# This data file was generated by 23andMe", "# rsid\tchromosome\tposition\tgenotype"], "kit1": ["#AncestryDNA raw data download", "rsid\tchromosome\tposition\tallele1\tallele2"], "kit2": ["# MyHeritage DNA raw data", "RSID,CHROMOSOME,POSITION,RESULT"]}
    head = F.create_map(*[x for k, v in heads.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[kit]
    calls = c.view("fx_calls")
    rows = calls.select("sample_id", "kit", F.lit(1).alias("k"), value.alias("value"))
    return write_files(rows.unionByName(calls.select("sample_id", "kit").distinct().select("sample_id", "kit", F.lit(0).alias("k"), F.explode(head).alias("value"))), ["sample_id", "kit"], shared(c, "arrays"))


READ_CALLS = "SELECT sample_id, CASE kit WHEN 'kit0' THEN '23andme' WHEN 'kit1' THEN 'ancestrydna' ELSE 'myheritage' END AS provider, rsid, CAST(chrom_no AS VARCHAR) AS chromosome, position, allele1, allele2 FROM fx_calls WHERE allele1 <> 'N'"


@query("src01_array_exports", READ_CALLS)
def _(c):
    calls, refused = arrays.read_array_exports(c.spark, exports(c))
    return calls.select(from_path("sample_id").alias("sample_id"), "provider", "rsid", "chromosome", "position", "allele1", "allele2")


@query("src18_array_coverage", "SELECT DISTINCT rsid FROM fx_calls")
def _(c):
    return arrays.array_coverage(c.spark, exports(c))


def name_by_kit(c, path: str) -> str:
    """Move each kit's file to the name that uploads have, ``<sample>__<kit>.txt``; the listing is as long as the uploads."""
    jvm, to = c.spark.sparkContext._jvm, shared(c, "uploads")
    folder = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = folder(path).getFileSystem(c.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder(to))
    for found in fs.globStatus(folder(f"{path}/sample_id=*/kit=*/part-*")):
        kit = found.getPath().getParent()
        sample = kit.getParent().getName().removeprefix("sample_id=")
        fs.rename(found.getPath(), folder(f"{to}/{sample}__{kit.getName().removeprefix('kit=')}.txt"))
    return to


@query("str1_ingest_stream", f"SELECT CAST(sample_id AS VARCHAR) AS sample_id, kit, rsid, provider, chromosome, position, arg_min(allele1, allele1 || allele2) AS allele1, arg_min(allele2, allele1 || allele2) AS allele2 FROM ({READ_CALLS.replace('SELECT sample_id,', 'SELECT sample_id, kit,')}) GROUP BY ALL")
def _(c):
    calls, refused, state = (shared(c, x) for x in ("calls", "refused", "state"))
    ingest.ingest_stream(c.spark, name_by_kit(c, exports(c)), calls, refused, state).awaitTermination()
    return ingest.current_calls(c.spark, calls).select("sample_id", "kit", "rsid", "provider", "chromosome", "position", "allele1", "allele2")


# --- variant files ------------------------------------------------------------------------------

# Header lines by the remainder of the chromosome by 3, and what they say of the build.
BUILD_LINES = (["##contig=<ID=1,length=249250621>"], ["##reference=file:///x/hs38.fa"], ["##contig=<ID=chr1,length=248956422>", "##reference=hg19"])
BUILDS = "CASE chrom_no % 3 WHEN 0 THEN 'GRCh37' ELSE 'GRCh38' END"


def variant_files(c) -> str:
    """A file of all samples for each chromosome; some records are reference blocks, indels, no-calls or without an id."""
    m, odd = c.view("fx_markers"), F.col("marker_id") % 50
    sep = F.when(F.col("marker_id") % 2 == 0, "|").otherwise("/")
    gt = F.when(odd == 3, "./.").otherwise(F.concat(F.col("h1").cast("string"), sep, F.col("h2").cast("string")))
    cells = c.view("fx_truth").groupBy("marker_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", gt.alias("gt")))).alias("g"))
    rows = m.join(cells, "marker_id")
    value = tabbed(
        F.concat(F.lit("chr"), F.col("chrom_no").cast("string")), "position", F.when(odd == 0, ".").otherwise(F.col("rsid")), F.when(odd == 2, F.concat("ref", F.lit("T"))).otherwise(F.col("ref")), F.when(odd == 1, "<NON_REF>").otherwise(F.col("alt")),
        F.lit("."), F.when(F.col("marker_id") % 7 == 0, "LowQual").otherwise("PASS"), F.lit("."), F.lit("GT"), F.array_join(F.transform("g", lambda x: x["gt"]), "\t"),
    )
    names = c.view("fx_truth").select("sample_id").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list("sample_id")), lambda s: F.concat(F.lit("S"), s.cast("string"))), "\t").alias("names"))
    build = F.array(*[F.array(*map(F.lit, b)) for b in BUILD_LINES])[(F.col("chrom_no") % 3).cast("int")]
    head = m.select("chrom_no").distinct().join(F.broadcast(names)).select("chrom_no", F.posexplode(F.concat(F.array(F.lit("##fileformat=VCFv4.2")), build, F.array(F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), "names")))).alias("k", "value"))
    body = rows.select("chrom_no", (F.col("position") + 100).alias("k"), value.alias("value"))
    return write_files(head.select("chrom_no", F.col("k").cast("long").alias("k"), "value").unionByName(body), ["chrom_no"], shared(c, "vcf"))


@query("src02_read_vcf", "SELECT 'S' || CAST(sample_id AS VARCHAR) AS sample, rsid, CAST(chrom_no AS VARCHAR) AS chromosome, position, a1 AS allele1, a2 AS allele2, marker_id % 2 = 0 AS phased FROM ox_true WHERE marker_id % 50 NOT IN (0, 1, 2, 3)")
def _(c):
    return vcf.read_vcf(c.spark, variant_files(c)).select("sample", "rsid", "chromosome", "position", "allele1", "allele2", "phased")


@query("src03_skip_accounting", "SELECT chrom_no, count(*) AS records, count(*) FILTER (marker_id % 50 > 3) AS calls, count(*) FILTER (marker_id % 50 = 1) AS reference_block, count(*) FILTER (marker_id % 50 = 2) AS shape, count(*) FILTER (marker_id % 50 = 3) AS no_call, count(*) FILTER (marker_id % 50 = 0) AS no_id, count(*) FILTER (marker_id % 50 > 3 AND marker_id % 7 = 0) AS kept_not_pass FROM ox_true GROUP BY chrom_no")
def _(c):
    found = vcf.skip_accounting(vcf.decode(lines.read_lines(c.spark, variant_files(c))))
    return found.withColumn("chrom_no", from_path("chrom_no")).drop("file")


@query("src04_detect_build", f"SELECT DISTINCT chrom_no, {BUILDS} AS build, CASE chrom_no % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence, CASE chrom_no % 3 WHEN 1 THEN 'header_text' ELSE 'contig_lengths' END AS evidence FROM fx_markers")
def _(c):
    found = vcf.detect_build(lines.read_lines(c.spark, variant_files(c)))
    return found.withColumn("chrom_no", from_path("chrom_no")).drop("file")


@query("src05_require_build", "SELECT chrom_no, CASE WHEN chrom_no % 3 = 0 THEN count(*) FILTER (marker_id % 50 > 3) END AS calls FROM ox_true GROUP BY chrom_no")
def _(c):
    path = variant_files(c)
    good, refused = vcf.require_build(vcf.read_vcf(c.spark, path), vcf.detect_build(lines.read_lines(c.spark, path)))
    n = good.groupBy(from_path("chrom_no").alias("chrom_no")).agg(F.count(F.lit(1)).alias("calls"))
    return n.unionByName(refused.select(from_path("chrom_no").alias("chrom_no"), F.lit(None).cast("long").alias("calls")))


@query("src22_require_phased", "SELECT chrom_no, bool_and(marker_id % 2 = 0) AS phased, count(*) AS records FROM ox_true GROUP BY chrom_no")
def _(c):
    found = vcf.require_phased(vcf.decode(lines.read_lines(c.spark, variant_files(c))))
    return found.withColumn("chrom_no", from_path("chrom_no")).drop("file")


BASES = "SELECT marker_id, chrom_no, position, " + ", ".join(f"CAST(count(*) FILTER (b = '{b}') AS BIGINT) AS {b}" for b in "ACGT") + " FROM (SELECT marker_id, chrom_no, position, unnest([allele1, allele2]) AS b FROM fx_calls) WHERE b <> 'N' GROUP BY ALL"


def pileups(c) -> str:
    """What the calls read at each marker, as pileup text with read ends, insertions, deletions and gaps in between."""
    read = c.view("fx_calls").select("marker_id", F.explode(F.array("allele1", "allele2")).alias("b")).where("b <> 'N'")
    n = read.groupBy("marker_id").agg(*[F.count_if(F.col("b") == b).cast("int").alias(b) for b in "ACGT"])
    rows = c.view("fx_markers").join(n, "marker_id")
    some = lambda b, low: F.when(F.col("ref") == b, F.repeat(F.lit("," if low else "."), F.col(b))).otherwise(F.repeat(F.lit(b.lower() if low else b), F.col(b)))
    bases = F.concat(F.lit("^F"), some("A", False), F.lit("+2AG"), some("C", True), F.lit("-1T$"), some("G", False), F.lit("*<>"), some("T", True), F.lit("+12acgtacgtacgt"))
    value = tabbed(F.concat(F.lit("chr"), F.col("chrom_no").cast("string")), "position", F.lower("ref"), F.lit(9), bases, F.lit("~"))
    path = shared(c, "pileup")
    rows.select(value.alias("value")).write.text(path)
    return path


@query("src06_read_pileup", f"SELECT CAST(p.chrom_no AS VARCHAR) AS chromosome, p.position, m.ref, A, C, G, T FROM ({BASES}) p JOIN fx_markers m USING (marker_id)")
def _(c):
    return vcf.read_pileup(c.spark, pileups(c)).drop("file")


CALLED = f"""WITH b AS ({BASES}), l AS (SELECT chrom_no, position, A + C + G + T AS depth, unnest(['A', 'C', 'G', 'T']) AS base, unnest([A, C, G, T]) AS n FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY chrom_no, position ORDER BY n DESC, base) AS r FROM l WHERE n > 0 AND n >= CAST(0.2 AS DOUBLE) * depth),
g AS (SELECT chrom_no, position, any_value(depth) AS depth, min(base) AS a, max(base) AS z FROM k WHERE r <= 2 GROUP BY ALL)
SELECT CAST(chrom_no AS VARCHAR) AS chromosome, position, depth, CASE WHEN depth < 8 THEN 'N' ELSE a END AS allele1, CASE WHEN depth < 8 THEN 'N' ELSE z END AS allele2 FROM g"""


@query("src7_call_from_counts", CALLED)
def _(c):
    return vcf.call_from_counts(vcf.read_pileup(c.spark, pileups(c))).select("chromosome", "position", "depth", "allele1", "allele2")


@query("src08_read_imputed_vcf", """SELECT rsid, CAST(chrom_no AS VARCHAR) AS chromosome, position, ref, alt, CASE WHEN marker_id % 4 < 3 THEN d END AS dr2, a AS af, least(a, round(1 - a, 2)) AS maf, marker_id % 4 IN (0, 2) AS imputed
FROM (SELECT *, CAST(marker_id * 37 % 100 AS DOUBLE) / 100 AS d, CAST(marker_id * 13 % 100 AS DOUBLE) / 100 AS a FROM fx_markers)""")
def _(c):
    number = lambda k: F.format_string("%.2f", F.col("marker_id") * k % 100 / 100)
    kinds = [("DR2=", ",0.5;AF=", ",0.1;IMP"), ("X;R2=", ";MAF=", ""), ("IMPUTED;INFO=", ";AF1=", "")]
    info = F.concat(F.lit("AF="), number(13))
    for k, (a, b, z) in enumerate(kinds):
        info = F.when(F.col("marker_id") % 4 == k, F.concat(F.lit(a), number(37), F.lit(b), number(13), F.lit(z))).otherwise(info)
    path = shared(c, "imputed")
    c.view("fx_markers").select(tabbed("chrom_no", "position", "rsid", F.lower("ref"), "alt", F.lit("."), F.lit("PASS"), info).alias("value")).write.text(path)
    return vcf.read_imputed_vcf(c.spark, path).drop("file").withColumn("maf", F.round("maf", 2))


# --- maps, chains, annotation tables ------------------------------------------------------------


@query("src09_read_genetic_map", "SELECT CASE WHEN chrom_no = 22 THEN 'X' ELSE CAST(chrom_no AS VARCHAR) END AS chrom, bp, cm FROM fx_genetic_map")
def _(c):
    path = shared(c, "map")
    m = c.view("fx_genetic_map").withColumn("no", F.when(F.col("chrom_no") == 22, 23).otherwise(F.col("chrom_no")))
    good = m.select(F.concat_ws(" ", F.col("no").cast("string"), F.lit("rs1"), F.col("cm").cast("string"), F.col("bp").cast("string")).alias("value"))
    good.union(m.select(F.concat_ws(" ", F.lit("# chr"), F.lit("x"), F.lit("cM"), F.lit("bp")))).union(m.select(F.lit("1 rs2 0.5"))).write.text(path)
    return tables.read_genetic_map(c.spark, path)


@query("src10_read_chain_blocks", "SELECT CAST(chrom_no AS VARCHAR) AS chrom, t_start, t_end, CAST(chrom_no AS VARCHAR) AS q_chrom, q_start, 7000000000 AS q_size, '+' AS strand, CAST(900 + chrom_no AS BIGINT) AS score FROM fx_chain_blocks")
def _(c):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("chrom_no").orderBy("t_start")
    b = c.view("fx_chain_blocks").withColumns({"size": F.col("t_end") - F.col("t_start"), "dt": F.lead("t_start").over(w) - F.col("t_end"), "k": F.row_number().over(w)})
    b = b.withColumn("dq", F.lead("q_start").over(w) - F.col("q_start") - F.col("size"))
    body = b.select("chrom_no", "k", F.concat_ws(" ", *[F.col(x).cast("string") for x in ("size", "dt", "dq")]).alias("value"))
    ends = b.groupBy("chrom_no").agg(F.min("t_start").alias("t0"), F.min("q_start").alias("q0"))
    chr_ = F.concat(F.lit("chr"), F.col("chrom_no").cast("string"))
    head = ends.select("chrom_no", F.lit(0).alias("k"), F.concat_ws(" ", F.lit("chain"), (900 + F.col("chrom_no")).cast("string"), chr_, F.lit("9999999999 +"), F.col("t0").cast("string"), F.lit("9999999998"), chr_, F.lit("7000000000 +"), F.col("q0").cast("string"), F.lit("6999999999 1")).alias("value"))
    return tables.read_chain_blocks(c.spark, write_files(head.unionByName(body), ["chrom_no"], shared(c, "chain"))).drop("chain_id")


@query("src11_read_clinvar_summary", "SELECT r.rsid, CASE WHEN m.marker_id % 6 = 0 THEN NULL ELSE gene END AS gene, nullif(clinical_sig, '') AS clinical_sig, review_status, CAST(m.chrom_no AS VARCHAR) AS chromosome, m.position, 'a|b' AS conditions FROM fx_ref_variants r JOIN fx_markers m USING (rsid) WHERE m.marker_id % 10 <> 0")
def _(c):
    rows = c.view("fx_ref_variants").join(c.view("fx_markers").select("rsid", "marker_id", "chrom_no", "position"), "rsid").withColumn("Assembly", F.explode(F.array(F.lit("GRCh37"), F.lit("GRCh38"))))
    rsid = F.when(F.col("marker_id") % 10 == 0, "-1").otherwise(F.substring("rsid", 3, 20))
    path = shared(c, "clinvar")
    gene = F.when(F.col("marker_id") % 6 == 0, "na").otherwise(F.col("gene"))
    rows.select(rsid.alias("RS# (dbSNP)"), gene.alias("GeneSymbol"), F.col("clinical_sig").alias("ClinicalSignificance"), F.col("review_status").alias("ReviewStatus"), "Assembly", F.col("chrom_no").alias("Chromosome"), F.col("position").alias("PositionVCF"), F.lit("a|b").alias("PhenotypeList")).write.csv(path, sep="\t", header=True)
    return tables.read_clinvar_summary(c.spark, path).drop("assembly")


@query("src12_read_gwas_associations", """SELECT unnest(CASE WHEN marker_id % 3 = 0 THEN [rsid, 'rs1'] WHEN marker_id % 3 = 1 THEN [rsid] ELSE [rsid, 'rs2', 'rs3'] END) AS rsid, marker_id % 20 + 0.5 AS mlog, 'GCST' || CAST(marker_id % 50 AS VARCHAR) AS study, 'height' AS trait,
CASE marker_id % 3 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' ELSE '' END AS direction, CASE WHEN marker_id % 2 = 0 THEN alt ELSE '' END AS risk_allele, CAST(marker_id AS VARCHAR) AS pubmed FROM fx_markers""")
def _(c):
    k = F.col("marker_id") % 3
    path = shared(c, "gwas")
    snps = F.when(k == 0, F.concat("rsid", F.lit(" x RS1"))).when(k == 1, F.concat("rsid", F.lit("; chr1:5"))).otherwise(F.concat("rsid", F.lit(", rs2;rs3")))
    ci = F.when(k == 0, "[1-2] unit increase").when(k == 1, "[1-2] unit decrease").otherwise("[NR]")
    risk = F.concat("rsid", F.lit("-"), F.when(F.col("marker_id") % 2 == 0, F.lower("alt")).otherwise("?"))
    c.view("fx_markers").select(snps.alias("SNPS"), (F.col("marker_id") % 20 + 0.5).alias("PVALUE_MLOG"), F.concat(F.lit("GCST"), (F.col("marker_id") % 50).cast("string")).alias("STUDY ACCESSION"), F.lit("height").alias("MAPPED_TRAIT"), risk.alias("STRONGEST SNP-RISK ALLELE"), ci.alias("95% CI (TEXT)"), F.col("marker_id").alias("PUBMEDID")).write.csv(path, sep="\t", header=True)
    return tables.read_gwas_associations(c.spark, path)


@query("src13_read_gene_drug_levels", "SELECT gene, category AS drug, cpic_level AS level FROM fx_ref_variants WHERE cpic_level <> ''")
def _(c):
    path = shared(c, "levels")
    c.view("fx_ref_variants").where("cpic_level <> ''").select("gene", F.col("category").alias("drug"), F.col("cpic_level").alias("level")).write.json(path)
    return tables.read_gene_drug_levels(c.spark, path)


@query("src14_read_scoring_file", """SELECT model_id, rsid, effect_allele, other_allele, round(CASE WHEN CAST(substr(model_id, 6) AS INT) % 2 = 1 THEN ln(1 + abs(weight)) ELSE weight END, 9) AS weight, n_refused, n_skipped FROM fx_prs_weights w JOIN fx_markers m USING (rsid)
JOIN (SELECT w.model_id, count(*) FILTER (m.marker_id % 10 = 0) AS n_refused, count(*) FILTER (m.marker_id % 10 <> 0 AND m.marker_id % 14 = 4) AS n_skipped FROM fx_prs_weights w JOIN fx_markers m USING (rsid) GROUP BY 1) n USING (model_id) WHERE m.marker_id % 10 <> 0 AND m.marker_id % 14 <> 4""")
def _(c):
    rows = c.view("fx_prs_weights").join(c.view("fx_markers").select("rsid", "marker_id"), "rsid")
    ratio = F.substring("model_id", 6, 3).cast("int") % 2 == 1
    value = tabbed(F.when(F.col("marker_id") % 14 == 4, "").otherwise(F.col("rsid")), F.lower("effect_allele"), "other_allele", F.when(ratio, 1 + F.abs("weight")).otherwise(F.col("weight")), F.when(F.col("marker_id") % 10 == 0, "True").otherwise("False"))
    head = rows.select("model_id").distinct().select("model_id", F.posexplode(F.array(F.concat(F.lit("#weight_type="), F.when(ratio, "OR").otherwise("beta")), F.lit("rsID\teffect_allele\tother_allele\teffect_weight\tis_dominant"))).alias("k", "value"))
    path = write_files(head.unionByName(rows.select("model_id", F.lit(2).alias("k"), value.alias("value"))), ["model_id"], shared(c, "scores"))
    found, counts = tables.read_scoring_file(c.spark, path)
    n = counts.select("file", F.col("non_additive_refused").alias("n_refused"), F.col("unusable_skipped").alias("n_skipped"))
    return found.join(n, "file").select(from_path("model_id", "string").alias("model_id"), "rsid", "effect_allele", "other_allele", F.round("weight", 9).alias("weight"), "n_refused", "n_skipped")


@query("src15_read_panel_labels", "SELECT DISTINCT 'S' || CAST(sample_id AS VARCHAR) AS sample_id, 'POP_' || CAST(fam AS VARCHAR) AS pop, 'SUP' AS superpop FROM fx_kits")
def _(c):
    people = c.view("fx_kits").select("sample_id", "fam").distinct()
    rows = people.select(F.lit("f").alias("part"), F.lit(1).alias("k"), F.concat(F.lit('"S'), F.col("sample_id").cast("string"), F.lit('","pop '), F.col("fam").cast("string"), F.lit('",Sup,male')).alias("value"))
    head = people.limit(1).select(F.lit("f").alias("part"), F.lit(0).alias("k"), F.lit("sample,Population,super_pop,gender").alias("value"))
    return tables.read_panel_labels(c.spark, write_files(head.unionByName(rows), ["part"], shared(c, "labels")))


KEPT = ", ".join(f"'{s}'" for s in tables.KEEP_SIG)


@query("src16_flatten_json", f"SELECT rsid AS id, CASE WHEN m.marker_id % 5 = 0 THEN '' ELSE gene END AS gene, clinical_sig, CASE WHEN m.marker_id % 2 = 0 THEN 'c1; c2' ELSE 'c1' END AS conditions FROM fx_ref_variants r JOIN fx_markers m USING (rsid) WHERE clinical_sig IN ({KEPT}) UNION ALL SELECT rsid, CASE WHEN m.marker_id % 5 = 0 THEN '' ELSE gene END, 'risk factor', 'c3' FROM fx_ref_variants r JOIN fx_markers m USING (rsid) WHERE m.marker_id % 2 = 0")
def _(c):
    rows = c.view("fx_ref_variants").join(c.view("fx_markers").select("rsid", "marker_id"), "rsid")
    even = F.col("marker_id") % 2 == 0
    name = lambda *names: F.to_json(F.array(*[F.struct(F.lit(n).alias("name")) for n in names]))
    gene = F.to_json(F.struct(F.col("gene").alias("symbol")))
    gene = F.when(even, F.concat(F.lit("["), gene, F.lit(',{"symbol":"Z"}]'))).otherwise(gene)
    rcv = lambda sig, names: F.concat(F.lit('{"clinical_significance":"'), sig, F.lit('","conditions":'), names, F.lit("}"))
    first = F.initcap("clinical_sig")
    rcvs = F.when(even, F.concat(F.lit("["), rcv(first, name("c1", "c2")), F.lit(","), rcv(F.lit("Benign"), name("c9")), F.lit(","), rcv(F.lit("Risk factor"), name("c3")), F.lit("]"))).otherwise(rcv(first, F.lit('{"name":"c1"}')))
    dbsnp = F.when(F.col("marker_id") % 5 == 0, "{}").otherwise(F.concat(F.lit('{"gene":'), gene, F.lit("}")))
    json = F.concat(F.lit('{"dbsnp":'), dbsnp, F.lit(',"clinvar":{"rcv":'), rcvs, F.lit("}}"))
    return tables.flatten_annotation_json(rows.select(F.col("rsid").alias("id"), json.alias("json")), "json", "id")


@query("src17_flatten_population_json", "SELECT rsid, pop, allele, freq, CAST(60 AS BIGINT) AS n FROM fx_allele_freq WHERE pop <> 'POP4' UNION ALL SELECT rsid, 'ALL', allele, round(avg(freq), 6), NULL FROM fx_allele_freq GROUP BY rsid, allele")
def _(c):
    f = c.view("fx_allele_freq")
    one = lambda pop, freq, n: F.struct(F.concat(F.lit(tables.PHASE3), pop).alias("population"), F.col("allele").alias("allele"), freq.alias("frequency"), n.alias("allele_count"))
    each = f.select("rsid", one(F.col("pop"), F.col("freq"), F.when(F.col("allele_no") == 0, 81.0).otherwise(40.0)).alias("p"))
    all_ = f.groupBy("rsid", "allele").agg(F.avg("freq").alias("a")).select("rsid", one(F.lit("ALL"), F.col("a"), F.lit(9.0)).alias("p"))
    json = each.unionByName(all_).groupBy("rsid").agg(F.to_json(F.struct(F.collect_list("p").alias("populations"))).alias("json"))
    named, pooled = tables.flatten_population_json(json, "json", "rsid", ("POP0", "POP1", "POP2", "POP3"))
    return named.select("rsid", "pop", "allele", "freq", "n").unionByName(pooled.select("rsid", F.lit("ALL").alias("pop"), "allele", "freq", F.lit(None).cast("long").alias("n")))


@query("src19_read_q_matrix", "SELECT row_number() OVER (ORDER BY sample_id) AS row, unnest(['A', 'B', 'C']) AS pop, unnest([sample_id / 40.0, 0.25, 0.75 - sample_id / 40.0]) AS proportion FROM (SELECT DISTINCT sample_id FROM fx_kits)")
def _(c):
    rows = c.view("fx_kits").select("sample_id").distinct()
    q = F.concat_ws(" ", (F.col("sample_id") / 40).cast("string"), F.lit("0.25"), (0.75 - F.col("sample_id") / 40).cast("string"))
    return tables.read_q_matrix(c.spark, write_files(rows.select(F.lit("f").alias("part"), F.col("sample_id").alias("k"), q.alias("value")), ["part"], shared(c, "q")), ["A", "B", "C"])


@query("src20_read_segments", "SELECT 'a' || CAST(m.marker_id % 9 AS VARCHAR) AS a, 'b' AS b, CASE WHEN chrom_no = 1 THEN 'X' ELSE CAST(chrom_no AS VARCHAR) END AS chrom, position AS start_bp, position + 1000 AS end_bp, 'IBD1' AS ibd_type, round(marker_id * 0.01, 4) AS cm, CASE WHEN marker_id % 3 = 0 THEN 0 ELSE marker_id END AS snps FROM fx_markers m")
def _(c):
    path = shared(c, "segments")
    cells = [F.concat(F.lit("a"), (F.col("marker_id") % 9).cast("string")), F.lit("b"), F.when(F.col("chrom_no") == 1, 23).otherwise(F.col("chrom_no")), F.col("position"), F.col("position") + 1000, F.lit("IBD1"), F.lit("0"), F.lit("0"), F.format_string("%.4f", F.col("marker_id") * 0.01)]
    value = F.concat(F.concat_ws("  ", *[x.cast("string") for x in cells]), F.when(F.col("marker_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("marker_id").cast("string"))))
    m = c.view("fx_markers")
    m.select(value.alias("value")).union(m.select(F.lit("# note"))).union(m.select(F.lit("a b 1 start end IBD1 0 0 cm"))).union(m.select(F.lit("a b 1 5"))).write.text(path)
    return tables.read_segments(c.spark, path)


@query("src21_read_caller_tables", "SELECT 'S' || CAST(sample_id AS VARCHAR) AS sample_id, CASE WHEN sample_id % 2 = 0 THEN 'R1' ELSE 'J2' END AS haplogroup, CASE WHEN sample_id % 2 = 0 THEN NULL ELSE '0.9' END AS quality FROM (SELECT DISTINCT sample_id FROM fx_kits)")
def _(c):
    s = c.view("fx_kits").select("sample_id").distinct()
    name = F.concat(F.lit("S"), F.col("sample_id").cast("string"))
    two = F.array(tabbed(name, F.when(F.col("sample_id") % 2 == 0, "?").otherwise("J2"), F.lit("0.9")), tabbed(name, F.lit("R1"), F.lit("")))
    rows = s.select(F.lit("f").alias("part"), F.posexplode(two).alias("i", "value")).select("part", (F.col("i") + 1).alias("k"), "value")
    head = s.limit(1).select(F.lit("f").alias("part"), F.lit(0).alias("k"), F.lit("Sample_name\tHg\tQC-score").alias("value"))
    return tables.read_caller_tables(c.spark, write_files(head.unionByName(rows), ["part"], shared(c, "callers")), "yleaf")
