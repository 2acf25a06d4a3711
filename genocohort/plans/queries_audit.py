"""Registered queries: digests of files, gap lists, second sources, and functions on whole rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles as al
from ..operators import ancestry, carrier, family, findings, history, lineage, pgx, pool, provenance, prs, reference, traits
from ..sources import tables
from .queries import query
from .queries_more import EACH_RULE, MOMENTS, MT_DEFINING, MT_STATES, NOT_TESTED, PRS, RAW, Y_STATES, chained_rules, deep_tree, mt_fixture, segments, tree_walk
from .queries_sources import shared, write_files
from .scan import Entities, References, scan

# --- a second source of frequencies -------------------------------------------------------------

# by marker: stated figures for one in five; genomes for one in four, exomes (0.2 more where both are) for one in two, another table for one in seven
SECOND = """SELECT rsid, minor_allele, gmaf, gmaf_source, second_source, round(second_freq, 6) AS second_freq, round(abs(gmaf - second_freq), 6) AS difference, CASE WHEN second_freq IS NULL THEN 'unchecked' WHEN round(abs(gmaf - second_freq), 6) <= 0.05 THEN 'agree' ELSE 'differ' END AS agreement FROM (
 SELECT x.rsid, x.minor_allele, x.gmaf, x.gmaf_source, CASE WHEN x.m % 4 = 0 THEN 'gnomADg:ALL' WHEN x.m % 2 = 0 THEN 'gnomADe:ALL' WHEN x.m % 7 = 0 THEN 'gnomADx:ALL' END AS second_source, CASE WHEN x.m % 2 = 0 OR x.m % 7 = 0 THEN round(least(1.0, a.f + x.m % 3 * 0.04), 6) END AS second_freq
 FROM (SELECT rsid, m, CASE WHEN m % 5 = 0 THEN max(allele) FILTER (allele_no = 1) ELSE arg_min(allele, (f, allele)) END AS minor_allele, CASE WHEN m % 5 = 0 THEN 0.3 ELSE min(f) END AS gmaf, CASE WHEN m % 5 = 0 THEN 'stated' ELSE 'pooled' END AS gmaf_source FROM {p} GROUP BY rsid, m) x JOIN {p} a ON a.rsid = x.rsid AND a.allele = x.minor_allele)"""
POOLED_SQL = "(SELECT rsid, CAST(substr(rsid, 3) AS BIGINT) - 1000 AS m, allele, allele_no, round(avg(freq), 6) AS f FROM fx_allele_freq GROUP BY rsid, allele, allele_no)"


@query("src17_cross_check", SECOND.replace("{p}", POOLED_SQL))
def _(c):
    f = c.view("fx_allele_freq").groupBy("rsid", "allele", "allele_no").agg(F.round(F.avg("freq"), 6).alias("f")).withColumn("m", F.substring("rsid", 3, 20).cast("long") - 1000)
    second = F.round(F.least(F.lit(1.0), F.col("f") + F.col("m") % 3 * 0.04), 6)
    row = lambda name, freq, when: F.when(when, F.struct(F.lit(name).alias("population"), F.lower("allele").alias("allele"), freq.alias("frequency"), F.lit(1.0).alias("allele_count")))
    rows = F.array_compact(F.array(row(tables.PHASE3 + tables.POOLED, F.col("f"), F.lit(True)), row("gnomADg:ALL", second, F.col("m") % 4 == 0), row("gnomADe:ALL", second + F.when(F.col("m") % 4 == 0, 0.2).otherwise(0.0), F.col("m") % 2 == 0), row("gnomADx:ALL", second + F.when(F.col("m") % 2 == 0, 0.1).otherwise(0.0), F.col("m") % 7 == 0)))
    stated = F.col("m") % 5 == 0
    each = f.groupBy("rsid", "m").agg(F.flatten(F.collect_list(rows)).alias("populations"), F.max(F.when(F.col("allele_no") == 1, F.col("allele"))).alias("alt"))
    json = each.select("rsid", F.to_json(F.struct(F.when(stated, F.lower("alt")).alias("minor_allele"), F.when(stated, 0.3).alias("MAF"), "populations")).alias("json"))
    return tables.cross_check(json, "json", "rsid")


# --- digests ------------------------------------------------------------------------------------

FILES_SQL = "(SELECT sample_id, string_agg(rsid || chr(9) || gkey || chr(10), '' ORDER BY rsid) AS content FROM ox_pooled GROUP BY sample_id)"


def sample_files(c):
    """A file of genotypes for each sample, listed under its folder; all are read, whatever their size."""
    rows = c.pooled().select("sample_id", F.col("rsid").alias("k"), F.concat_ws("\t", "rsid", "genotype").alias("value"))
    files = provenance.listed_files(c.spark, write_files(rows, ["sample_id"], shared(c, "genotypes")), most_bytes=2**31 - 1)
    return files.withColumn("path", F.regexp_replace("path", "/part-[^/]*$", ""))


@query("ag36_manifest", """SELECT sample_id, sum(n) AS findings, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM (SELECT sample_id, substr(d, 1, 2) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM (SELECT sample_id, sha256('{"genotype":"' || gkey || '","rsid":"' || rsid || '"}') AS d FROM ox_pooled) GROUP BY sample_id, substr(d, 1, 2)) GROUP BY sample_id""")
def _(c):
    return provenance.manifest(c.pooled().select("sample_id", "rsid", "genotype"), ["rsid", "genotype"])


@query("ag36_manifest_counts", "SELECT sample_id, 'silo' AS kind, silo AS value, count(*) AS n FROM ox_findings GROUP BY ALL UNION ALL SELECT sample_id, 'entity', 'snp', count(*) FROM ox_findings GROUP BY ALL")
def _(c):
    return provenance.manifest_counts(c.scan()["findings"])


@query("ag36_file_digests", f"SELECT 'sample_id=' || s.sample_id AS path, f.content IS NOT NULL AS present, strlen(f.content) AS length, sha256(f.content) AS digest FROM (SELECT DISTINCT sample_id FROM ox_pooled UNION ALL SELECT 999) s LEFT JOIN {FILES_SQL} f USING (sample_id)")
def _(c):
    name = F.concat(F.lit("sample_id="), F.col("sample_id").cast("string")).alias("path")
    wanted = c.pooled().select(name).distinct().unionByName(c.spark.range(999, 1000).withColumnRenamed("id", "sample_id").select(name))
    return provenance.match_files(wanted, sample_files(c))


@query("ag41_panel_inventory", f"""SELECT (SELECT count(DISTINCT fam) FROM fx_truth) AS populations, (SELECT count(DISTINCT sample_id) FROM fx_truth) AS samples, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, sum(n) AS files FROM (
 SELECT substr(b, 1, 2) AS b, sha256(string_agg(d, chr(10) ORDER BY b)) AS d, sum(n) AS n FROM (SELECT substr(d, 1, 4) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM (SELECT sha256(content) AS d FROM {FILES_SQL}) GROUP BY 1) GROUP BY substr(b, 1, 2))""")
def _(c):
    return ancestry.panel_inventory(sample_files(c), c.view("fx_truth", hold=False).select("sample_id", F.col("fam").alias("pop")))


# --- what is not verified -----------------------------------------------------------------------


def noted_tree(c):
    i = F.substring("node", 2, 20).cast("long")
    kind = F.when(i % 11 == 0, "deletion").when(i % 13 == 0, "insertion").when(i % 2 == 0, "snv")
    return deep_tree(c).select("node", "parent", F.concat(F.lit("M"), i.cast("string")).alias("marker"), "rsid", (i % 3 == 0).alias("verified"), kind.alias("variant_type"), F.when(i % 11 == 0, "AC").alias("ancestral_seq"), F.when(i % 13 == 0, "GT").alias("derived_seq"), F.when(i % 5 == 0, "to check").otherwise("").alias("note"))


@query("wn18_untypeable_markers", "SELECT 'N' || id AS node, 'M' || id AS marker, CASE WHEN id % 11 = 0 THEN 'deletion' ELSE 'insertion' END AS variant_type, CASE WHEN id % 11 = 0 THEN 'AC' END AS ancestral_seq, CASE WHEN id % 13 = 0 THEN 'GT' END AS derived_seq, CASE WHEN id % 5 = 0 THEN 'to check' ELSE '' END AS note FROM (SELECT marker_id + 1 AS id FROM fx_markers) WHERE id % 11 = 0 OR id % 13 = 0")
def _(c):
    return lineage.untypeable_markers(noted_tree(c))


@query("wn18_unverified_markers", f"""SELECT 'Y' AS system, 'N' || id AS node, 'M' || id AS marker, CASE WHEN marker_id % 4 <> 3 THEN rsid END AS rsid, NULL AS positions, CASE WHEN id % 5 = 0 THEN 'to check' ELSE '' END AS note FROM (SELECT marker_id + 1 AS id, * FROM fx_markers) WHERE id > 1 AND id % 3 <> 0
 UNION ALL SELECT 'MT', 'N' || id, NULL, NULL, string_agg(CAST(marker_id + 1 AS VARCHAR), ',' ORDER BY marker_id), 'mt' FROM {MT_DEFINING} WHERE NOT verified GROUP BY id""")
def _(c):
    _, defining = mt_fixture(c)
    rows = lineage.unverified_markers(noted_tree(c), defining.withColumn("note", F.lit("mt")))
    return rows.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query("wn18_gap_impact", tree_walk(MT_STATES, NOT_TESTED, True) + f" SELECT 'N' || g.id AS node, count(s.sample_id) AS samples_on_path FROM (SELECT DISTINCT id FROM {MT_DEFINING} WHERE NOT verified) g LEFT JOIN steps s ON s.spot = g.id GROUP BY g.id")
def _(c):
    pooled, defining = mt_fixture(c)
    t = deep_tree(c)
    gaps = lineage.unverified_markers(t.limit(0).select("node", "parent", F.lit("").alias("marker"), "rsid", F.lit(True).alias("verified"), F.lit("").alias("note")), defining.withColumn("note", F.lit("")))
    return lineage.gap_impact(gaps, lineage.mt_lineage_walk(pooled, t, defining)).select("node", "samples_on_path")


@query("wn18_unverified_alleles", "SELECT gene, allele, string_agg(rsid || coalesce('=' || base, ''), ',' ORDER BY rsid || coalesce('=' || base, '')) AS variants FROM (SELECT 'g' || m.marker_id // 10 AS gene, '*' || m.marker_id // 3 AS allele, rsid, alt AS base, marker_id % 7 > 0 AS verified FROM fx_markers m) GROUP BY gene, allele HAVING NOT bool_and(verified)")
def _(c):
    m = F.col("marker_id")
    text = lambda a, x: F.concat(F.lit(a), F.floor(x).cast("string"))
    return pgx.unverified_alleles(c.view("fx_markers").select(text("g", m / 10).alias("gene"), text("*", m / 3).alias("allele"), "rsid", F.col("alt").alias("base"), (m % 7 > 0).alias("verified")))


@query("wn18_unverified_figures", """SELECT gene, 'variant' AS kind, 'v' || marker_id || ' (' || rsid || ')' AS item, '' AS note FROM (SELECT 'g' || marker_id // 10 AS gene, * FROM fx_markers) WHERE marker_id % 6 = 0
 UNION ALL SELECT 'g' || marker_id // 10, 'total_known_pathogenic', CAST(marker_id * 3 AS VARCHAR), 'literature' FROM fx_markers WHERE marker_id % 10 = 0 AND marker_id % 4 = 0
 UNION ALL SELECT 'g' || (CAST(substr(rsid, 3) AS BIGINT) - 1000) // 10, 'carrier_frequency', pop || ' = ' || CASE WHEN freq >= 1 THEN '1 in 1' ELSE '1 in ' || CAST(round(1.0 / freq) AS BIGINT) END, 'survey' FROM fx_allele_freq WHERE allele_no = 1 AND (CAST(substr(rsid, 3) AS BIGINT) - 1000) % 10 = 5
 UNION ALL SELECT 'g' || (CAST(substr(rsid, 3) AS BIGINT) - 1000) // 10, 'detection_rate', pop || ' = ' || CAST(freq AS VARCHAR), 'assay' FROM fx_allele_freq WHERE allele_no = 0 AND (CAST(substr(rsid, 3) AS BIGINT) - 1000) % 20 = 5""")
def _(c):
    m = F.col("marker_id")
    gene = F.concat(F.lit("g"), F.floor(m / 10).cast("string")).alias("gene")
    v = c.view("fx_markers").select(gene, F.concat(F.lit("v"), m.cast("string")).alias("name"), "rsid", (m % 6 > 0).alias("verified"), F.lit(None).cast("string").alias("note"))
    totals = c.view("fx_markers").where("marker_id % 10 = 0").select(gene, (m * 3).alias("value"), (m % 4 > 0).alias("verified"), F.lit("literature").alias("basis"))
    f = c.view("fx_allele_freq").withColumn("marker_id", F.substring("rsid", 3, 20).cast("long") - 1000)
    frequencies = f.where("allele_no = 1").select(gene, "pop", F.col("freq").alias("value"), F.when(m % 10 != 5, True).alias("verified"), F.lit("survey").alias("basis"))
    rates = f.where("allele_no = 0 and marker_id % 10 = 5").select(gene, "pop", F.col("freq").alias("value"), (m % 20 != 5).alias("verified"), F.lit("assay").alias("basis"))
    return carrier.unverified_figures(v, totals, frequencies, rates)


@query("sc33_node_names", "SELECT 'N' || id AS node, CASE WHEN id % 4 = 0 THEN 'N' || id ELSE 'N' || id || ',N-' || rsid END AS names FROM (SELECT marker_id + 1 AS id, rsid FROM fx_markers)")
def _(c):
    return lineage.node_names(deep_tree(c)).select("node", F.array_join("names", ",").alias("names"))


# --- functions on whole rows --------------------------------------------------------------------


@query("sc05_orient", """SELECT sample_id, rsid, flip AS flipped, x IN ('AT', 'CG') AS ambiguous, CASE WHEN flip THEN 'minus' WHEN z = 'plus' THEN 'plus' ELSE '' END AS orientation, CASE WHEN x = 'NN' THEN 'NN' WHEN flip THEN least(translate(a, 'ACGT', 'TGCA'), translate(b, 'ACGT', 'TGCA')) || greatest(translate(a, 'ACGT', 'TGCA'), translate(b, 'ACGT', 'TGCA')) ELSE x END AS genotype, x AS source_genotype
 FROM (SELECT sample_id, rsid, gkey AS x, substr(gkey, 1, 1) AS a, substr(gkey, 2, 1) AS b, z, z = 'minus' AND gkey <> 'NN' AS flip FROM (SELECT *, CASE marker_id % 4 WHEN 0 THEN 'minus' WHEN 1 THEN 'plus' WHEN 2 THEN CASE WHEN sample_id % 2 = 0 THEN 'minus' ELSE '' END ELSE '' END AS z FROM ox_pooled))""".replace("CASE WHEN flip THEN 'minus' WHEN z = 'plus' THEN 'plus' ELSE '' END AS orientation", "z AS orientation"))
def _(c):
    m = F.substring("rsid", 3, 20).cast("long") % 4
    said = F.when(m == 0, "Minus").when(m == 1, " plus ").when(m == 2, "").otherwise("sideways")
    back = F.when(F.col("sample_id") % 2 == 0, "minus").otherwise("")
    return c.pooled().select("sample_id", "rsid", al.orient("allele1", "allele2", said, back).alias("o")).select("sample_id", "rsid", "o.flipped", "o.ambiguous", "o.orientation", "o.genotype", "o.source_genotype")


# The series of the error function, which SQL sums to 60 terms.
ERF = "(2.0 / sqrt(pi()) * list_sum(list_transform(range(60), lambda n: pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))))"
PHI = "0.5 * (1.0 + " + ERF.format(x="(z / sqrt(2.0))") + ")"


Z_SCORES = f"(SELECT sample_id, model_id, coverage, (raw - mean) / sd AS z FROM ({PRS.replace('g.model_id, ', f'g.model_id, {RAW} AS raw, ', 1)}) p LEFT JOIN ({MOMENTS}) m USING (model_id))"
BANDED = f"(SELECT sample_id, model_id, coverage, percentile, CASE WHEN percentile < 10 THEN 'low' WHEN percentile < 30 THEN 'below_average' WHEN percentile <= 70 THEN 'average' WHEN percentile <= 90 THEN 'above_average' ELSE 'high' END AS band FROM (SELECT *, round(100.0 * {PHI}, 1) AS percentile FROM {Z_SCORES}))"


@query("sc25_percentiles", f"SELECT sample_id, model_id, percentile, band FROM {BANDED}")
def _(c):
    w = c.view("fx_prs_weights")
    return prs.score_prs(c.pooled(), w, prs.prs_moments(w)).select("sample_id", "model_id", "percentile", "band")


@query("fl2_exempt_entities", "SELECT sample_id, rsid, entity FROM (SELECT s.sample_id, s.rsid, s.publications, s.freq, e.entity FROM ox_scored s CROSS JOIN (VALUES ('snp'), ('genoset'), ('trait'), ('prs')) e(entity)) WHERE entity <> 'snp' OR (publications >= 100 AND freq >= 5 AND freq <= 60)")
def _(c):
    each = c.scan()["findings"].drop("entity_type").withColumn("entity_type", F.explode(F.array(*[F.lit(x) for x in ("snp", "genoset", "trait", "prs")])))
    return findings.filter_findings(each, min_publications=100, min_freq=5, max_freq=60).select("sample_id", "rsid", F.col("entity_type").alias("entity"))


@query("wn02_label_kits", """SELECT c_custkey % 5000 AS sample_id, c_custkey AS kit_ord, CASE WHEN c_custkey < 5000 THEN 'b' || CAST(c_custkey % 3 AS VARCHAR) ELSE 'x' END AS label FROM customer WHERE c_custkey % 5000 % 7 > 0 AND c_custkey < 10000""")
def _(c):
    k = F.col("c_custkey")
    rows = c.table("customer").where("c_custkey < 10000").select((k % 5000).alias("sample_id"), k.alias("kit_ord"), F.when(k < 5000, F.concat(F.lit(" b"), (k % 3).cast("string"))).otherwise("x ").alias("label"), F.when(k % 5000 % 7 == 0, "ignore").otherwise("self").alias("role"))
    return pool.label_kits(rows).select("sample_id", "kit_ord", "label")


# --- the whole scan -----------------------------------------------------------------------------

# one marker in two is in the first tier; homozygous genotypes have an overlay; relatives are the other members of the family
TIERS = "CAST(substr(s.rsid, 3) AS BIGINT) % 2"
WHOLE = f"""SELECT s.sample_id, s.rsid, 'snp' AS entity_type, 1 + {TIERS} AS tier, CASE WHEN {TIERS} = 1 AND s.copies = 0 THEN 'informational' ELSE s.silo END AS silo, CASE WHEN s.zygosity = 'homozygous' THEN 2.5 ELSE s.magnitude END AS magnitude, CASE WHEN s.zygosity = 'homozygous' THEN 'overlay' ELSE 'computed' END AS magnitude_source,
 CASE WHEN s.zygosity = 'homozygous' THEN 'Good' ELSE s.repute END AS repute, r.n_calls, r.relatives, r.shared, NULL::DOUBLE AS coverage FROM ox_scored s JOIN (SELECT f.sample_id, f.rsid, f.n_real AS n_calls, count(m.rsid) FILTER (m.gkey <> 'NN') AS relatives, count(m.rsid) FILTER (m.gkey = f.gkey AND m.gkey <> 'NN') AS shared FROM ox_findings f LEFT JOIN ox_pooled m ON m.sample_id // 4 = f.sample_id // 4 AND m.sample_id <> f.sample_id AND m.rsid = f.rsid GROUP BY ALL) r ON r.sample_id = s.sample_id AND r.rsid = s.rsid
UNION ALL SELECT sample_id, rule_id, 'genoset', NULL, 'actionable', 2.0 + marker_id % 3, NULL, 'Bad', NULL, NULL, NULL, coverage FROM (SELECT r.sample_id, r.rule_id, r.marker_id, round(count(p.rsid) / count(*), 4) AS coverage FROM ({EACH_RULE}) r JOIN (SELECT a.marker_id, b.rsid FROM fx_markers a JOIN fx_markers b ON b.marker_id // 5 = a.marker_id // 5 AND b.marker_id <= a.marker_id AND b.marker_id % 5 < 4) n ON n.marker_id = r.marker_id
 LEFT JOIN ox_pooled p ON p.sample_id = r.sample_id AND p.rsid = n.rsid AND p.gkey <> 'NN' WHERE r.matched GROUP BY ALL)
UNION ALL SELECT p.sample_id, 't' || CAST(m.marker_id % 50 AS VARCHAR), 'trait', NULL, 'informational', 1.0, NULL, '', NULL, NULL, NULL, round(count(DISTINCT p.rsid) / any_value(k.n), 3) FROM ox_pooled p JOIN fx_markers m ON m.rsid = p.rsid JOIN (SELECT marker_id % 50 AS t, count(*) AS n FROM fx_markers GROUP BY 1) k ON k.t = m.marker_id % 50 WHERE p.gkey <> 'NN' GROUP BY p.sample_id, m.marker_id % 50
UNION ALL SELECT sample_id, model_id, 'prs', NULL, 'informational', CASE WHEN band IN ('high', 'low') THEN 3.0 WHEN band = 'average' THEN 1.0 ELSE 2.0 END, NULL, '', NULL, NULL, NULL, coverage FROM {BANDED}"""


def whole(c) -> dict:
    ref, p = c.view("fx_ref_variants"), c.pooled()
    one = F.substring("rsid", 3, 20).cast("long") % 2 == 0
    bases = F.explode(F.array(*[F.lit(f"({b};{b})") for b in "ACGT"]))
    overlay = ref.select("rsid", bases.alias("token"), F.lit(2.5).alias("overlay_magnitude"), F.lit("Good").alias("overlay_repute"), F.lit("").alias("overlay_summary"))
    m = c.view("fx_markers")
    tests = lambda k, call, n: m.select(F.concat(F.lit("t"), (F.col("marker_id") % 50).cast("string")).alias("trait"), F.lit(k).alias("rule_ord"), F.lit("any").alias("combine"), F.lit(call).alias("call"), "rsid", F.lit("min_copies").alias("kind"), F.col("alt").alias("allele"), F.lit(n).alias("n"))
    each = tests(1, "two", 2).unionByName(tests(2, "some", 1))
    texts = m.select(F.concat(F.lit("R"), F.col("marker_id").cast("string")).alias("rule_id"), (F.col("marker_id") % 3 + 2.0).alias("magnitude"), F.lit("s").alias("summary"), F.lit("Bad").alias("repute"), F.lit("actionable").alias("silo"))
    fam = F.floor(F.col("sample_id") / 4)
    other = p.where("genotype <> 'NN'").select(F.col("sample_id").alias("relative"), fam.alias("fam"), "rsid", "genotype", F.lit("relative").alias("role"))
    relatives = other.join(p.select("sample_id", fam.alias("fam")).distinct(), "fam").where("sample_id <> relative").select("sample_id", "relative", "role", "rsid", "genotype")
    refs = References(ref.where(one), c.view("fx_allele_freq"), tier2=ref.where(~one), overlay=overlay)
    more = Entities(chained_rules(c), texts, each, each.select("trait").distinct().withColumn("default_call", F.lit("none")), c.view("fx_prs_weights"))
    return scan(c.calls(hold=False), refs, "POP0", relatives, more.findings, hold=c.scanned)


@query("pl1_whole_scan", WHOLE)
def _(c):
    f = whole(c)["findings"]
    snp = lambda x: F.when(F.col("entity_type") == "snp", x)
    return f.select("sample_id", "rsid", "entity_type", "tier", "silo", "magnitude", "magnitude_source", "repute", snp(F.col("count")).alias("n_calls"), snp(F.size("comparison")).alias("relatives"), snp(F.size(F.filter("comparison", lambda r: r["shared"]))).alias("shared"), "coverage")


@query("pl1_whole_summary", f"SELECT sample_id, entity_type, count(*) AS n, round(sum(magnitude), 4) AS magnitudes FROM ({WHOLE}) GROUP BY ALL")
def _(c):
    f = whole(c)["findings"]
    return f.groupBy("sample_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("magnitude"), 4).alias("magnitudes"))


# --- whole results of earlier operators ---------------------------------------------------------


@query("ag16_reference_meta", " UNION ALL ".join(f"SELECT '{k}' AS key, CAST({v} AS VARCHAR) AS value FROM fx_ref_variants" for k, v in (("rows", "count(*)"), ("rsids", "count(DISTINCT rsid)"), ("genes", "count(DISTINCT gene)"), ("clinvar", "count(*) FILTER (rsid LIKE '%1' OR rsid LIKE '%2')"), ("gwas", "count(*) FILTER (rsid LIKE '%2' OR rsid LIKE '%3')"), ("with_level", "count(*) FILTER (cpic_level <> '')"))))
def _(c):
    last = F.substring("rsid", -1, 1)
    return reference.reference_meta(c.view("fx_ref_variants").withColumn("source", F.when(last == "1", "clinvar").when(last == "2", "clinvar+gwas").when(last == "3", "gwas").otherwise("")))


DIGEST = "sha256(entry_key || '|' || substr(entry_key, 5) || '|snp|' || coalesce(CAST(code AS VARCHAR), '~') || '|' || stars || '|' || cpic_level || '|~||~|true')"


@query("wn10_fingerprint", f"SELECT snapshot_id::BIGINT AS snapshot_id, entry_key, CAST(code AS BIGINT) AS clinvar_sig_code, CAST(stars AS BIGINT) AS review_stars, cpic_level, {DIGEST} AS digest FROM ox_prints")
def _(c):
    return c.prints().select("snapshot_id", "entry_key", "clinvar_sig_code", "review_stars", "cpic_level", "digest")


@query("snk5_append_snapshot", f"SELECT CAST(snapshot_id AS VARCHAR) AS snapshot_id, entry_key, {DIGEST} AS digest FROM ox_prints")
def _(c):
    path = shared(c, "snapshots")
    entries = c.view("fx_snapshot_entries").withColumn("sample_id", F.lit(0).cast("long"))
    for snap in ("1", "2", "3", "2"):  # a repeated append changes nothing
        history.append_snapshot(entries.where(F.col("snapshot_id") == int(snap)), path, snap)
    return c.spark.read.parquet(path).select(F.col("snapshot_id").cast("string").alias("snapshot_id"), "entry_key", "digest")


BAND_ROWS = ", ".join(f"('{name}', {low}, {high}, {degree})" for name, low, high, degree in family.BANDS)


@query("jn16_predict_relationship", f"""WITH t AS (SELECT a, b, round(sum(cm), 3) AS t FROM ox_segments GROUP BY ALL), hits AS (SELECT a, b, string_agg(relationship, '; ' ORDER BY degree, relationship) AS relationships, min(degree) AS degree_low, max(degree) AS degree_high FROM t JOIN (VALUES {BAND_ROWS}) r(relationship, low, high, degree) ON t BETWEEN low AND high WHERE t BETWEEN {family.UNRELATED_CM} AND {family.ABOVE_CM} GROUP BY ALL)
 SELECT a, b, CASE WHEN t > {family.ABOVE_CM} THEN 'above_range' WHEN t < {family.UNRELATED_CM} THEN 'unrelated_or_distant' WHEN relationships IS NOT NULL THEN 'range' ELSE 'no_band' END AS state, relationships, degree_low, degree_high FROM t LEFT JOIN hits USING (a, b)""")
def _(c):
    return family.predict_relationship(family.ibd_totals(segments(c))).select("a", "b", "state", "relationships", "degree_low", "degree_high")


# the six tags stand at rs1040 to rs1045; single bases leave the deletion tag at 0 or unread
BLOOD = """SELECT sample_id, CASE WHEN abo <> 'unknown' AND rh <> 'unknown' THEN abo || CASE rh WHEN 'positive' THEN '+' ELSE '-' END ELSE 'unknown' END AS blood_type, call AS genotype_call, abo, names[abo_level + 1] AS abo_confidence, rh, names[rh_level + 1] AS rh_confidence, names[least(abo_level, rh_level) + 1] AS confidence,
 CASE WHEN d IS NOT NULL THEN CASE WHEN abo = 'unknown' THEN 'A,AB,B' WHEN NOT same THEN 'A,B' ELSE '' END WHEN b IS NULL THEN 'O,A,B,AB' WHEN b = 0 THEN 'A,O' WHEN b = 1 THEN 'AB,B' ELSE 'B,O' END AS alternatives FROM (
 SELECT *, ['none', 'low', 'moderate', 'high'] AS names, CASE WHEN call = '' THEN 'unknown' WHEN call = 'AB' THEN 'AB' ELSE substr(call, 1, 1) END AS abo, greatest(0, CASE WHEN d IS NULL THEN 0 WHEN b IS NULL OR NOT same THEN 1 WHEN b0 IS NOT NULL AND b1 IS NOT NULL THEN 3 ELSE 2 END - CAST(coalesce(d = 0 AND ld = 2, false) AS INT)) AS abo_level,
 CASE WHEN r0 IS NULL THEN 'unknown' WHEN r0 = 2 THEN 'negative' ELSE 'positive' END AS rh, CASE WHEN r0 IS NULL THEN 0 WHEN r0 = 2 THEN CASE WHEN r1 = 2 THEN 2 ELSE 1 END WHEN r1 <= 1 THEN 3 ELSE 2 END AS rh_level FROM (
 SELECT *, coalesce(b0 = b1, true) AS same, CASE WHEN d IS NULL OR b IS NULL THEN '' WHEN b = 0 THEN 'AA' WHEN b = 1 THEN 'AB' ELSE 'BB' END AS call FROM (SELECT *, CASE WHEN b0 IS NULL THEN b1 WHEN b1 IS NULL THEN b0 ELSE greatest(b0, b1) END AS b FROM (
 SELECT s.sample_id, max(CASE WHEN p.rsid = 'rs1040' AND regexp_full_match(p.gkey, '[CG][CG]') THEN 0 END) AS d, max(CASE WHEN p.rsid = 'rs1041' THEN len(p.gkey) - len(replace(p.gkey, 'T', '')) END) AS b0, max(CASE WHEN p.rsid = 'rs1042' THEN len(p.gkey) - len(replace(p.gkey, 'C', '')) END) AS b1,
 max(CASE WHEN p.rsid = 'rs1043' THEN len(p.gkey) - len(replace(p.gkey, 'C', '')) END) AS ld, max(CASE WHEN p.rsid = 'rs1044' THEN len(p.gkey) - len(replace(p.gkey, 'C', '')) END) AS r0, max(CASE WHEN p.rsid = 'rs1045' THEN len(p.gkey) - len(replace(p.gkey, 'T', '')) END) AS r1
 FROM (SELECT DISTINCT sample_id FROM ox_pooled) s LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.gkey <> 'NN' GROUP BY s.sample_id))))"""


@query("ru6_blood_group", BLOOD)
def _(c):
    tags = [traits.DECISIVE, *traits.AB_TAGS, traits.LINKED[0], *traits.RH_TAGS]
    at = F.create_map(*[F.lit(x) for k, t in enumerate(tags) for x in (f"rs{1040 + k}", t)])[F.col("rsid")]
    # markers that bear the tags' own names are no tags here
    return traits.blood_group(c.pooled().withColumn("rsid", F.coalesce(at, F.when(~F.col("rsid").isin(*tags), F.col("rsid")))))


# the deep tree: walks, how far each array could see, and counts of states
COUNTS = ", ".join(f"count(*) FILTER (state = '{k}') AS {k}" for k in ("derived", "ancestral", "discordant", "no_call", "not_on_array", "unusable"))


@query("pl6_lineage_report", tree_walk(Y_STATES, NOT_TESTED, False) + f""", depths AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION ALL SELECT m.marker_id + 1, d.depth + 1 FROM depths d JOIN fx_markers m ON m.marker_id > 0 AND (m.marker_id + 3) >> 2 = d.id),
 seen AS (SELECT sample_id, count(*) FILTER (ok) AS readable, count(*) AS in_tree, arg_max('N' || id, (depth, 'N' || id)) FILTER (ok) AS deepest_readable, max(depth) FILTER (ok) AS deepest_depth, {COUNTS} FROM (SELECT s.*, d.depth, s.state IN ('derived', 'ancestral', 'discordant') AS ok FROM sts s JOIN depths d USING (id)) GROUP BY sample_id)
 SELECT w.sample_id, CASE WHEN conflict THEN 'conflict' WHEN d > 0 THEN 'resolved' ELSE 'unresolved' END AS state, CASE WHEN d > 0 THEN 'N' || last END AS haplogroup, path, assumed, conflict, z.* EXCLUDE (sample_id), w.d AS resolved_depth, round(readable / in_tree, 4) AS coverage, no_call + not_on_array + unusable AS not_testable, derived + ancestral + discordant AS tested FROM walks w JOIN seen z USING (sample_id)""")
def _(c):
    return lineage.lineage_report(c.pooled(), deep_tree(c)).withColumns({"path": F.array_join("path", ">"), "assumed": F.array_join("assumed", ",")})


def haplotypes(c):
    t = c.view("fx_truth").join(c.view("fx_markers"), "marker_id")
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("haplotype"), F.col(f"h{k}").alias("ancestry")) for k in (1, 2)]))
    return t.select("sample_id", "chrom_no", "position", both.alias("h")).select("sample_id", "h.haplotype", "chrom_no", "position", "h.ancestry")


SEGMENTS = """SELECT sample_id, haplotype::BIGINT AS haplotype, CAST(chrom_no AS BIGINT) AS chrom_no, ancestry::BIGINT AS ancestry, min(position) AS start_bp, max(position) AS end_bp, count(*) AS markers FROM (SELECT *, sum(CASE WHEN ancestry IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, haplotype, chrom_no ORDER BY position ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, lag(ancestry) OVER (PARTITION BY sample_id, haplotype, chrom_no ORDER BY position) AS prev FROM (SELECT t.sample_id, k.k AS haplotype, m.chrom_no, m.position, CASE k.k WHEN 1 THEN t.h1 ELSE t.h2 END AS ancestry FROM fx_truth t JOIN fx_markers m ON m.marker_id = t.marker_id CROSS JOIN (VALUES (1), (2)) k(k)))) GROUP BY sample_id, haplotype, chrom_no, ancestry, g"""


@query("wn04_ancestry_segments", SEGMENTS)
def _(c):
    return ancestry.ancestry_segments(haplotypes(c))


@query("ag37_painting_totals", f"SELECT sample_id, ancestry, CAST(sum(end_bp - start_bp) AS BIGINT) AS span, round(sum((end_bp - start_bp) / l.length), 6) AS chromosomes, round(sum(end_bp - start_bp) / sum(sum(end_bp - start_bp)) OVER (PARTITION BY sample_id), 6) AS fraction FROM ({SEGMENTS}) s JOIN (SELECT chrom_no, max(position) AS length FROM fx_markers GROUP BY chrom_no) l ON l.chrom_no = s.chrom_no GROUP BY sample_id, ancestry")
def _(c):
    lengths = c.view("fx_markers").groupBy("chrom_no").agg(F.max("position").alias("length"))
    return ancestry.painting_totals(ancestry.ancestry_segments(haplotypes(c)), lengths).select("sample_id", "ancestry", "span", F.round("chromosomes", 6).alias("chromosomes"), "fraction")


#: Cells as text; columns that a scan without relatives, topics and medicines does not fill are blank.
YES_NO = "CASE WHEN {0} THEN 'yes' WHEN NOT {0} THEN 'no' ELSE '' END"
CELLS = {
    "sample_id": "CAST(sample_id AS VARCHAR)", "rsid": "rsid", "entity_type": "'snp'", "gene": "gene", "chromosome": "CAST(chrom_no AS VARCHAR)", "position": "CAST(position AS VARCHAR)", "genotype": "gkey", "zygosity": "zygosity", "magnitude": "CAST(magnitude AS VARCHAR)", "repute": "repute",
    "confidence": "confidence", "evidence": "evidence", "clinical_sig": "clinical_sig", "review_stars": "CAST(stars AS VARCHAR)", "cpic_level": "cpic_level", "conditions_list": "''", "topics": "''", "medicines": "''", "silo": "silo", "category": "category", "freq": "coalesce(CAST(freq AS VARCHAR), '')",
    "freq_band": "band", "freq_population": "'POP0'", "publications": "CAST(publications AS VARCHAR)", "variant_copies": "CAST(copies AS VARCHAR)", "carrier": YES_NO.format("(copies > 0)"), "conflict": "''", "ambiguous": "''", "interpretation": "interpretation",
}


@query("snk2_export_rows", "SELECT " + ", ".join(f"{v} AS {k}" for k, v in CELLS.items()) + " FROM ox_scored")
def _(c):
    return findings.export_rows(c.scan()["findings"])
