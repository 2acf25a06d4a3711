"""Registered queries: populations, scores, rules, families, references, history, panels, lineage, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import caveats
from ..operators import ancestry, carrier, family, history, imputed, lineage, pgx, population, provenance, prs, reference, rules, text, traits
from ..sources import tables, vcf, writers
from .queries import query

# --- populations --------------------------------------------------------------------------------

XLX = "CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0.0 END"


@query("ag17_allele_counts", "SELECT marker, pop, alt, n FROM ox_counts")
def _(c):
    gt = c.view("fx_truth").select("sample_id", F.col("marker_id").alias("marker"), F.concat(F.col("h1").cast("string"), F.lit("|"), F.col("h2").cast("string"), F.lit(":1")).alias("gt"))
    return population.allele_counts(gt, c.view("fx_truth").select("sample_id", F.col("fam").alias("pop")).distinct())


@query("ag18_derive_genotype_table", """SELECT rsid, pop, a1 || a1 AS genotype, round(f1 * f1 * 100.0, 2) AS percent FROM ox_two UNION ALL SELECT rsid, pop, a1 || a2, round(2.0 * f1 * f2 * 100.0, 2) FROM ox_two WHERE a2 IS NOT NULL
 UNION ALL SELECT rsid, pop, a2 || a2, round(f2 * f2 * 100.0, 2) FROM ox_two WHERE a2 IS NOT NULL""")
def _(c):
    return population.derive_genotype_table(c.view("fx_allele_freq"))


@query("ag19_gmaf", "SELECT rsid, arg_min(allele, (f, allele)) AS minor_allele, round(min(f), 4) AS gmaf FROM (SELECT rsid, allele, round(avg(freq), 4) AS f FROM fx_allele_freq GROUP BY ALL) GROUP BY rsid")
def _(c):
    pooled = c.view("fx_allele_freq").groupBy("rsid", "allele").agg(F.round(F.avg("freq"), 4).alias("freq"))
    return population.gmaf(pooled).select("rsid", "minor_allele", F.round("gmaf", 4).alias("gmaf"))


@query("ag20_fst", "SELECT marker, round(CASE WHEN 2.0 * p * (1 - p) > 0 THEN greatest(0.0, (2.0 * p * (1 - p) - hs) / (2.0 * p * (1 - p))) ELSE 0.0 END, 8) AS fst FROM (SELECT marker, sum(alt) / sum(n) AS p, sum(n * 2.0 * (alt / n) * (1 - alt / n)) / sum(n) AS hs FROM ox_counts GROUP BY marker)")
def _(c):
    return population.fst(c.counts()).select("marker", F.round("fst", 8).alias("fst"))


@query("ag21_one_vs_rest", "SELECT marker, pop, round(CASE WHEN ht > 0 THEN greatest(0.0, (ht - hs) / ht) ELSE 0.0 END, 8) AS score FROM (SELECT *, 2.0 * (alt + ra) / (n + rn) * (1 - (alt + ra) / (n + rn)) AS ht, (n * 2.0 * (alt / n) * (1 - alt / n) + rn * 2.0 * (ra / rn) * (1 - ra / rn)) / (n + rn) AS hs FROM (SELECT *, sum(alt) OVER (PARTITION BY marker) - alt AS ra, sum(n) OVER (PARTITION BY marker) - n AS rn FROM ox_counts))")
def _(c):
    return population.one_vs_rest(c.counts()).select("marker", "pop", F.round("score", 8).alias("score"))


@query("ag22_informativeness", f"SELECT marker, round(greatest(0.0, avg(x) - {XLX.format('avg(p)')} - {XLX.format('(1 - avg(p))')}), 8) AS informativeness FROM (SELECT marker, p, {XLX.format('p')} + {XLX.format('(1 - p)')} AS x FROM (SELECT marker, alt / n AS p FROM ox_counts)) GROUP BY marker")
def _(c):
    return population.informativeness(c.counts()).select("marker", F.round("informativeness", 8).alias("informativeness"))


@query("fl4_marker_filter", "SELECT rsid FROM fx_markers m JOIN (SELECT rsid, avg(freq) AS af FROM fx_allele_freq f WHERE allele_no = 1 GROUP BY rsid) a USING (rsid) WHERE least(af, 1 - af) >= 0.25 AND rsid IN (SELECT rsid FROM fx_ref_variants)")
def _(c):
    af = c.view("fx_allele_freq").where("allele_no = 1").groupBy("rsid").agg(F.avg("freq").alias("af"))
    return population.marker_filter(c.view("fx_markers").join(af, "rsid"), c.view("fx_ref_variants"), 0.25).select("rsid")


@query("wn06_marker_unique", "SELECT l_partkey % 500 AS pos, min(l_orderkey * 100 + l_linenumber) AS ord FROM lineitem GROUP BY ALL")
def _(c):
    rows = c.table("lineitem").select(F.lit(1).alias("chrom"), (F.col("l_partkey") % 500).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return population.marker_unique(rows, "ord").groupBy("pos").agg(F.min("ord").alias("ord"))


TOP = "SELECT pop, marker, row_number() OVER (PARTITION BY pop ORDER BY c.alt / c.n DESC, m.chrom_no, m.position, marker) AS rank FROM ox_counts c JOIN fx_markers m ON m.marker_id = marker WHERE c.alt > 0 QUALIFY rank <= 10"


@query("tk3_top_markers", TOP)
def _(c):
    stats = c.counts().select("marker", "pop", (F.col("alt") / F.col("n")).alias("score"))
    markers = c.view("fx_markers").select(F.col("marker_id").alias("marker"), F.col("chrom_no").alias("chrom"), F.col("position").alias("pos"))
    return population.top_markers(stats, markers, 10).select("pop", "marker", "rank")


@query("jn26_merge_panels", "SELECT marker_id AS marker, sample_id, CASE WHEN sample_id % 2 = 1 AND marker_id % 5 = 0 THEN './.' ELSE h1 || '|' || h2 END AS gt FROM fx_truth")
def _(c):
    gt = c.view("fx_truth").select(F.col("marker_id").alias("marker"), "sample_id", F.concat(F.col("h1").cast("string"), F.lit("|"), F.col("h2").cast("string")).alias("gt"))
    return population.merge_panels(gt.where("sample_id % 2 = 0"), gt.where("sample_id % 2 = 1 and marker % 5 <> 0"))


PANEL = """SELECT pop, marker, chrom, pos, rank, round(score, 9) AS score, round(cm, 6) AS cm FROM (SELECT *, row_number() OVER (PARTITION BY pop ORDER BY score DESC, chrom, pos, marker) AS rank FROM (
 SELECT q.marker, q.pop, m.chrom_no AS chrom, m.position AS pos, CASE WHEN ht > 0 THEN greatest(0.0, (ht - hs) / ht) ELSE 0.0 END AS score FROM (SELECT *, 2.0 * (alt + ra) / (n + rn) * (1 - (alt + ra) / (n + rn)) AS ht, (n * 2.0 * (alt / n) * (1 - alt / n) + rn * 2.0 * (ra / rn) * (1 - ra / rn)) / (n + rn) AS hs
 FROM (SELECT *, sum(alt) OVER (PARTITION BY marker) - alt AS ra, sum(n) OVER (PARTITION BY marker) - n AS rn FROM ox_counts)) q JOIN fx_markers m ON m.marker_id = q.marker) WHERE score > 0) JOIN (SELECT CAST(substr(rsid, 3) AS BIGINT) - 1000 AS marker, cm FROM ox_place) USING (marker) WHERE rank <= 100"""


@query("pl4_build_panel", PANEL)
def _(c):
    m = c.view("fx_markers").select("rsid", F.col("marker_id").alias("marker"), F.col("chrom_no").alias("chrom"), F.col("position").alias("pos"), "ref", "alt")
    gt = c.view("fx_truth").select("sample_id", F.col("marker_id").alias("marker"), F.concat(F.col("h1").cast("string"), F.lit("/"), F.col("h2").cast("string")).alias("gt"))
    panel = population.build_panel(m, gt, c.view("fx_truth").select("sample_id", F.col("fam").alias("pop")).distinct(), genetic_map=c.view("fx_genetic_map"))
    return panel.select("pop", "marker", "chrom", "pos", "rank", F.round("score", 9).alias("score"), F.round("cm", 6).alias("cm"))


# --- polygenic scores ---------------------------------------------------------------------------

MOMENTS = "SELECT model_id, sum(2.0 * eaf * weight) AS mean, sqrt(sum(2.0 * eaf * (1.0 - eaf) * weight * weight)) AS sd FROM fx_prs_weights WHERE eaf IS NOT NULL GROUP BY model_id"
PRS = f"""SELECT g.sample_id, g.model_id, round(sum(CASE WHEN d IS NOT NULL THEN d * weight ELSE coalesce(2.0 * eaf * weight, 0.0) END), 6) AS raw_score, count(d) AS variants_used, count(*) AS variants_total, round(count(d) / count(*), 4) AS coverage, bool_or(d IS NULL AND eaf IS NOT NULL) AS mean_imputed, count(d) / count(*) >= 0.9 AS reliable
 FROM (SELECT s.sample_id, w.*, CASE WHEN p.gkey <> 'NN' THEN CAST(substr(p.gkey, 1, 1) = w.effect_allele AS INT) + CAST(substr(p.gkey, 2, 1) = w.effect_allele AS INT) END AS d FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_prs_weights w LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = w.rsid) g GROUP BY g.sample_id, g.model_id"""


RAW = "sum(CASE WHEN d IS NOT NULL THEN d * weight ELSE coalesce(2.0 * eaf * weight, 0.0) END)"


@query("ag24_score_prs", f"SELECT * EXCLUDE (raw, mean, sd), round((raw - mean) / sd, 4) AS z FROM ({PRS.replace('g.model_id, ', f'g.model_id, {RAW} AS raw, ', 1)}) p LEFT JOIN ({MOMENTS}) m USING (model_id)")
def _(c):
    w = c.view("fx_prs_weights")
    return prs.score_prs(c.pooled(), w, prs.prs_moments(w)).select("sample_id", "model_id", "raw_score", "variants_used", "variants_total", "coverage", "mean_imputed", "reliable", "z")


@query("sc34_score_caveats", f"SELECT sample_id, model_id, 4 AS n, printf('This score used %.1f percent of its variants.', coverage * 100) AS said FROM ({PRS})")
def _(c):
    w = c.view("fx_prs_weights")
    rows = caveats.attach_score_caveats(prs.score_prs(c.pooled(), w, prs.prs_moments(w)))
    return rows.select("sample_id", "model_id", F.size("caveats").alias("n"), F.element_at("caveats", -1).alias("said"))


@query("sc34_imputation_caveats", "SELECT sample_id, 5 AS n, printf('%d of %d imputed variants (%.1f percent) have a quality of 0.80 or more.', a, i, 100.0 * a / i) AS said FROM (SELECT l_suppkey AS sample_id, count(*) FILTER (l_discount >= 0.08) AS a, count(*) AS i FROM lineitem GROUP BY 1)")
def _(c):
    n = c.table("lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.count_if(F.col("l_discount") >= 0.08).alias("above"), F.count(F.lit(1)).alias("imputed"))
    return caveats.attach_imputation_caveats(n).select("sample_id", F.size("caveats").alias("n"), F.element_at("caveats", -1).alias("said"))


@query("ag16_coverage_stats", "SELECT 'rows' AS key, CAST(count(*) AS VARCHAR) AS value, count(*) AS number FROM fx_ref_variants UNION ALL SELECT 'rsids', CAST(count(DISTINCT rsid) AS VARCHAR), count(DISTINCT rsid) FROM fx_ref_variants")
def _(c):
    return reference.coverage_stats(reference.reference_meta(c.view("fx_ref_variants").withColumn("source", F.lit("clinvar"))))


def chained_rules(c):
    """A rule for each marker m, by m % 5: its allele; that and rule m-1; not(m or m-1 called alt) or rule m-1; two of its allele
    and the rules m-1 and m-2; not rule m-1."""
    # Fixed values: (kind of the rule, node, parent, op, n, marker or rule by how far it lies before m)
    shapes = [(0, 1, 0, "geno", 0, 0), (1, 1, 0, "and", 0, None), (1, 2, 1, "geno", 0, 0), (1, 3, 1, "rule", 0, 1), (2, 1, 0, "or", 0, None), (2, 2, 1, "not", 0, None), (2, 3, 2, "geno", 0, 0), (2, 4, 2, "geno", 0, 1), (2, 5, 1, "rule", 0, 1),
              (3, 1, 0, "atleast", 2, None), (3, 2, 1, "geno", 0, 0), (3, 3, 1, "rule", 0, 1), (3, 4, 1, "rule", 0, 2), (4, 1, 0, "not", 0, None), (4, 2, 1, "rule", 0, 1)]
    shape = c.spark.createDataFrame(shapes, "kind int, node_id int, parent_id int, op string, n int, back int")
    m = c.view("fx_markers").select("marker_id", "rsid", "alt")
    rows = m.join(shape, F.col("marker_id") % 5 == F.col("kind")).withColumn("at", F.col("marker_id") - F.col("back"))
    rows = rows.join(m.select(F.col("marker_id").alias("at"), F.col("rsid").alias("its"), F.col("alt").alias("alleles")), "at", "left")
    leaf = F.col("op") == "geno"
    name = lambda x: F.concat(F.lit("R"), F.col(x).cast("string"))
    return rows.select(name("marker_id").alias("rule_id"), "node_id", "parent_id", "op", "n", F.when(leaf, F.coalesce("its", F.lit(""))).otherwise("").alias("rsid"), F.when(leaf, F.col("alleles")).alias("alleles"), F.when(F.col("op") == "rule", name("at")).otherwise("").alias("ref_rule"))


@query("ru2_rule_order", "SELECT 'R' || CAST(marker_id AS VARCHAR) AS rule_id, marker_id AS number, CAST(marker_id % 5 AS INT) AS level FROM fx_markers")
def _(c):
    return rules.rule_order(chained_rules(c)).select("rule_id", "number", "level")


#: Markers in blocks of five, whose calls give all five rules.
BLOCKS = """SELECT sample_id, b, R0, R1, R2, n3 >= 2 AS R3, n3 < 2 AS R4 FROM (SELECT *, CAST(l3 AS INT) + CAST(R2 AS INT) + CAST(R1 AS INT) AS n3 FROM (SELECT *, NOT (l2 OR l1) OR R1 AS R2 FROM (SELECT *, l0 AS R0, l1 AND l0 AS R1 FROM (
 SELECT s.sample_id, m.marker_id // 5 AS b, bool_or(coalesce(v, false)) FILTER (m.marker_id % 5 = 0) AS l0, bool_or(coalesce(v, false)) FILTER (m.marker_id % 5 = 1) AS l1, bool_or(coalesce(v, false)) FILTER (m.marker_id % 5 = 2) AS l2, bool_or(coalesce(v, false)) FILTER (m.marker_id % 5 = 3) AS l3
 FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_markers m LEFT JOIN (SELECT p.sample_id, p.marker_id, p.gkey LIKE '%' || m.alt || '%' AS v FROM ox_pooled p JOIN fx_markers m ON m.marker_id = p.marker_id) p ON p.sample_id = s.sample_id AND p.marker_id = m.marker_id GROUP BY ALL))))"""
EACH_RULE = f"SELECT k.sample_id, 'R' || CAST(m.marker_id AS VARCHAR) AS rule_id, m.marker_id, CASE m.marker_id % 5 WHEN 0 THEN R0 WHEN 1 THEN R1 WHEN 2 THEN R2 WHEN 3 THEN R3 ELSE R4 END AS matched FROM ({BLOCKS}) k JOIN fx_markers m ON m.marker_id // 5 = k.b"


@query("ru1_rule_for_each_marker", f"SELECT sample_id, rule_id, matched FROM ({EACH_RULE})")
def _(c):
    return rules.evaluate_rules(c.pooled(), chained_rules(c))


@query("ru1_rule_matches", f"SELECT sample_id, rule_id FROM ({EACH_RULE}) WHERE matched")
def _(c):
    return rules.rule_matches(c.pooled(), chained_rules(c))


@query("ru3_coverage_for_each_marker", f"""SELECT sample_id, rule_id, matched, required, coverage, CASE WHEN matched THEN 'matched' WHEN coverage < 1 THEN 'incomplete' ELSE 'unmatched' END AS bucket, matched AND coverage < 1 AS partial_coverage FROM (
 SELECT r.sample_id, r.rule_id, r.matched, count(*) AS required, round(count(p.rsid) / count(*), 4) AS coverage FROM ({EACH_RULE}) r JOIN (SELECT a.marker_id, b.rsid FROM fx_markers a JOIN fx_markers b ON b.marker_id // 5 = a.marker_id // 5 AND b.marker_id <= a.marker_id AND b.marker_id % 5 < 4) n ON n.marker_id = r.marker_id
 LEFT JOIN ox_pooled p ON p.sample_id = r.sample_id AND p.rsid = n.rsid AND p.gkey <> 'NN' GROUP BY ALL)""")
def _(c):
    return rules.rule_coverage(c.pooled(), chained_rules(c))


@query("ru4_order_matches", f"SELECT sample_id, rule_id, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(magnitude, 0.0) DESC, marker_id) AS place FROM (SELECT *, CASE WHEN marker_id % 4 > 0 THEN CAST(marker_id % 4 AS DOUBLE) END AS magnitude FROM ({EACH_RULE}) WHERE matched)")
def _(c):
    number = F.substring("rule_id", 2, 9).cast("int")
    rows = rules.rule_matches(c.pooled(), chained_rules(c)).select("sample_id", "rule_id", F.lit(True).alias("matched"), F.when(number % 4 > 0, (number % 4).cast("double")).alias("magnitude"))
    return rules.number_matches(rows).select("sample_id", "rule_id", "place")


def marker_rules(c):
    """A rule of one leaf for each marker."""
    return c.view("fx_markers").select(F.concat(F.lit("R"), F.col("marker_id").cast("string")).alias("rule_id"), F.lit(2).alias("node_id"), F.lit("geno").alias("op"), "rsid", F.col("alt").alias("alleles"), F.lit("").alias("ref_rule"))


PROBLEMS = (("no summary", "marker_id % 5 = 0"), ("no evidence", "marker_id % 17 = 0"), ("missing key interpretation", "true"), ("unknown silo", "marker_id % 7 = 0"), ("unknown category", "marker_id % 23 = 0"), ("magnitude out of range", "marker_id % 11 = 0"), ("unknown repute", "marker_id % 13 = 0"),
            ("marker not in the reference", "marker_id % 4 = 3"), ("refers to an unknown rule", "marker_id % 19 = 0"), ("refers to a rule that is not lower-numbered", "marker_id % 29 = 0"), ("no criteria", "marker_id % 31 = 0 AND marker_id % 19 > 0 AND marker_id % 29 > 0"))


@query("ru8_validate_rules", " UNION ALL ".join(f"SELECT 'R' || CAST(marker_id AS VARCHAR) AS rule_id, '{p}' AS problem FROM fx_markers WHERE {w}" + (" AND marker_id % 31 > 0" if p.startswith("marker not") else "") for p, w in PROBLEMS))
def _(c):
    m = c.view("fx_markers")
    odd = lambda k: F.col("marker_id") % k == 0
    name = F.concat(F.lit("R"), F.col("marker_id").cast("string"))
    texts = m.select(name.alias("rule_id"), F.when(odd(5), " ").otherwise("s").alias("summary"), F.when(odd(17), None).otherwise("e").alias("evidence"), F.when(odd(7), "other").otherwise("actionable").alias("silo"), F.when(odd(23), None).otherwise("metabolism").alias("category"), F.when(odd(22), None).when(odd(11), 10.5).otherwise(2.0).alias("magnitude"), F.when(odd(13), "Odd").otherwise("Bad").alias("repute"))
    ref = lambda rows, to: rows.select(name.alias("rule_id"), F.lit(9).alias("node_id"), F.lit("rule").alias("op"), F.lit("").alias("rsid"), F.lit("").alias("alleles"), to.alias("ref_rule"))
    lost, up = ref(m.where(odd(19)), F.lit("nowhere")), ref(m.where(odd(29)), name)
    return rules.validate_rules(texts, marker_rules(c).where("cast(substr(rule_id, 2) as bigint) % 31 > 0").unionByName(lost).unionByName(up), c.view("fx_ref_variants"), ("metabolism", "response"))


DRUGS = """SELECT sample_id, medicine, drug, CASE WHEN drug IS NOT NULL THEN gene END AS gene, CASE WHEN drug IS NOT NULL THEN phenotype END AS phenotype, CASE WHEN drug IS NULL THEN 'unmatched' WHEN phenotype = 'Indeterminate' THEN 'insufficient evidence' WHEN phenotype = 'Poor' THEN 'avoid' ELSE 'no listed effect' END AS effect
FROM (SELECT c_custkey AS sample_id, 'med' || CAST(c_custkey % 7 AS VARCHAR) AS medicine, CASE WHEN c_custkey % 7 < 5 THEN 'drug' || CAST(c_custkey % 7 AS VARCHAR) END AS drug, 'G' || CAST(c_custkey % 4 AS VARCHAR) AS gene, CASE c_custkey % 3 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Indeterminate' ELSE 'Normal' END AS phenotype, c_custkey % 7 % 4 = c_custkey % 4 AS mine FROM customer) WHERE drug IS NULL OR mine
UNION ALL SELECT c_custkey, 'foo' || CAST(c_custkey % 3 AS VARCHAR), NULL, NULL, NULL, 'unmatched' FROM customer"""


@query("jn18_match_drugs", DRUGS)
def _(c):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    text_ = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    meds = c.table("customer").select(k.alias("sample_id"), F.concat(text_("Med", k % 7), F.lit(" 20 mg daily; "), text_("Foo", k % 3), F.lit(",")).alias("text"))
    seen = c.table("customer").select(k.alias("sample_id"), text_("G", k % 4).alias("gene"), F.when(k % 3 == 0, "Poor").when(k % 3 == 1, "Indeterminate").otherwise("Normal").alias("phenotype"))
    some = c.table("nation").where("n_nationkey < 5")
    return pgx.match_drugs(meds, seen, some.select(text_("MED", n).alias("alias"), text_("drug", n).alias("drug")), some.select(text_("drug", n).alias("drug"), text_("G", n % 4).alias("gene"), F.lit("Poor").alias("phenotype"), F.lit("avoid").alias("effect")))


@query("ag25_prs_moments", f"SELECT model_id, round(mean, 9) AS mean, round(sd, 9) AS sd FROM ({MOMENTS})")
def _(c):
    return prs.prs_moments(c.view("fx_prs_weights")).select("model_id", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query("ag26_effect_allele_frequency", "SELECT w.model_id, w.rsid, round(avg(f.freq), 6) AS eaf, count(f.freq) AS panels, w.other_allele = translate(w.effect_allele, 'ACGT', 'TGCA') AS palindrome FROM fx_prs_weights w LEFT JOIN fx_allele_freq f ON f.rsid = w.rsid AND f.allele = w.effect_allele GROUP BY ALL")
def _(c):
    return prs.effect_allele_frequency(c.view("fx_prs_weights"), c.view("fx_allele_freq")).select("model_id", "rsid", F.round("eaf", 6).alias("eaf"), "panels", "palindrome")


@query("ag27_model_overlap", "SELECT w.model_id, count(*) AS variants, count(r.rsid) AS covered FROM fx_prs_weights w LEFT JOIN fx_ref_variants r ON r.rsid = w.rsid GROUP BY w.model_id")
def _(c):
    return prs.model_overlap(c.view("fx_prs_weights"), c.view("fx_ref_variants"))


@query("ag27_prs_coverage", f"SELECT sample_id, count(*) AS models, count(*) FILTER (reliable) AS reliable FROM ({PRS}) GROUP BY sample_id")
def _(c):
    w = c.view("fx_prs_weights")
    return prs.prs_coverage(prs.score_prs(c.pooled(), w, prs.prs_moments(w))).select("sample_id", "models", "reliable")


@query("ag40_check_models", f"SELECT model_id, CASE WHEN model_id = 'model3' THEN 'mean' ELSE '' END AS problems, model_id <> 'model3' AS ok FROM ({MOMENTS})")
def _(c):
    w = c.view("fx_prs_weights")
    n = w.groupBy("model_id").agg(F.count(F.lit(1)).alias("variant_count"))
    stored = prs.prs_moments(w).withColumn("mean", F.col("mean") + F.when(F.col("model_id") == "model3", 1.0).otherwise(0.0)).join(n, "model_id")
    return prs.check_models(stored, w)


@query("ag24_missing_variants", "SELECT sample_id, model_id, array_to_string(list_sort(list(rsid))[1:50], ' ') AS missing FROM (SELECT s.sample_id, w.model_id, w.rsid FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_prs_weights w LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = w.rsid AND p.gkey <> 'NN' WHERE p.rsid IS NULL) GROUP BY ALL")
def _(c):
    return prs.missing_variants(c.pooled(), c.view("fx_prs_weights")).select("sample_id", "model_id", F.array_join("missing_rsids", " ").alias("missing"))


@query("st4_coverage_sets", "SELECT true AS covered, count(*) FILTER (w.rsid IN (SELECT rsid FROM fx_ref_variants)) AS n FROM fx_prs_weights w UNION ALL SELECT false, count(*) FILTER (w.rsid NOT IN (SELECT rsid FROM fx_ref_variants)) FROM fx_prs_weights w")
def _(c):
    w, r = c.view("fx_prs_weights"), c.view("fx_ref_variants").select("rsid")
    side = lambda how, v: w.join(r, "rsid", how).agg(F.lit(v).alias("covered"), F.count(F.lit(1)).alias("n"))
    return side("left_semi", True).unionByName(side("left_anti", False))


# --- rules --------------------------------------------------------------------------------------

RULES = "SELECT sample_id, unnest(['R1', 'R2', 'R3', 'R4', 'R5', 'R6']) AS rule_id, unnest([R1, R2, R3, R4, R5, R6]) AS matched FROM ox_rules"
NEED = "(VALUES ('R1','rs1000'),('R2','rs1001'),('R2','rs1002'),('R3','rs1000'),('R3','rs1003'),('R3','rs1004'),('R4','rs1005'),('R4','rs1006'),('R4','rs1007'),('R5','rs1000'),('R5','rs1003'),('R5','rs1004'),('R5','rs1005'),('R5','rs1006'),('R5','rs1007'),('R6','rs999999')) n(rule_id, rsid)"


@query("ru1_evaluate_rules", RULES)
def _(c):
    return rules.evaluate_rules(c.pooled(), c.rules())


@query("ru3_rule_coverage", f"SELECT sample_id, rule_id, matched, required, coverage, CASE WHEN matched THEN 'matched' WHEN coverage < 1 THEN 'incomplete' ELSE 'unmatched' END AS bucket, matched AND coverage < 1 AS partial_coverage FROM (SELECT r.sample_id, r.rule_id, r.matched, count(*) AS required, round(count(p.rsid) / count(*), 4) AS coverage FROM ({RULES}) r JOIN {NEED} USING (rule_id) LEFT JOIN ox_pooled p ON p.sample_id = r.sample_id AND p.rsid = n.rsid AND p.gkey <> 'NN' GROUP BY ALL)")
def _(c):
    return rules.rule_coverage(c.pooled(), c.rules())


@query("ru5_evaluate_traits", "SELECT p.sample_id, 't' || CAST(m.marker_id % 50 AS VARCHAR) AS trait, CASE WHEN bool_or(p.gkey = m.alt || m.alt) THEN 'two' WHEN bool_or(p.gkey LIKE '%' || m.alt || '%') THEN 'some' ELSE 'none' END AS call FROM ox_pooled p JOIN fx_markers m ON m.rsid = p.rsid WHERE p.gkey <> 'NN' GROUP BY ALL")
def _(c):
    m = c.view("fx_markers").withColumn("trait", F.concat(F.lit("t"), (F.col("marker_id") % 50).cast("string")))
    row = lambda k, call, n: m.select("trait", F.lit(k).alias("rule_ord"), F.lit("any").alias("combine"), F.lit(call).alias("call"), "rsid", F.lit("min_copies").alias("kind"), F.col("alt").alias("allele"), F.lit(n).alias("n"))
    traits = m.select("trait").distinct().withColumn("default_call", F.lit("none"))
    return rules.evaluate_traits(c.pooled(), row(1, "two", 2).unionByName(row(2, "some", 1)), traits).select("sample_id", "trait", "call")


@query("ru9_source_conflicts", "SELECT sample_id, rsid, kind FROM (SELECT sample_id, rsid, unnest([CASE WHEN clinical_sig LIKE '%conflicting%' THEN 'classification_disputed' END, CASE WHEN code IN (4, 5) AND stars <= 1 THEN 'weak_review' END, CASE WHEN code IN (2, 3) AND cpic_level IN ('A', 'A/B', 'B') THEN 'benign_but_actionable' END, CASE WHEN code IN (4, 5) AND repute = 'Good' THEN 'repute_against_classification' END, CASE WHEN code IN (2, 3) AND repute = 'Bad' THEN 'repute_against_classification' END, CASE WHEN conflict THEN 'kits_disagree' END]) AS kind FROM ox_scored) WHERE kind IS NOT NULL")
def _(c):
    s = c.scan()
    f = s["findings"].join(s["pooled"].select("sample_id", "rsid", "conflict"), ["sample_id", "rsid"])
    return rules.source_conflicts(f).select("sample_id", "rsid", "kind")


# --- families -----------------------------------------------------------------------------------

TRIO = "SELECT fam, rsid, (CAST(least(substr(m,1,1),substr(f,1,1)) || greatest(substr(m,1,1),substr(f,1,1)) = c AS INT) + CAST(least(substr(m,1,1),substr(f,2,1)) || greatest(substr(m,1,1),substr(f,2,1)) = c AS INT) + CAST(least(substr(m,2,1),substr(f,1,1)) || greatest(substr(m,2,1),substr(f,1,1)) = c AS INT) + CAST(least(substr(m,2,1),substr(f,2,1)) || greatest(substr(m,2,1),substr(f,2,1)) = c AS INT)) / 4.0 AS probability FROM ox_family WHERE m IS NOT NULL AND f IS NOT NULL"


@query("jn04_trio_check", TRIO)
def _(c):
    return family.trio_check(c.member(0), c.member(1), c.member(2)).select("fam", "rsid", "probability")


@query("jn04_trio_summary", f"SELECT fam, count(*) AS compared, count(*) FILTER (probability = 0) AS violations, round(count(*) FILTER (probability = 0) / count(*), 4) AS violation_rate FROM ({TRIO}) GROUP BY fam")
def _(c):
    return family.trio_summary(family.trio_check(c.member(0), c.member(1), c.member(2)))


@query(
    "jn05_phase_by_parents",
    """SELECT fam, rsid, CASE WHEN m IS NULL AND f IS NULL THEN 'no_parent_data' WHEN (m IS NOT NULL AND NOT (contains(m, substr(c,1,1)) OR contains(m, substr(c,2,1)))) OR (f IS NOT NULL AND NOT (contains(f, substr(c,1,1)) OR contains(f, substr(c,2,1)))) THEN 'inconsistent' WHEN substr(c,1,1) = substr(c,2,1) THEN 'child_homozygous'
    WHEN m IS NOT NULL AND substr(m,1,1) = substr(m,2,1) AND contains(c, substr(m,1,1)) THEN 'mother_homozygous' WHEN f IS NOT NULL AND substr(f,1,1) = substr(f,2,1) AND contains(c, substr(f,1,1)) THEN 'father_homozygous'
    WHEN m IS NOT NULL AND f IS NOT NULL AND ((contains(m, substr(c,1,1)) AND NOT contains(f, substr(c,1,1)) AND contains(f, substr(c,2,1)) AND NOT contains(m, substr(c,2,1))) OR (contains(m, substr(c,2,1)) AND NOT contains(f, substr(c,2,1)) AND contains(f, substr(c,1,1)) AND NOT contains(m, substr(c,1,1)))) THEN 'exclusive_alleles' ELSE 'ambiguous' END AS basis FROM ox_family""",
)
def _(c):
    return family.phase_by_parents(c.member(0), c.member(1), c.member(2)).select("fam", "rsid", "basis")


LIFT = "SELECT m.rsid, CASE WHEN b.t_start IS NULL THEN CASE WHEN m.position - 1 >= k.st AND m.position - 1 < k.e THEN 'gap in the chain' ELSE 'no chain' END ELSE 'mapped' END AS status, CASE WHEN b.strand = '-' THEN b.q_start + 400000 - b.q_start - (m.position - 1 - b.t_start) ELSE b.q_start + (m.position - 1 - b.t_start) + 1 END AS new_position, CASE WHEN b.strand = '-' THEN translate(m.ref, 'ACGT', 'TGCA') WHEN b.strand = '+' THEN m.ref END AS new_allele FROM fx_markers m LEFT JOIN (SELECT chrom_no, max(t_end) AS e, min(t_start) AS st FROM fx_chain_blocks GROUP BY chrom_no) k ON k.chrom_no = m.chrom_no LEFT JOIN fx_chain_blocks b ON b.chrom_no = m.chrom_no AND m.position - 1 >= b.t_start AND m.position - 1 < b.t_end"


@query("jn11_liftover", LIFT)
def _(c):
    calls = c.view("fx_markers").select("rsid", "chrom_no", "position", F.col("ref").alias("allele1"), F.col("alt").alias("allele2"))
    return family.liftover(calls, c.view("fx_chain_blocks")).select("rsid", "status", "new_position", F.col("new_allele1").alias("new_allele"))


@query("jn12_centimorgans", "SELECT rsid, round(cm, 6) AS cm FROM ox_place")
def _(c):
    return family.place_on_map(c.view("fx_markers"), c.view("fx_genetic_map"), "position", "cm").select("rsid", F.round("cm", 6).alias("cm"))


@query("jn15_sample_pairs", "SELECT a, b, CAST(ibs AS BIGINT) AS ibs, count(*) AS n FROM ox_ibs GROUP BY ALL")
def _(c):
    t = c.truth()
    return family.sample_pairs(t, family.household_pairs(t)).groupBy("a", "b", "ibs").agg(F.count(F.lit(1)).alias("n"))


def segments(c):
    t = c.truth()
    ibs = c.held("ibs", lambda: family.sample_pairs(t, family.household_pairs(t)))
    return c.held("segments", lambda: family.ibd_segments(ibs, c.view("fx_genetic_map"), min_snps=20, min_cm=0.5, max_oh=0))


@query("wn03_ibd_segments", "SELECT a, b, CAST(chrom_no AS BIGINT) AS chrom_no, start_bp, end_bp, snps, cm FROM ox_segments")
def _(c):
    return segments(c).select("a", "b", "chrom_no", "start_bp", "end_bp", "snps", "cm")


@query("ag32_ibd_totals", "SELECT a, b, round(sum(cm), 3) AS total_cm, round(max(cm), 4) AS longest_cm, count(*) AS segments FROM ox_segments GROUP BY ALL")
def _(c):
    return family.ibd_totals(segments(c)).select("a", "b", F.round("total_cm", 3).alias("total_cm"), "longest_cm", "segments")


HOUSE = "SELECT k.a, k.b, k.x, k.y, coalesce(sum(s.cm), 0.0) AS t FROM (SELECT DISTINCT u.sample_id AS a, v.sample_id AS b, u.member AS x, v.member AS y FROM fx_kits u JOIN fx_kits v ON u.fam = v.fam AND u.sample_id < v.sample_id) k LEFT JOIN ox_segments s ON s.a = k.a AND s.b = k.b GROUP BY ALL"


@query("pl3_household", f"SELECT a, b, round(t, 3) AS total_cm, CASE WHEN t BETWEEN CASE WHEN x = 1 AND y = 2 THEN 0 WHEN x = 0 AND y = 3 THEN 2200 ELSE 3200 END AND CASE WHEN x = 1 AND y = 2 THEN 90 WHEN x = 0 AND y = 3 THEN 3400 ELSE 3800 END THEN 'agrees' ELSE 'disagrees' END AS verdict FROM ({HOUSE})")
def _(c):
    t = c.truth()
    role = F.element_at(F.array(*[F.lit(r) for r in ("self", "mother", "father", "sibling")]), (F.col("member") + 1).cast("int"))
    samples = t.select("sample_id", "fam", role.alias("role")).distinct()
    return family.household(t, samples, c.view("fx_genetic_map"), min_snps=20, min_cm=0.5, max_oh=0).select("a", "b", F.round("total_cm", 3).alias("total_cm"), "verdict")


@query("ag38_chromosome_browser", "SELECT p.a, p.b, CAST(n.chrom_no AS BIGINT) AS chrom_no, count(s.cm) AS segments, round(max(s.end_bp / 250000000.0), 6) AS last FROM (SELECT DISTINCT a, b FROM ox_segments) p CROSS JOIN (SELECT DISTINCT chrom_no FROM fx_markers) n LEFT JOIN ox_segments s ON s.a = p.a AND s.b = p.b AND s.chrom_no = n.chrom_no GROUP BY ALL")
def _(c):
    lengths = c.view("fx_markers").select("chrom_no").distinct().withColumn("length", F.lit(250_000_000))
    b = family.chromosome_browser(segments(c), lengths)
    return b.groupBy("a", "b", "chrom_no").agg(F.count("cm").alias("segments"), F.max("end_frac").alias("last"))


# --- references ---------------------------------------------------------------------------------


@query("ag13_best_clinvar", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, CASE o_orderkey % 8 WHEN 5 THEN 6 WHEN 4 THEN 5 WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 1 THEN 2 ELSE 1 END DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(c):
    o = c.table("orders").withColumns({"stars": F.col("o_orderkey") % 5, "code": F.col("o_orderkey") % 8})
    return reference.best_record(o, "o_custkey", "stars", "code", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("ag14_replicated_gwas", "SELECT k, count(DISTINCT study) AS studies, array_to_string(list_sort(list(DISTINCT trait)), '; ') AS traits, count(DISTINCT paper) AS papers, arg_min(allele, (ord, allele)) AS risk_allele FROM ox_gwas WHERE mlog >= 7.3 GROUP BY k HAVING count(DISTINCT study) >= 2")
def _(c):
    li = c.table("lineitem")
    rows = li.select((F.col("l_partkey") % 97).alias("k"), (F.col("l_orderkey") % 50).alias("study"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("trait"), F.col("l_suppkey").alias("paper"), F.substring(F.lit("ACGT"), (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("allele"), (F.col("l_quantity") / 4).alias("mlog"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    rows = rows.withColumn("ord", F.struct("ord", "allele"))
    return reference.replicated(reference.significant(rows), "k", "study", F.col("trait"), "paper", "allele", "ord")


@query("fl5_significant", "SELECT l_returnflag, count(*) AS n FROM ox_gwas WHERE mlog >= 7.3 GROUP BY ALL")
def _(c):
    li = c.table("lineitem").select("l_returnflag", (F.col("l_quantity") / 4).alias("mlog"), F.col("l_orderkey").alias("study"))
    return reference.significant(li).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_gene_levels", "SELECT r.rsid, r.gene, coalesce(arr[b.k], '') AS cpic_level FROM fx_ref_variants r LEFT JOIN (SELECT gene, min(list_position(['A', 'A/B', 'B', 'B/C', 'C', 'C/D', 'D', 'Retired'], cpic_level)) AS k, ['A', 'A/B', 'B', 'B/C', 'C', 'C/D', 'D', 'Retired'] AS arr FROM fx_ref_variants WHERE cpic_level <> '' GROUP BY gene) b ON b.gene = r.gene")
def _(c):
    r = c.view("fx_ref_variants")
    return reference.gene_levels(r.select("rsid", "gene"), r.select("gene", F.col("cpic_level").alias("level")))


@query("ag15_build_reference_table", "SELECT coalesce(a.rsid, b.rsid) AS rsid, greatest(coalesce(a.publications, 0), coalesce(b.papers, 0))::BIGINT AS publications, coalesce(a.risk_allele, 'T') AS risk_allele, CASE WHEN a.rsid IS NULL THEN 'gwas' WHEN b.rsid IS NULL THEN 'clinvar' ELSE 'clinvar+gwas' END || CASE WHEN a.gene LIKE '%1' THEN '+cpic' ELSE '' END AS source FROM (SELECT * FROM fx_ref_variants WHERE publications % 2 = 0) a FULL JOIN (SELECT rsid, marker_id % 300 AS papers FROM fx_markers WHERE marker_id % 3 = 0) b ON b.rsid = a.rsid")
def _(c):
    r = c.view("fx_ref_variants").where("publications % 2 = 0").withColumn("review_stars", F.lit(1))
    g = c.view("fx_markers").where("marker_id % 3 = 0").select("rsid", F.lit("t").alias("traits"), F.lit(2).alias("studies"), (F.col("marker_id") % 300).alias("papers"), F.lit("T").alias("risk_allele"))
    levels = c.view("fx_ref_variants").where("gene like '%1'").select("gene", F.lit("B").alias("level")).distinct()
    return reference.build_reference_table(r, g, levels).select("rsid", "publications", "risk_allele", "source")


@query("jn27_refresh_reference", "SELECT rsid, CASE WHEN CAST(substr(rsid, 3) AS BIGINT) % 2 = 0 THEN 'benign' ELSE clinical_sig END AS clinical_sig, CAST(substr(rsid, 3) AS BIGINT) % 2 = 0 AND clinical_sig <> 'benign' AS updated FROM fx_ref_variants")
def _(c):
    r = c.view("fx_ref_variants").withColumn("conditions", F.lit("x"))
    fresh = r.select("rsid", F.when(F.substring("rsid", 3, 20).cast("long") % 2 == 0, "benign").otherwise("").alias("clinical_sig"), F.lit("").alias("conditions"))
    return reference.refresh_reference(r, fresh).select("rsid", "clinical_sig", "updated")


@query("jn28_build_curated", "SELECT l_partkey, min(l_orderkey * 100 + l_linenumber) AS ord FROM lineitem GROUP BY l_partkey")
def _(c):
    rows = c.table("lineitem").select("l_partkey", F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("rsid"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return reference.build_curated(rows, c.view("fx_ref_variants"), "ord").groupBy("l_partkey").agg(F.min("ord").alias("ord"))


@query("ag39_duplicate_keys", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(c):
    return reference.duplicate_keys(c.table("lineitem"), "l_orderkey", "l_linenumber")


@query("jn19_reconcile_definitions", "SELECT 'g' || CAST(marker_id % 40 AS VARCHAR) AS gene, CASE WHEN bool_or(marker_id % 7 = 0) THEN 'conflict' WHEN bool_or(marker_id % 11 = 0) THEN 'rsid_not_in' ELSE 'confirmed' END AS verdict FROM fx_markers GROUP BY ALL")
def _(c):
    m = c.view("fx_markers").withColumns({"gene": F.concat(F.lit("g"), (F.col("marker_id") % 40).cast("string")), "allele": F.lit("*2")})
    local = m.select("gene", "allele", "rsid", F.col("alt").alias("base"))
    ext = m.where("marker_id % 11 <> 0 or marker_id % 7 = 0").select("gene", "allele", "rsid", F.when(F.col("marker_id") % 7 == 0, F.col("ref")).otherwise(F.col("alt")).alias("base"))
    return reference.reconcile_definitions(local, ext).select("gene", "verdict")


@query("jn20_audit_markers", "SELECT rsid AS node, CASE marker_id % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'consistent' WHEN 2 THEN 'multi_allelic' ELSE CASE WHEN least(ref, alt) || greatest(ref, alt) IN ('AT', 'CG') THEN 'consistent' ELSE 'strand' END END AS verdict FROM fx_markers")
def _(c):
    m = c.view("fx_markers")
    tree = m.select(F.col("rsid").alias("node"), "rsid", F.col("ref").alias("ancestral"), F.col("alt").alias("derived"))
    flip = lambda x: F.when(F.col("marker_id") % 4 == 3, F.translate(x, "ACGT", "TGCA")).otherwise(F.col(x))
    third = F.array_except(F.array(*[F.lit(b) for b in "ACGT"]), F.array("ref", "alt"))[0]
    rec = m.where("marker_id % 4 <> 0").select("rsid", flip("ref").alias("ref"), F.when(F.col("marker_id") % 4 == 2, F.array(F.col("alt"), third)).otherwise(F.array(flip("alt"))).alias("alts"))
    return reference.audit_markers(tree, rec).select("node", "verdict")


# --- history ------------------------------------------------------------------------------------

CHANGED = "SELECT o.snapshot_id AS from_id, n.snapshot_id AS to_id, coalesce(o.entry_key, n.entry_key) AS entry_key, o.entry_key IS NULL AS added, n.entry_key IS NULL AS removed, o.code IS DISTINCT FROM n.code AS sig, o.stars <> n.stars AS stars, n.stars > o.stars AS more, o.cpic_level <> n.cpic_level AS lvl FROM (SELECT * FROM ox_prints WHERE snapshot_id = {0}) o FULL JOIN (SELECT * FROM ox_prints WHERE snapshot_id = {1}) n ON n.entry_key = o.entry_key"
KINDS = "SELECT CASE WHEN added THEN ['added'] WHEN removed THEN ['removed'] ELSE list_filter([CASE WHEN sig THEN 'sig' END, CASE WHEN stars THEN CASE WHEN more THEN 'stars_gained' ELSE 'stars_lost' END END, CASE WHEN lvl THEN 'cpic_level_changed' END], lambda x: x IS NOT NULL) END AS k, entry_key, {0} AS step FROM (" + CHANGED + ")"


def coarse():
    return F.when(F.col("kind") == "finding_added", "added").when(F.col("kind") == "finding_removed", "removed").when(F.col("field") == "clinvar_sig_code", "sig").otherwise(F.col("kind"))


@query("jn23_diff_snapshots", "SELECT entry_key, unnest(k) AS kind FROM (" + KINDS.format(1, 2) + ")")
def _(c):
    p = c.prints()
    return history.diff_pairs(p.where("snapshot_id = 1"), p.where("snapshot_id = 2"), ["entry_key"]).select("entry_key", coarse().alias("kind"))


@query("wn07_change_history", "SELECT to_id::BIGINT AS to_id, kind, count(*) AS n FROM (SELECT 2 AS to_id, unnest(k) AS kind FROM (" + KINDS.format(1, 2) + ") UNION ALL SELECT 3, unnest(k) FROM (" + KINDS.format(2, 3) + ")) GROUP BY ALL")
def _(c):
    rows = history.change_history(c.prints()).withColumn("kind", coarse())
    return rows.groupBy(F.col("to_id").alias("to_id"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("wn08_prune_snapshots", "SELECT 0::BIGINT AS sample_id, snapshot_id::BIGINT AS snapshot_id FROM (SELECT DISTINCT snapshot_id FROM fx_snapshot_entries) WHERE snapshot_id < 3")
def _(c):
    return history.prune_snapshots(c.prints(), 1).select("sample_id", "snapshot_id")


@query("wn08_latest_snapshot", "SELECT 0::BIGINT AS sample_id, max(snapshot_id)::BIGINT AS snapshot_id FROM fx_snapshot_entries")
def _(c):
    return history.latest_snapshot(c.prints())


@query("wn09_addendum", "SELECT 0::BIGINT AS sample_id, 2::BIGINT AS from_id, 3::BIGINT AS to_id, false AS baseline, count(*) AS changes FROM (SELECT unnest(k) FROM (" + KINDS.format(2, 3) + "))")
def _(c):
    return history.addendum(c.prints()).select("sample_id", "from_id", "to_id", "baseline", "changes")


@query("st3_unchanged", "SELECT n.entry_key FROM ox_prints o JOIN ox_prints n ON o.entry_key = n.entry_key AND o.snapshot_id = 1 AND n.snapshot_id = 2 WHERE o.code IS NOT DISTINCT FROM n.code AND o.stars = n.stars AND o.cpic_level = n.cpic_level")
def _(c):
    p = c.prints()
    return history.unchanged(p.where("snapshot_id = 1"), p.where("snapshot_id = 2")).select("entry_key")


@query("jn24_version_diff", "SELECT coalesce(o.c, n.c) AS source, coalesce(CAST(o.v AS VARCHAR), '') AS old, coalesce(CAST(n.v AS VARCHAR), '') AS new FROM (SELECT r_name AS c, r_regionkey AS v FROM region WHERE r_regionkey < 4) o FULL JOIN (SELECT r_name AS c, r_regionkey * 2 AS v FROM region WHERE r_regionkey > 0) n ON n.c = o.c WHERE o.v IS DISTINCT FROM n.v")
def _(c):
    r = c.table("region")
    old = r.where("r_regionkey < 4").select(F.col("r_name").alias("source"), F.col("r_regionkey").cast("string").alias("version"))
    return history.version_diff(old, r.where("r_regionkey > 0").select(F.col("r_name").alias("source"), (F.col("r_regionkey") * 2).cast("string").alias("version")))


# --- star alleles, carriers ---------------------------------------------------------------------

COPIES = "(SELECT s.sample_id, d.gene, d.allele, d.rsid, CASE WHEN d.base IS NOT NULL AND p.gkey <> 'NN' THEN CAST(substr(p.gkey, 1, 1) = d.base AS INT) + CAST(substr(p.gkey, 2, 1) = d.base AS INT) END AS n FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_allele_defs d LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = d.rsid)"
STATUS = f"SELECT sample_id, gene, allele, CASE WHEN count(n) < count(*) THEN 'untestable' WHEN min(n) > 0 THEN 'present' ELSE 'absent' END AS status, CASE WHEN count(n) = count(*) THEN CAST(min(n) AS BIGINT) END AS copies FROM {COPIES} GROUP BY ALL"


@query("ag35_allele_status", STATUS)
def _(c):
    return pgx.allele_status(c.pooled(), c.view("fx_allele_defs")).select("sample_id", "gene", "allele", "status", "copies")


# gene G1: *3 (two positions) before *2 (one of these) before *17; gene G2: *4, then *5
SLOTS = f"""SELECT *, 2 - t3 - t2 - t17 - t4 - t5 AS r FROM (SELECT *, CASE WHEN gene = 'G1' THEN least(coalesce(n12, 0), 2 - t3 - t2) ELSE 0 END AS t17, CASE WHEN gene = 'G2' THEN coalesce(n13, 0) ELSE 0 END AS t4, CASE WHEN gene = 'G2' THEN least(coalesce(n5, 0), 2 - coalesce(n13, 0)) ELSE 0 END AS t5 FROM (
 SELECT *, coalesce(n10, 0) - t3 AS t2 FROM (SELECT *, CASE WHEN n10 > 0 AND n11 > 0 THEN least(n10, n11) ELSE 0 END AS t3 FROM (
 SELECT sample_id, gene, max(n) FILTER (rsid = 'rs1010') AS n10, max(n) FILTER (rsid = 'rs1011') AS n11, max(n) FILTER (rsid = 'rs1012') AS n12, max(n) FILTER (rsid = 'rs1013') AS n13, max(n) FILTER (rsid = 'rs999998') AS n5 FROM {COPIES} GROUP BY ALL))))"""
DIPLOTYPES = f"""SELECT *, CASE WHEN tested THEN rtrim(repeat('*1/', CAST(r AS INT)) || repeat('*2/', CAST(t2 AS INT)) || repeat('*3/', CAST(t3 AS INT)) || repeat('*4/', CAST(t4 AS INT)) || repeat('*5/', CAST(t5 AS INT)) || repeat('*17/', CAST(t17 AS INT)), '/') END AS diplotype,
 CASE gene WHEN 'G1' THEN r + 1.5 * t17 ELSE r + 0.5 * t4 END AS score
 FROM (SELECT *, CASE gene WHEN 'G1' THEN n10 IS NOT NULL OR n12 IS NOT NULL ELSE n13 IS NOT NULL OR n5 IS NOT NULL END AS tested, CASE gene WHEN 'G1' THEN n10 IS NULL OR n11 IS NULL OR n12 IS NULL ELSE n13 IS NULL OR n5 IS NULL END AS unread FROM ({SLOTS}))"""


@query("wn11_assign_slots", f"SELECT sample_id, gene, diplotype, r > 0 AND tested AS reference_inferred FROM ({DIPLOTYPES})")
def _(c):
    return pgx.assign_slots(c.pooled(), c.view("fx_allele_defs")).select("sample_id", "gene", "diplotype", "reference_inferred")


@query("wn12_phenotype", f"SELECT sample_id, gene, CASE WHEN NOT tested OR (r > 0 AND unread) THEN 'Indeterminate' WHEN score < 1 THEN 'Poor' WHEN score < 2 THEN 'Intermediate' WHEN gene = 'G1' AND score > 2 THEN 'Rapid' ELSE 'Normal' END AS phenotype FROM ({DIPLOTYPES})")
def _(c):
    d = pgx.assign_slots(c.pooled(), c.view("fx_allele_defs"))
    listed = c.view("fx_allele_defs").select("gene", "allele", "activity").distinct()
    acts = listed.unionByName(listed.select("gene").distinct().select("gene", F.lit("*1").alias("allele"), F.lit(1.0).alias("activity")))
    rows = [("G1", 2.25, None, "Rapid"), ("G1", 2.0, 2.25, "Normal"), ("G1", 1.0, 2.0, "Intermediate"), ("G1", None, 1.0, "Poor"), ("G2", 2.0, None, "Normal"), ("G2", 1.0, 2.0, "Intermediate"), ("G2", None, 1.0, "Poor")]
    bands = c.spark.createDataFrame(rows, "gene string, low double, high double, phenotype string")
    return pgx.phenotype(d, acts, bands).select("sample_id", "gene", "phenotype")


PANEL = "SELECT p_brand AS gene, rsid, alt AS allele, marker_id % 4 <> 3 AS testable FROM fx_markers JOIN part ON p_partkey = marker_id"


def panel(c):
    p = c.table("part").select(F.col("p_partkey").cast("long").alias("marker_id"), F.col("p_brand").alias("gene"))
    return c.view("fx_markers").join(p, "marker_id").select("gene", "rsid", F.col("alt").alias("allele"), (F.col("marker_id") % 4 != 3).alias("array_testable"))


@query("ag33_carrier_status", f"SELECT sample_id, gene, CASE WHEN count(*) FILTER (n > 0) > 0 THEN 'carrier' WHEN count(n) > 0 THEN 'not_carrier_for_tested_variants' ELSE 'untestable' END AS status, count(n) AS tested, count(*) FILTER (n > 0) AS detected, count(*) FILTER (testable AND n IS NULL) AS not_read, count(*) FILTER (NOT testable) AS not_array_testable FROM (SELECT s.sample_id, g.*, CASE WHEN g.testable AND p.gkey <> 'NN' THEN CAST(substr(p.gkey, 1, 1) = g.allele AS INT) + CAST(substr(p.gkey, 2, 1) = g.allele AS INT) END AS n FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN ({PANEL}) g LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = g.rsid) GROUP BY ALL")
def _(c):
    return carrier.carrier_status(c.pooled(), panel(c)).drop("copies")


@query("ag34_gene_screen_coverage", f"SELECT s.sample_id, g.gene, count(p.rsid) AS read, round(count(p.rsid) / 10.0, 6) AS fraction FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN ({PANEL}) g LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = g.rsid AND p.gkey <> 'NN' GROUP BY ALL")
def _(c):
    return carrier.gene_screen_coverage(c.pooled(), panel(c).select("gene", "rsid", F.lit(10).alias("known")))


@query("jn25_couple_risk", "SELECT c.sample_id AS a, c.sample_id + 1 AS b, 'g' AS gene, round((c.sample_id + 1) / 100.0 * (c.sample_id + 2) / 100.0 * 0.25, 9) AS point, round((c.sample_id + 1) / 100.0 * (c.sample_id + 2) / 100.0 * 0.125, 9) AS low, round(least(0.25, (c.sample_id + 1) / 100.0 * (c.sample_id + 2) / 100.0 * 0.5), 9) AS high FROM (SELECT DISTINCT sample_id FROM ox_pooled) c WHERE c.sample_id % 4 = 1")
def _(c):
    s = c.pooled().select("sample_id").distinct()
    risks = s.select("sample_id", F.lit("g").alias("gene"), F.lit("autosomal recessive").alias("inheritance"), ((F.col("sample_id") + 1) / 100).alias("risk"), F.lit(False).alias("verified"))
    couples = s.where("sample_id % 4 = 1").select(F.col("sample_id").alias("a"), (F.col("sample_id") + 1).alias("b"))
    return carrier.couple_risk(couples, risks).select("a", "b", "gene", *[F.round(x, 9).alias(x) for x in ("point", "low", "high")])


# --- lineage, ancestry, imputation --------------------------------------------------------------


@query("wn14_marker_states", "SELECT sample_id, node, state FROM ox_states")
def _(c):
    return lineage.marker_states(c.pooled(), c.view("fx_tree")).select("sample_id", "node", "state")


# the fixture tree: A or B; below B are B1, never on the array, with B1a, and B2
WALK = """SELECT sample_id, CASE WHEN NOT has THEN 'no_data' WHEN c1 OR c2 THEN 'conflict' WHEN hap = 'root' THEN 'unresolved' ELSE 'resolved' END AS state, CASE WHEN has AND hap <> 'root' THEN hap END AS haplogroup FROM (SELECT *, CASE WHEN top <> 'B' THEN top WHEN b1 AND b2 THEN 'B' WHEN b2 THEN 'B2' WHEN (b1 OR u1) AND b1a THEN 'B1a' WHEN b1 THEN 'B1' ELSE 'B' END AS hap, top = 'B' AND b1 AND b2 AS c2 FROM (SELECT *, da AND db AS c1,
 CASE WHEN da AND db THEN 'root' WHEN da THEN 'A' WHEN db THEN 'B' WHEN ub AND (b1 OR b2 OR b1a) THEN 'B' ELSE 'root' END AS top FROM (SELECT sample_id, bool_or(state IN ('derived', 'ancestral', 'discordant')) AS has, bool_or(node = 'A' AND state = 'derived') AS da, bool_or(node = 'B' AND state = 'derived') AS db, bool_or(node = 'B' AND state IN ('no_call', 'not_on_array', 'unusable')) AS ub, bool_or(node = 'B1' AND state = 'derived') AS b1, bool_or(node = 'B1' AND state IN ('no_call', 'not_on_array', 'unusable')) AS u1, bool_or(node = 'B2' AND state = 'derived') AS b2, bool_or(node = 'B1a' AND state = 'derived') AS b1a FROM ox_states GROUP BY sample_id)))"""


@query("wn13_lineage_walk", WALK)
def _(c):
    t = c.view("fx_tree")
    return lineage.lineage_walk(lineage.marker_states(c.pooled(), t), t).select("sample_id", "state", "haplogroup")


@query("wn15_resolution_ceiling", "SELECT sample_id, count(*) FILTER (state IN ('derived', 'ancestral', 'discordant')) AS readable, count(*) AS in_tree, round(count(*) FILTER (state IN ('derived', 'ancestral', 'discordant')) / count(*), 4) AS coverage FROM ox_states GROUP BY sample_id")
def _(c):
    t = c.view("fx_tree")
    s = lineage.marker_states(c.pooled(), t)
    return lineage.resolution_ceiling(s, t, lineage.lineage_walk(s, t)).select("sample_id", "readable", "in_tree", "coverage")


# a tree of four children a node over the parts
@query("wn17_tree_closure", "SELECT CAST(id AS VARCHAR) AS node, CAST(id >> (2 * k) AS VARCHAR) AS ancestor, k AS steps, max(k) OVER (PARTITION BY id) AS depth FROM (SELECT CAST(p_partkey AS BIGINT) + 1 AS id FROM part), (SELECT CAST(unnest(range(1, 31)) AS INT) AS k) WHERE id >> (2 * k) > 0")
def _(c):
    n = F.col("p_partkey").cast("long") + 1
    up = F.shiftright(n, 2)
    return lineage.tree_closure(c.table("part").select(n.cast("string").alias("node"), F.when(up > 0, up.cast("string")).otherwise("").alias("parent")))


def deep_tree(c):
    """A tree of four children a node over the markers; a marker in four defines no node that an array could read."""
    i, up = F.col("marker_id") + 1, F.shiftright(F.col("marker_id") + 3, 2)
    name = lambda x: F.concat(F.lit("N"), x.cast("string"))
    lost = F.col("marker_id") % 4 == 3
    return c.view("fx_markers").select(name(i).alias("node"), F.when(i > 1, name(up)).otherwise("").alias("parent"), F.when(lost, "").otherwise(F.col("rsid")).alias("rsid"), F.col("ref").alias("ancestral"), F.when(~lost, F.col("alt")).alias("derived"))


def mt_fixture(c):
    """Pooled calls of which three markers in four lie on the mitochondrion, and one or two positions for each node of the tree."""
    m = c.view("fx_markers").select("marker_id", "rsid", "alt")
    here = F.when(F.col("marker_id") % 4 != 3, F.element_at(F.array(F.lit("MT"), F.lit("chrM"), F.lit("26")), (F.col("marker_id") % 3 + 1).cast("int"))).otherwise("7")
    pooled = c.pooled().drop("chromosome", "position").join(m.select("rsid", "marker_id"), "rsid").select("sample_id", "rsid", "allele1", "allele2", here.alias("chromosome"), (F.col("marker_id") + 1).alias("position"))
    first = m.select(F.col("marker_id").alias("owner"), "marker_id", "rsid", "alt")
    second = m.where("marker_id % 3 = 1").select((F.col("marker_id") - 1).alias("owner"), "marker_id", "rsid", "alt")
    defining = first.unionByName(second).select(F.concat(F.lit("N"), (F.col("owner") + 1).cast("string")).alias("node"), (F.col("marker_id") + 1).alias("position"), F.col("alt").alias("base"), F.when(F.col("marker_id") % 2 == 0, F.col("rsid")).alias("rsid"), (F.col("marker_id") % 5 > 0).alias("verified"))
    return pooled, defining.where("node <> 'N1'")


MT_DEFINING = "(SELECT d.id, m.marker_id, m.alt, m.marker_id % 5 > 0 AS verified FROM (SELECT marker_id + 1 AS id, marker_id FROM fx_markers UNION ALL SELECT marker_id, marker_id FROM fx_markers WHERE marker_id % 3 = 1) d JOIN fx_markers m ON m.marker_id = d.marker_id WHERE d.id > 1)"
MT_STATES = f"SELECT p.sample_id, d.id, p.marker_id + 1 AS position, d.verified, CASE WHEN p.gkey = 'NN' THEN 'no_call' WHEN contains(p.gkey, d.alt) THEN 'derived' ELSE 'ancestral' END AS state FROM {MT_DEFINING} d JOIN ox_pooled p ON p.marker_id = d.marker_id WHERE p.marker_id % 4 <> 3"


def tree_walk(states: str, gap: str, best: bool) -> str:
    """Walks by recursion: what each parent's children say, then step by step from the root."""
    one = "n_good = 1 OR (n_good > 1 AND n_top = 1)" if best else "n_good = 1"
    return f"""WITH RECURSIVE sts AS MATERIALIZED ({states}), sup AS MATERIALIZED (SELECT sample_id, id, count(*) FILTER (state = 'derived') AS support, count(*) FILTER (state IN ('ancestral', 'discordant')) AS against FROM sts WHERE state IN ('derived', 'ancestral', 'discordant') GROUP BY ALL),
 good AS MATERIALIZED (SELECT * FROM sup WHERE support > 0 AND against = 0), ups AS (SELECT sample_id, id, id AS spot FROM good UNION SELECT sample_id, id, (spot + 2) >> 2 FROM ups WHERE spot > 1),
 gaps AS MATERIALIZED (SELECT sample_id, spot AS id FROM (SELECT DISTINCT sample_id, spot FROM ups WHERE spot <> id) u WHERE {gap}),
 kids AS (SELECT sample_id, (id + 2) >> 2 AS parent, id, support, 0 AS gap FROM good WHERE id > 1 UNION ALL SELECT sample_id, (id + 2) >> 2, id, 0, 1 FROM gaps WHERE id > 1),
 ranked AS (SELECT *, count(*) FILTER (gap = 0) OVER w AS n_good, count(*) FILTER (gap = 1) OVER w AS n_gaps, count(*) OVER (PARTITION BY sample_id, parent, gap, support) AS n_top, row_number() OVER (PARTITION BY sample_id, parent ORDER BY gap, support DESC, id) AS rn FROM kids WINDOW w AS (PARTITION BY sample_id, parent)),
 choice AS MATERIALIZED (SELECT sample_id, parent, id, gap = 1 AS assumed, n_good > 1 OR (n_good = 0 AND n_gaps > 1) AS conflict, {one} OR (n_good = 0 AND n_gaps = 1) AS go FROM ranked WHERE rn = 1),
 steps AS (SELECT sample_id, CAST(1 AS BIGINT) AS spot, 0 AS d, false AS assumed FROM (SELECT DISTINCT sample_id FROM ox_pooled) UNION ALL SELECT s.sample_id, c.id, s.d + 1, c.assumed FROM steps s JOIN choice c ON c.sample_id = s.sample_id AND c.parent = s.spot WHERE c.go),
 walks AS MATERIALIZED (SELECT s.sample_id, arg_max(s.spot, s.d) AS last, max(s.d) AS d, coalesce(string_agg('N' || s.spot, '>' ORDER BY s.d) FILTER (s.d > 0), '') AS path, coalesce(string_agg('N' || s.spot, ',' ORDER BY s.d) FILTER (s.assumed), '') AS assumed, coalesce(bool_or(c.conflict), false) AS conflict FROM steps s LEFT JOIN choice c ON c.sample_id = s.sample_id AND c.parent = s.spot GROUP BY s.sample_id)"""


Y_STATES = "SELECT s.sample_id, m.marker_id + 1 AS id, CASE WHEN m.marker_id % 4 = 3 OR p.rsid IS NULL THEN 'not_on_array' WHEN p.gkey = 'NN' THEN 'no_call' WHEN contains(p.gkey, m.alt) THEN 'derived' WHEN contains(p.gkey, m.ref) THEN 'ancestral' ELSE 'discordant' END AS state FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_markers m LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = m.rsid WHERE m.marker_id > 0"
NOT_TESTED = "NOT EXISTS (SELECT 1 FROM sup WHERE sup.sample_id = u.sample_id AND sup.id = u.spot)"


@query("wn13_walk_of_deep_tree", tree_walk(Y_STATES, NOT_TESTED, False) + " SELECT sample_id, CASE WHEN conflict THEN 'conflict' WHEN d > 0 THEN 'resolved' ELSE 'unresolved' END AS state, CASE WHEN d > 0 THEN 'N' || last END AS haplogroup, path, assumed FROM walks")
def _(c):
    t = deep_tree(c)
    walk = lineage.lineage_walk(lineage.marker_states(c.pooled(), t), t)
    return walk.select("sample_id", "state", "haplogroup", F.array_join("path", ">").alias("path"), F.array_join("assumed", ",").alias("assumed"))


@query("wn13_mt_walk", tree_walk(MT_STATES, NOT_TESTED, True) + """ SELECT w.sample_id, CASE WHEN d > 0 THEN 'called' ELSE 'unresolved' END AS state, CASE WHEN d > 0 THEN 'N' || last END AS haplogroup, path, assumed, conflict, coalesce(v, 0) AS verified_used, coalesce(u, 0) AS unverified_used, CASE WHEN coalesce(u, 0) > 0 OR assumed <> '' THEN 'provisional' WHEN d > 0 THEN 'moderate' ELSE 'none' END AS confidence
 FROM walks w LEFT JOIN (SELECT s.sample_id, count(*) FILTER (verified) AS v, count(*) FILTER (NOT verified) AS u FROM sts JOIN steps s ON s.sample_id = sts.sample_id AND s.spot = sts.id WHERE state = 'derived' GROUP BY ALL) z USING (sample_id)""")
def _(c):
    pooled, defining = mt_fixture(c)
    walk = lineage.mt_lineage_walk(pooled, deep_tree(c), defining)
    return walk.withColumns({"path": F.array_join("path", ">"), "assumed": F.array_join("assumed", ",")})


@query("wn13_mt_stops", tree_walk(MT_STATES, NOT_TESTED, True) + " SELECT w.sample_id, 'N' || (m.marker_id + 1) AS node, CASE WHEN s.id IS NULL THEN 'not testable' ELSE 'excluded' END AS reason FROM walks w JOIN fx_markers m ON m.marker_id > 0 AND (m.marker_id + 3) >> 2 = w.last LEFT JOIN sup s ON s.sample_id = w.sample_id AND s.id = m.marker_id + 1 WHERE s.id IS NULL OR s.against > 0")
def _(c):
    pooled, defining = mt_fixture(c)
    t = deep_tree(c)
    return lineage.mt_stops(pooled, t, defining, lineage.mt_lineage_walk(pooled, t, defining))


@query("wn14_mt_states", f"SELECT sample_id, 'N' || id AS node, position, verified, state FROM ({MT_STATES})")
def _(c):
    return lineage.mt_states(*mt_fixture(c))


@query("wn16_compare_lineage_calls", "SELECT sample_id, CASE WHEN haplogroup IS NULL THEN 'incomparable' WHEN haplogroup = 'B' THEN 'identical' WHEN haplogroup LIKE 'B_%' THEN 'consistent_depth' ELSE 'divergent' END AS relation FROM (" + WALK + ")")
def _(c):
    t = c.view("fx_tree")
    w = lineage.lineage_walk(lineage.marker_states(c.pooled(), t), t)
    return lineage.compare_lineage_calls(w, w.select("sample_id", F.lit("B").alias("haplogroup")), t).select("sample_id", "relation")


@query("wn18_marker_gaps", "SELECT node, count(*) FILTER (state IN ('no_call', 'not_on_array', 'unusable')) AS samples_blocked, count(*) AS samples FROM ox_states GROUP BY node")
def _(c):
    return lineage.marker_gaps(lineage.marker_states(c.pooled(), c.view("fx_tree"))).select("node", "samples_blocked", "samples")


@query("ag30_marker_coverage", "SELECT s.sample_id, q.pop, count(p.rsid) AS read, count(*) AS total, round(count(p.rsid) / count(*), 6) AS fraction, count(p.rsid) >= 50 AND count(p.rsid) / count(*) >= 0.2 AS resolvable FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN (SELECT DISTINCT pop, rsid FROM fx_allele_freq WHERE freq > 0.6) q LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = q.rsid AND p.gkey <> 'NN' GROUP BY ALL")
def _(c):
    return ancestry.marker_coverage(c.pooled().where("genotype <> 'NN'"), c.view("fx_allele_freq").where("freq > 0.6")).drop("reason")


@query("ag31_report_proportions", "SELECT sample_id, pop, CASE WHEN n >= 50 AND n / t >= 0.2 THEN round(n / t, 6) END AS proportion, round(n / t, 6) AS raw, CASE WHEN n >= 50 AND n / t >= 0.2 THEN 0.0 ELSE round(n / t, 6) END AS withheld FROM (SELECT s.sample_id, q.pop, count(p.rsid) AS n, count(*) AS t FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN (SELECT DISTINCT pop, rsid FROM fx_allele_freq WHERE freq > 0.6) q LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = q.rsid AND p.gkey <> 'NN' GROUP BY ALL)")
def _(c):
    cov = ancestry.marker_coverage(c.pooled().where("genotype <> 'NN'"), c.view("fx_allele_freq").where("freq > 0.6"))
    return ancestry.report_proportions(cov.select("sample_id", "pop", F.col("fraction").alias("proportion")), cov).select("sample_id", "pop", "proportion", "raw", "withheld")


IMP = "SELECT t.sample_id, t.marker_id, t.marker_id % 3 <> 0 AS imputed, CASE WHEN t.marker_id % 3 <> 0 AND t.marker_id % 7 <> 0 THEN (t.marker_id * 37 % 101) / 100.0 END AS dr2, (t.marker_id % 50) / 1000.0 AS maf FROM fx_truth t"


def imputations(c):
    m = F.col("marker_id")
    return c.view("fx_truth").select("sample_id", m, (m % 3 != 0).alias("imputed"), F.when((m % 3 != 0) & (m % 7 != 0), (m * 37 % 101).cast("double") / 100).alias("dr2"), ((m % 50).cast("double") / 1000).alias("maf"))


@query("ag28_imputation_report", f"SELECT sample_id, count(*) FILTER (NOT imputed) AS typed, count(*) FILTER (imputed) AS imputed, count(*) FILTER (dr2 >= 0.8) AS above, count(*) FILTER (dr2 < 0.8) AS below, count(*) FILTER (imputed AND dr2 IS NULL) AS unknown, round(median(dr2), 6) AS median_dr2, count(*) FILTER (imputed AND maf < 0.01) AS rare FROM ({IMP}) GROUP BY sample_id")
def _(c):
    return imputed.imputation_report(imputations(c)).select("sample_id", "typed", "imputed", "above", "below", "unknown", F.round("median_dr2", 6).alias("median_dr2"), "rare")


@query("sc24_apply_imputation_cap", f"SELECT sample_id, marker_id, CASE WHEN imputed THEN least(5.0, CASE WHEN dr2 >= 0.8 THEN 9.5 ELSE 3.0 END)::DOUBLE ELSE 5.0::DOUBLE END AS magnitude, imputed AND (dr2 IS NULL OR dr2 < 0.8) AS dubious FROM ({IMP})")
def _(c):
    return imputed.apply_imputation_cap(imputations(c).withColumn("magnitude", F.lit(5.0))).select("sample_id", "marker_id", "magnitude", "dubious")


@query("ag29_imputation_violations", f"SELECT sample_id, marker_id, CASE WHEN dr2 IS NULL THEN 'no quality' WHEN dr2 < 0.8 THEN 'quality below the threshold; untrusted band' END AS reasons FROM ({IMP}) WHERE imputed AND marker_id % 5 = 0 AND (dr2 IS NULL OR dr2 < 0.8)")
def _(c):
    f = imputations(c).withColumns({"clinvar_sig_code": F.when(F.col("marker_id") % 5 == 0, 5), "imputation_capped": F.lit(True)})
    return imputed.imputation_violations(f).select("sample_id", "marker_id", "reasons")


# --- texts, provenance, sources -----------------------------------------------------------------

PHRASES = ("license", "the and", "you must", "copyright")


@query("fl6_banned_phrase_scan", "SELECT doc_id, array_to_string(list_filter(['license', 'the and', 'you must', 'copyright'], lambda p: contains(lower(text), p)), ',') AS phrases FROM documents WHERE len(list_filter(['license', 'the and', 'you must', 'copyright'], lambda p: contains(lower(text), p))) > 0")
def _(c):
    return text.banned_phrase_scan(c.table("documents"), ["text"], PHRASES).select("doc_id", F.array_join("phrases", ",").alias("phrases"))


@query("fl7_redact_tokens", "SELECT doc_id, sha256(replace(text, split_part(text, ' ', 1), '[removed]')) AS digest FROM documents WHERE split_part(text, ' ', 1) <> ''")
def _(c):
    d = c.table("documents").withColumn("tokens", F.array(F.split_part("text", F.lit(" "), F.lit(1)))).where("tokens[0] <> ''")
    return text.redact_tokens(d, "text", "tokens").select("doc_id", F.sha2("redacted", 256).alias("digest"))


@query("fl8_licence_gate", "SELECT doc_id FROM documents WHERE text IS NULL OR NOT (contains(lower(text), 'apache') OR contains(lower(text), 'gpl'))")
def _(c):
    return text.licence_gate(c.table("documents"), "text", ("Apache", "GPL")).select("doc_id")


STOP = "['a','an','and','are','as','at','be','by','do','does','for','from','have','how','i','in','is','it','me','my','of','on','or','that','the','this','to','was','what','with']"
ASKED = f"SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9*]{{2,}}'), lambda t: NOT list_contains({STOP}, t)))) AS term FROM benchmark WHERE item_id % 50 = 0"
SHARED = f"SELECT q.item_id AS question_id, d.doc_id AS id, count(*) AS n FROM ({ASKED}) q JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9*]{{2,}}'))) AS term FROM documents) d ON d.term = q.term GROUP BY q.item_id, d.doc_id"


@query("tk4_rank_by_terms", f"SELECT question_id, id, 12 * n AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, id) AS rank FROM ({SHARED})) WHERE rank <= 5")
def _(c):
    q = c.table("benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("question_id"), "text")
    return text.rank_by_terms(c.table("documents"), q, ["text"], 5, "doc_id").select("question_id", "id", "score", "rank")


@query("jn21_attach_sources", "SELECT o_orderkey, o_orderstatus = 'F' AS redistributable, CASE o_orderstatus WHEN 'F' THEN 'CC0; MIT' WHEN 'O' THEN 'CC0; none' ELSE 'CC0' END AS licences FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders)")
def _(c):
    o = c.table("orders").select("o_orderkey", "o_orderstatus").distinct()
    f = o.select(F.col("o_orderkey").alias("sample_id"), F.lit("rs").alias("rsid"), F.array(F.lit("base"), F.col("o_orderstatus")).alias("sources"))
    s = c.spark.createDataFrame([("base", "CC0", True, True), ("F", "MIT", True, True), ("O", "none", False, False)], "source_id string, licence string, redistributable boolean, commercial_ok boolean")
    return provenance.attach_sources(f, s).select(F.col("sample_id").alias("o_orderkey"), "redistributable", "licences")


@query("jn22_audit_artefacts", "SELECT DISTINCT n_name AS artefact, CASE n_regionkey WHEN 0 THEN 'unknown source' ELSE 'not redistributable' END AS violation FROM nation WHERE n_regionkey IN (0, 2)")
def _(c):
    n = c.table("nation").select(F.col("n_name").alias("artefact"), F.col("n_regionkey").cast("string").alias("source_id"))
    s = c.table("region").where("r_regionkey > 0").select(F.col("r_regionkey").cast("string").alias("source_id"), F.lit("x").alias("licence"), (F.col("r_regionkey") != 2).alias("redistributable"), F.lit(True).alias("used"), F.lit(False).alias("never_bundle"))
    return provenance.audit_artefacts(n, s).select("artefact", "violation").distinct()


@query("snk4_study_vcf", """SELECT true AS ref_known, concat_ws(chr(9), CAST(p.chrom_no AS VARCHAR), CAST(p.position AS VARCHAR), p.rsid, m.ref, CASE WHEN len(x) = 0 THEN '.' ELSE array_to_string(x, ',') END, '.', 'PASS', '.', 'GT', CASE WHEN a = m.ref THEN '0' ELSE CAST(list_position(x, a) AS VARCHAR) END || '/' || CASE WHEN b = m.ref THEN '0' ELSE CAST(list_position(x, b) AS VARCHAR) END) AS value
 FROM (SELECT p.*, substr(gkey, 1, 1) AS a, substr(gkey, 2, 1) AS b, list_sort(list_distinct(list_filter([substr(gkey, 1, 1), substr(gkey, 2, 1)], lambda y: y <> m.ref))) AS x FROM ox_pooled p JOIN fx_markers m USING (rsid) WHERE gkey <> 'NN') p JOIN fx_markers m USING (rsid)""")
def _(c):
    return writers.study_vcf(c.placed(), c.view("fx_markers")).select("ref_known", "value")


@query("snk3_plink_ped", """SELECT CAST(s.sample_id AS VARCHAR) || ' ' || CAST(s.sample_id AS VARCHAR) || ' 0 0 0 -9 ' || string_agg(CASE WHEN coalesce(p.gkey, 'NN') = 'NN' THEN '0 0' ELSE substr(p.gkey, 1, 1) || ' ' || substr(p.gkey, 2, 1) END, ' ' ORDER BY m.chrom_no, m.position, m.rsid) AS value
 FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_markers m LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = m.rsid GROUP BY s.sample_id""")
def _(c):
    return writers.plink_ped(c.pooled(), c.view("fx_markers"))


# --- blood group and other entities -------------------------------------------------------------


@query("ru7_entity_findings", f"SELECT 'genoset' AS entity_type, count(*) AS n, sum(2.5)::DOUBLE AS magnitudes FROM ({RULES}) WHERE matched UNION ALL SELECT 'trait', 20, 20.0::DOUBLE")
def _(c):
    p = c.pooled()
    rows = rules.rule_coverage(p, c.rules())
    texts = c.view("fx_rule_nodes").select("rule_id").distinct().withColumns({"magnitude": F.lit(2.5), "summary": F.lit("s"), "repute": F.lit("odd"), "silo": F.lit("actionable")})
    t = p.select("sample_id").distinct().withColumns({"trait": F.lit("t"), "call": F.lit("x"), "coverage": F.lit(1.0)})
    both = traits.rule_findings(rows, texts).unionByName(traits.trait_findings(t), allowMissingColumns=True)
    return both.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("magnitude").alias("magnitudes"))
