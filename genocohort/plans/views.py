"""Views that only the oracle SQL uses: the same steps as the operators, written in SQL."""

from __future__ import annotations

from .fixtures import VIEWS, as_ctes

KEY = "CASE WHEN {0} IN ('A','C','G','T') AND {1} IN ('A','C','G','T') THEN least({0},{1}) || greatest({0},{1}) END"
STARS = "CASE review_status WHEN 'practice guideline' THEN 4 WHEN 'reviewed by expert panel' THEN 3 WHEN 'criteria provided, multiple submitters, no conflicts' THEN 2 WHEN 'criteria provided, single submitter' THEN 1 ELSE 0 END"
SIG = "CASE WHEN clinical_sig = '' THEN NULL WHEN clinical_sig LIKE '%conflicting%' THEN 255 WHEN clinical_sig = 'likely pathogenic' THEN 4 WHEN clinical_sig = 'pathogenic' THEN 5 WHEN clinical_sig = 'likely benign' THEN 3 WHEN clinical_sig = 'benign' THEN 2 WHEN clinical_sig = 'uncertain significance' THEN 1 WHEN clinical_sig = 'drug response' THEN 6 END"

ORACLE_VIEWS = {
    "ox_dedup": f"""SELECT * FROM (SELECT c.*, CAST(substr(kit, 4, 1) AS INT) AS kit_ord, {KEY.format("allele1", "allele2")} AS gkey,
      row_number() OVER (PARTITION BY sample_id, kit, rsid ORDER BY CASE WHEN allele1 <> 'N' AND allele2 <> 'N' THEN 0 ELSE 1 END, seq) AS rn FROM fx_calls c) WHERE rn = 1""",
    "ox_pooled": """SELECT sample_id, rsid, any_value(fam) AS fam, any_value(member) AS member, any_value(marker_id) AS marker_id, any_value(chrom_no) AS chrom_no, any_value(position) AS position, coalesce(arg_min(gkey, kit_ord) FILTER (gkey IS NOT NULL), 'NN') AS gkey,
      count(gkey) AS n_real, count(DISTINCT gkey) > 1 AS conflict, min(kit_ord) AS first_kit_ord, string_agg(CASE WHEN gkey IS NOT NULL THEN kit END, ';' ORDER BY kit_ord) AS labels, string_agg(CASE WHEN gkey IS NOT NULL THEN kit || '=' || gkey END, ';' ORDER BY kit_ord) AS calls FROM ox_dedup GROUP BY sample_id, rsid""",
    "ox_findings": f"""SELECT p.sample_id, p.rsid, p.chrom_no, p.position, p.gkey, p.conflict, p.n_real, r.gene, r.category, r.risk_allele, r.clinical_sig, r.cpic_level, r.publications, r.interpretation, {STARS} AS stars, {SIG} AS code,
      CASE WHEN p.gkey = 'NN' THEN 'no_call' WHEN substr(p.gkey, 1, 1) = substr(p.gkey, 2, 1) THEN 'homozygous' ELSE 'heterozygous' END AS zygosity,
      CAST(substr(p.gkey, 1, 1) = r.risk_allele AS INT) + CAST(substr(p.gkey, 2, 1) = r.risk_allele AS INT) AS copies,
      CASE WHEN r.interpretation LIKE '%dose adjustment%' OR r.interpretation LIKE '%warfarin%' THEN 'pre_prescription' WHEN r.interpretation LIKE '%risk%' THEN 'actionable' ELSE 'informational' END AS silo
      FROM ox_pooled p JOIN fx_ref_variants r ON r.rsid = p.rsid""",
    "ox_observed": "SELECT rsid, list(DISTINCT allele) AS seen FROM fx_allele_freq GROUP BY rsid",
    "ox_strand": """SELECT *, CASE WHEN flip THEN translate(x, 'ACGT', 'TGCA') ELSE x END AS fx1, CASE WHEN flip THEN translate(y, 'ACGT', 'TGCA') ELSE y END AS fx2, gkey IN ('AT', 'CG') AS ambiguous FROM (
      SELECT *, gkey <> 'NN' AND d < 2 AND (o = 2 OR o > d) AS flip FROM (
      SELECT p.sample_id, p.rsid, p.gkey, CASE WHEN p.gkey = 'NN' THEN '' ELSE substr(p.gkey, 1, 1) END AS x, CASE WHEN p.gkey = 'NN' THEN '' ELSE substr(p.gkey, 2, 1) END AS y,
        coalesce(CAST(list_contains(s.seen, substr(p.gkey, 1, 1)) AS INT) + CAST(list_contains(s.seen, substr(p.gkey, 2, 1)) AS INT), 0) AS d,
        coalesce(CAST(list_contains(s.seen, translate(substr(p.gkey, 1, 1), 'ACGT', 'TGCA')) AS INT) + CAST(list_contains(s.seen, translate(substr(p.gkey, 2, 1), 'ACGT', 'TGCA')) AS INT), 0) AS o
      FROM ox_pooled p LEFT JOIN ox_observed s ON s.rsid = p.rsid))""",
    "ox_freq": """SELECT s.sample_id, s.rsid, q.pop, s.flip, s.ambiguous, s.fx1 || s.fx2 AS queried, round(CASE WHEN s.fx1 = s.fx2 THEN a.freq * a.freq ELSE 2.0 * a.freq * b.freq END * 100.0, 2) AS freq
      FROM ox_strand s CROSS JOIN (SELECT DISTINCT pop FROM fx_allele_freq) q LEFT JOIN fx_allele_freq a ON a.rsid = s.rsid AND a.pop = q.pop AND a.allele = s.fx1 LEFT JOIN fx_allele_freq b ON b.rsid = s.rsid AND b.pop = q.pop AND b.allele = s.fx2""",
    "ox_band": "SELECT *, CASE WHEN freq IS NULL THEN 'unknown' WHEN freq < 1 THEN 'very_rare' WHEN freq < 5 THEN 'rare' WHEN freq < 20 THEN 'uncommon' WHEN freq <= 50 THEN 'common' ELSE 'majority' END AS band FROM ox_freq",
    "ox_scored": """SELECT *, CASE WHEN zygosity = 'no_call' THEN 0.0 ELSE round(greatest(0.0, least(10.0, CASE WHEN ambiguous AND s > 2.0 THEN 2.0 ELSE s END)), 2) END AS magnitude,
      CASE WHEN zygosity = 'no_call' OR copies = 0 THEN '' WHEN interpretation LIKE '%taste%' THEN '' WHEN interpretation LIKE '%increased risk%' THEN 'Bad' WHEN interpretation LIKE '%reduced risk%' THEN 'Good' ELSE '' END AS repute,
      CASE WHEN zygosity = 'no_call' OR ambiguous THEN 'none' WHEN cpic_level = 'A' OR stars >= 3 THEN 'high' WHEN cpic_level IN ('A/B', 'B') OR stars = 2 THEN 'moderate' WHEN stars = 1 OR clinical_sig <> '' THEN 'low' ELSE 'none' END AS confidence,
      CASE WHEN cpic_level <> '' THEN 'CPIC Level ' || cpic_level WHEN code IS NOT NULL AND stars >= 1 THEN 'ClinVar ' || clinical_sig || ', ' || stars || CASE WHEN stars = 1 THEN ' star' ELSE ' stars' END ELSE clinical_sig END AS evidence FROM (
      SELECT *, base * CASE copies WHEN 0 THEN 0.25 WHEN 2 THEN 1.3 ELSE 1.0 END + CASE band WHEN 'very_rare' THEN 0.5 WHEN 'rare' THEN 0.25 WHEN 'majority' THEN -0.5 ELSE 0.0 END + CASE WHEN publications > 0 THEN least(1.0, log10(1 + publications) / 2.0) ELSE 0.0 END AS s FROM (
      SELECT f.*, b.freq, b.band, b.flip, b.ambiguous, b.queried, CAST(CASE WHEN cpic_level = 'A' THEN 6.0 WHEN code IN (4, 5) AND stars >= 3 THEN 6.0 WHEN cpic_level IN ('A/B', 'B') THEN 4.5 WHEN code = 5 AND stars = 2 THEN 4.5 WHEN code = 4 AND stars >= 2 THEN 3.5 WHEN stars <= 1 AND code IN (1, 4, 5, 255) THEN 1.5 ELSE 1.0 END AS DOUBLE) AS base
      FROM ox_findings f JOIN ox_band b ON b.sample_id = f.sample_id AND b.rsid = f.rsid AND b.pop = 'POP0'))""",
    "ox_counts": "SELECT marker_id AS marker, fam AS pop, CAST(sum(h1 + h2) AS BIGINT) AS alt, 2 * count(*) AS n FROM fx_truth GROUP BY marker_id, fam",
    "ox_leaf": """SELECT s.sample_id, r.rule_id, r.node_id, coalesce(CASE r.base_kind WHEN 'alt' THEN p.gkey LIKE '%' || m.alt || '%' WHEN 'alt/alt' THEN p.gkey = m.alt || m.alt ELSE p.gkey = least(m.ref, m.alt) || greatest(m.ref, m.alt) END, false) AS v
      FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_rule_nodes r LEFT JOIN fx_markers m ON m.rsid = r.rsid LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = r.rsid AND p.gkey <> 'NN' WHERE r.op = 'geno'""",
    "ox_rules": """SELECT sample_id, R1, R2, R1 OR NOT (b3 OR c3) AS R3, n4 >= 2 AS R4, (R1 OR NOT (b3 OR c3)) AND n4 >= 2 AS R5, R6 FROM (SELECT sample_id, bool_or(v) FILTER (rule_id = 'R1') AS R1, bool_and(v) FILTER (rule_id = 'R2') AS R2,
      bool_or(v) FILTER (rule_id = 'R3' AND node_id = 4) AS b3, bool_or(v) FILTER (rule_id = 'R3' AND node_id = 5) AS c3, sum(CAST(v AS INT)) FILTER (rule_id = 'R4') AS n4, bool_or(v) FILTER (rule_id = 'R6') AS R6 FROM ox_leaf GROUP BY sample_id)""",
    "ox_family": """SELECT c.fam, c.rsid, c.gkey AS c, m.gkey AS m, f.gkey AS f FROM ox_pooled c LEFT JOIN ox_pooled m ON m.fam = c.fam AND m.member = 1 AND m.rsid = c.rsid AND m.gkey <> 'NN' LEFT JOIN ox_pooled f ON f.fam = c.fam AND f.member = 2 AND f.rsid = c.rsid AND f.gkey <> 'NN' WHERE c.member = 0 AND c.gkey <> 'NN'""",
    "ox_true": "SELECT t.sample_id, t.fam, t.member, t.marker_id, m.rsid, m.chrom_no, m.position, CASE WHEN t.h1 = 1 THEN m.alt ELSE m.ref END AS a1, CASE WHEN t.h2 = 1 THEN m.alt ELSE m.ref END AS a2 FROM fx_truth t JOIN fx_markers m ON m.marker_id = t.marker_id",
    "ox_ibs": "SELECT a.sample_id AS a, b.sample_id AS b, a.rsid, a.chrom_no, a.position, greatest(CAST(a.a1 = b.a1 AS INT) + CAST(a.a2 = b.a2 AS INT), CAST(a.a1 = b.a2 AS INT) + CAST(a.a2 = b.a1 AS INT)) AS ibs FROM ox_true a JOIN ox_true b ON a.rsid = b.rsid AND a.fam = b.fam AND a.sample_id < b.sample_id",
    "ox_mapsteps": "SELECT chrom_no, bp, cm, lead(bp) OVER (PARTITION BY chrom_no ORDER BY bp) AS bp1, lead(cm) OVER (PARTITION BY chrom_no ORDER BY bp) AS cm1, min(bp) OVER (PARTITION BY chrom_no) AS lo, max(bp) OVER (PARTITION BY chrom_no) AS hi, first_value(cm) OVER (PARTITION BY chrom_no ORDER BY bp) AS locm, last_value(cm) OVER (PARTITION BY chrom_no ORDER BY bp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hicm FROM fx_genetic_map",
    "ox_place": "SELECT m.rsid, m.chrom_no, m.position, max(CASE WHEN m.position <= g.lo THEN g.locm WHEN m.position >= g.hi THEN g.hicm WHEN m.position >= g.bp AND m.position < g.bp1 THEN g.cm + (m.position - g.bp) / (g.bp1 - g.bp) * (g.cm1 - g.cm) END) AS cm FROM fx_markers m JOIN ox_mapsteps g ON g.chrom_no = m.chrom_no GROUP BY ALL",
    "ox_segments": """SELECT r.a, r.b, r.chrom_no, r.s AS start_bp, r.e AS end_bp, r.snps, round(greatest(0.0, y.cm - x.cm), 4) AS cm FROM (SELECT a, b, chrom_no, g, min(position) AS s, max(position) AS e, count(*) AS snps FROM (
      SELECT *, sum(CASE WHEN ibs = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b, chrom_no ORDER BY position, rsid ROWS UNBOUNDED PRECEDING) AS g FROM ox_ibs) WHERE ibs > 0 GROUP BY a, b, chrom_no, g HAVING count(*) >= 20) r
      JOIN ox_place x ON x.chrom_no = r.chrom_no AND x.position = r.s JOIN ox_place y ON y.chrom_no = r.chrom_no AND y.position = r.e WHERE round(greatest(0.0, y.cm - x.cm), 4) >= 0.5""",
    "ox_states": """SELECT s.sample_id, t.node, t.parent, CASE WHEN p.rsid IS NULL THEN 'not_on_array' WHEN coalesce(t.derived, '') = '' THEN 'unusable' WHEN p.gkey = 'NN' THEN 'no_call' WHEN p.gkey LIKE '%' || t.derived || '%' THEN 'derived' WHEN p.gkey LIKE '%' || t.ancestral || '%' THEN 'ancestral' ELSE 'discordant' END AS state
      FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN fx_tree t LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = t.rsid WHERE t.parent <> ''""",
    "ox_two": "SELECT rsid, pop, max(allele) FILTER (n = 1) AS a1, max(freq) FILTER (n = 1) AS f1, max(allele) FILTER (n = 2) AS a2, max(freq) FILTER (n = 2) AS f2 FROM (SELECT *, row_number() OVER (PARTITION BY rsid, pop ORDER BY freq DESC, allele) AS n FROM fx_allele_freq) GROUP BY rsid, pop",
    "ox_prints": f"""SELECT snapshot_id, entry_key, {SIG} AS code, {STARS} AS stars, cpic_level FROM fx_snapshot_entries""",
    "ox_gwas": "SELECT l_partkey % 97 AS k, l_orderkey % 50 AS study, l_linestatus || CAST(l_linenumber AS VARCHAR) AS trait, l_suppkey AS paper, substr('ACGT', CAST(l_linenumber % 4 AS INT) + 1, 1) AS allele, l_quantity / 4.0 AS mlog, l_orderkey * 100 + l_linenumber AS ord, l_returnflag FROM lineitem",
}
ORACLE_VIEWS["ox_scored_pop3"] = ORACLE_VIEWS["ox_scored"].replace("'POP0'", "'POP3'")
VIEWS_FOR_ORACLE = VIEWS | ORACLE_VIEWS


def oracle(sql: str, fixtures: bool = True) -> str:
    """``sql`` with the oracle views it uses put before it, and the fixture views unless they are tables already."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"\b[fo]x_\w+", todo.pop())) & set(VIEWS_FOR_ORACLE) - found:
            found.add(name)
            todo.append(VIEWS_FOR_ORACLE[name])
    views = [n for n in VIEWS_FOR_ORACLE if n in found and (fixtures or n not in VIEWS)]
    if not views:
        return sql.strip()
    joined = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS_FOR_ORACLE[n]})" for n in views)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {joined},\n{body[15:]}"
    return f"WITH {joined},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {joined}\n{body}"


__all__ = ["ORACLE_VIEWS", "as_ctes", "oracle"]
