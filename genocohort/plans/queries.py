"""Registered queries: each operator over the fixture cohort or the given tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as al
from ..functions import population as po
from ..functions import scoring as sc
from ..operators import ancestry, annotate, carrier, concord, family, findings, history, imputed, lineage, pgx, pool, population, provenance, prs, reference, rules, text
from ..sources import tables, vcf, writers
from . import fixtures
from .scan import References, lookup, rescore, scan
from .views import oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The queries' SQL without the views that it uses.
BARE: dict[str, str] = {}


_held: dict = {}


def release() -> None:
    """Let go of all views that queries hold."""
    for df in _held.values():
        df.unpersist()
    _held.clear()


class Cohort:
    """The fixture cohort over one folder of tables.

    Views and the pooled calls, which nearly every query starts from, are persisted (memory and disk) until
    ``release`` or a query over another folder.  The calls of kits are not, where only pooling reads them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def held(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if any(k[:2] != key[:2] for k in _held):
            release()  # another session or folder: one cohort is held at a time
        if key not in _held:
            _held[key] = make().persist()
        return _held[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str, hold: bool = True) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if (self.sf_dir, name) in fixtures.stored or not (hold or key in _held):
            return fixtures.view(self.spark, self.sf_dir, name)
        return self.held(name, lambda: fixtures.view(self.spark, self.sf_dir, name))

    def calls(self, hold: bool = True) -> DataFrame:
        c = self.view("fx_calls", hold)
        provider = F.when(F.col("kit") == "kit0", "23andme").when(F.col("kit") == "kit1", "ancestrydna").otherwise("")
        return c.withColumns({"label": F.col("kit"), "provider": provider, "kit_ord": F.substring("kit", 4, 1).cast("int"), "chromosome": F.col("chrom_no").cast("string")})

    def kits(self) -> DataFrame:
        return self.calls().select("sample_id", "label", "provider").distinct()

    def kept(self, hold: bool = True) -> DataFrame:
        return pool.dedupe_kit(self.calls(hold))

    def pooled(self) -> DataFrame:
        return self.held("pooled", lambda: pool.pool_calls(pool.dedupe_kit(self.calls(hold=False), to_pool=True)))

    def placed(self) -> DataFrame:
        return self.pooled().withColumn("chrom_no", F.col("chromosome").cast("int"))

    def member(self, k: int) -> DataFrame:
        return self.pooled().where(F.col("sample_id") % 4 == k).withColumn("fam", F.floor(F.col("sample_id") / 4))

    def truth(self) -> DataFrame:
        t = self.view("fx_truth").join(self.view("fx_markers").hint("merge"), "marker_id")
        return self.held("truth", lambda: t.select("sample_id", "fam", "member", "marker_id", "rsid", "chrom_no", "position", F.when(F.col("h1") == 1, F.col("alt")).otherwise(F.col("ref")).alias("allele1"), F.when(F.col("h2") == 1, F.col("alt")).otherwise(F.col("ref")).alias("allele2")))

    def counts(self) -> DataFrame:
        return self.view("fx_truth").groupBy(F.col("marker_id").alias("marker"), F.col("fam").alias("pop")).agg(F.sum(F.col("h1") + F.col("h2")).alias("alt"), (2 * F.count(F.lit(1))).alias("n"))

    def scanned(self, name: str, df: DataFrame) -> DataFrame:
        """The one pooling of the cohort; findings, wide rows of which a query reads a few columns once, are not held."""
        return self.pooled() if name == "pooled" else df

    def scan(self) -> dict[str, DataFrame]:
        return scan(self.calls(hold=False), References(self.view("fx_ref_variants"), self.view("fx_allele_freq")), "POP0", hold=self.scanned)

    def rules(self) -> DataFrame:
        m = self.view("fx_markers").select("rsid", "ref", "alt").hint("merge")
        n = self.view("fx_rule_nodes").join(m, "rsid", "left")
        kind = F.when(F.col("base_kind") == "alt", F.col("alt")).when(F.col("base_kind") == "alt/alt", F.concat_ws("/", "alt", "alt")).otherwise(F.concat_ws("/", "ref", "alt"))
        return n.select("rule_id", "node_id", "parent_id", "op", "n", "rsid", kind.alias("alleles"), "ref_rule")

    def prints(self) -> DataFrame:
        return history.fingerprint(self.view("fx_snapshot_entries").withColumn("sample_id", F.lit(0).cast("long")))


def plain(df: DataFrame) -> DataFrame:
    """Scalars in the widths the SQL gives: long, double, string, boolean."""
    cast = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    return df.select(*[F.col(c).cast(cast.get(t, "double" if t.startswith("decimal") else t)).alias(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Cohort(spark, sf_dir)))
        if sql:
            ORACLES[name], BARE[name] = oracle(sql), sql
        return f

    return register


# --- kits and pooling ---------------------------------------------------------------------------


@query("wn01_dedupe_kit", "SELECT sample_id, kit, rsid, allele1, allele2 FROM ox_dedup")
def _(c):
    return c.kept().select("sample_id", "kit", "rsid", "allele1", "allele2")


@query("ag01_pool_calls", "SELECT sample_id, rsid, gkey AS genotype, n_real AS n_calls, coalesce(labels, '') AS labels, conflict FROM ox_pooled")
def _(c):
    return c.pooled().select("sample_id", "rsid", "genotype", F.col("count").alias("n_calls"), F.array_join("labels", ";").alias("labels"), "conflict")


@query("ag02_pool_kit_stats", "SELECT d.sample_id, d.kit AS label, count(*) AS snp_count, count(*) FILTER (d.kit_ord = p.first_kit_ord) AS contributed, count(*) FILTER (d.kit_ord > p.first_kit_ord) AS overlapped, count(*) FILTER (p.conflict AND d.gkey IS NOT NULL) AS conflicting FROM ox_dedup d JOIN ox_pooled p ON p.sample_id = d.sample_id AND p.rsid = d.rsid GROUP BY ALL")
def _(c):
    return pool.pool_kit_stats(c.kept(), c.pooled())


@query("ag02_pool_totals", "SELECT sample_id, count(*) AS \"union\", count(*) FILTER (n_real >= 2) AS shared, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (n_real = 1) AS \"unique\" FROM ox_pooled GROUP BY sample_id")
def _(c):
    return pool.pool_totals(c.pooled())


@query("ag03_conflict_list", "SELECT sample_id, rsid, calls FROM ox_pooled WHERE conflict")
def _(c):
    return pool.conflict_list(c.pooled()).select("sample_id", "rsid", F.array_join(F.transform("calls", lambda x: F.concat_ws("=", x["label"], x["genotype"])), ";").alias("calls"))


@query("st1_union_of_kits", "SELECT sample_id, count(DISTINCT rsid) AS positions FROM fx_calls GROUP BY sample_id")
def _(c):
    return c.pooled().groupBy("sample_id").agg(F.count(F.lit(1)).alias("positions"))


PROVIDER = "CASE kit WHEN 'kit0' THEN '23andme' WHEN 'kit1' THEN 'ancestrydna' ELSE 'unknown:kit2' END"
CLASSES = "CASE WHEN ka IS NULL OR kb IS NULL THEN 'not_comparable' WHEN ka = kb THEN 'agreement' WHEN ka IN ('AT','CG') OR kb IN ('AT','CG') THEN 'indeterminate' WHEN least(translate(substr(ka,1,1),'ACGT','TGCA'), translate(substr(ka,2,1),'ACGT','TGCA')) || greatest(translate(substr(ka,1,1),'ACGT','TGCA'), translate(substr(ka,2,1),'ACGT','TGCA')) = kb THEN 'orientation_artifact' ELSE 'genuine' END"
PAIRS = f"SELECT sample_id, a, b, {CLASSES} AS kind FROM (SELECT x.sample_id, x.kit AS a, y.kit AS b, x.gkey AS ka, y.gkey AS kb FROM ox_dedup x JOIN ox_dedup y ON x.sample_id = y.sample_id AND x.rsid = y.rsid AND x.kit < y.kit)"
CONC = f"""SELECT sample_id, a, b, agree + genuine + orientation_artifact + indeterminate AS shared, agree, genuine + orientation_artifact + indeterminate AS conflicts, genuine, orientation_artifact, indeterminate, not_comparable FROM (SELECT k.sample_id, k.a, k.b, count(*) FILTER (kind = 'agreement') AS agree, count(*) FILTER (kind = 'genuine') AS genuine, count(*) FILTER (kind = 'orientation_artifact') AS orientation_artifact, count(*) FILTER (kind = 'indeterminate') AS indeterminate, count(*) FILTER (kind = 'not_comparable') AS not_comparable
 FROM (SELECT x.sample_id, x.label AS a, y.label AS b FROM fx_kits x JOIN fx_kits y ON x.sample_id = y.sample_id AND x.label < y.label) k LEFT JOIN ({PAIRS}) p ON p.sample_id = k.sample_id AND p.a = k.a AND p.b = k.b GROUP BY ALL)"""
RATE = "CASE WHEN {1} > 0 THEN round({0} / {1}, 6) END"


@query("ag04_coverage_by_provider", f"SELECT sample_id, {PROVIDER} AS provider_group, count(DISTINCT rsid) AS positions, count(DISTINCT kit) AS kits FROM ox_dedup WHERE gkey IS NOT NULL GROUP BY ALL")
def _(c):
    return concord.coverage_by_provider(c.kept())


@query("ag05_concordance", f"SELECT *, {RATE.format('agree', 'shared')} AS agreement_rate, {RATE.format('conflicts', 'shared')} AS conflict_rate, {RATE.format('genuine', 'shared')} AS genuine_rate FROM ({CONC})")
def _(c):
    return concord.concordance(c.kept(), c.kits()).drop("same_provider")


@query("jn14_kit_pairs", f"SELECT sample_id, a, b, kind, count(*) AS n FROM ({PAIRS}) GROUP BY ALL")
def _(c):
    return concord.kit_pairs(c.kept()).groupBy("sample_id", "a", "b", concord.classify_conflict("key_a", "key_b").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("ag06_concordance_totals", f"SELECT sample_id, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(agree) AS BIGINT) AS agree, CAST(sum(conflicts) AS BIGINT) AS conflicts, CAST(sum(genuine) AS BIGINT) AS genuine, {RATE.format('sum(genuine)', 'sum(shared)')} AS genuine_rate FROM ({CONC}) GROUP BY sample_id")
def _(c):
    kept, kits = c.kept(), c.kits()
    return concord.concordance_totals(concord.concordance(kept, kits), kits).select("sample_id", "shared", "agree", "conflicts", "genuine", "genuine_rate")


@query("ag07_findings_concordance", f"SELECT f.sample_id, count(*) AS findings_total, count(*) FILTER (p.n >= 2) AS findings_covered, count(*) FILTER (p.n >= 2 AND p.bad) AS findings_conflicted FROM ox_findings f LEFT JOIN (SELECT sample_id, rsid, count(gkey) AS n, false AS z FROM ox_dedup GROUP BY ALL) q ON q.sample_id = f.sample_id AND q.rsid = f.rsid LEFT JOIN (SELECT sample_id, rsid, 2 AS n, bool_or(kind = 'genuine') AS bad FROM (SELECT x.sample_id, x.rsid, {CLASSES.replace('ka', 'x.gkey').replace('kb', 'y.gkey')} AS kind FROM ox_dedup x JOIN ox_dedup y ON x.sample_id = y.sample_id AND x.rsid = y.rsid AND x.kit < y.kit WHERE x.gkey IS NOT NULL AND y.gkey IS NOT NULL) GROUP BY ALL) p ON p.sample_id = f.sample_id AND p.rsid = f.rsid GROUP BY f.sample_id")
def _(c):
    kept = c.kept()
    return concord.findings_concordance(annotate.annotate(pool.pool_calls(kept), c.view("fx_ref_variants")), kept)


# --- scalar functions ---------------------------------------------------------------------------


@query(
    "sc01_allele_functions",
    """SELECT sample_id, kit, rsid, seq, CASE WHEN allele1 = 'N' OR allele2 = 'N' THEN 'NN' ELSE least(allele1, allele2) || greatest(allele1, allele2) END AS gkey, translate(allele1, 'ACGT', 'TGCA') AS comp, least(allele1, allele2) || greatest(allele1, allele2) IN ('AT', 'CG') AS pal,
    CASE WHEN allele1 = 'N' THEN '(-;-)' ELSE '(' || least(allele1, allele2) || ';' || greatest(allele1, allele2) || ')' END AS token, CASE WHEN allele1 = 'N' THEN 'no_call' WHEN allele1 = allele2 THEN 'homozygous' ELSE 'heterozygous' END AS zyg, CAST((allele1 = 'A')::INT + (allele2 = 'A')::INT AS BIGINT) AS n_a, CASE WHEN allele1 <> 'N' THEN CAST((allele1 = 'A')::INT + (allele2 = 'A')::INT AS BIGINT) END AS dose_a,
    CASE WHEN allele1 = 'N' THEN 'NN' ELSE least(translate(allele1, 'ACGT', 'TGCA'), translate(allele2, 'ACGT', 'TGCA')) || greatest(translate(allele1, 'ACGT', 'TGCA'), translate(allele2, 'ACGT', 'TGCA')) END AS minus FROM fx_calls""",
)
def _(c):
    return c.view("fx_calls").select("sample_id", "kit", "rsid", "seq", al.genotype_key("allele1", "allele2").alias("gkey"), al.complement("allele1").alias("comp"), al.is_palindromic("allele1", "allele2").alias("pal"), al.genotype_token("allele1", "allele2").alias("token"), al.zygosity("allele1", "allele2").alias("zyg"), al.copies("allele1", "allele2", F.lit("A")).alias("n_a"), al.dosage("allele1", "allele2", F.lit("A")).alias("dose_a"), al.orient("allele1", "allele2", F.lit("minus"))["genotype"].alias("minus"))


@query("sc08_orders", "SELECT rsid, CAST(chrom_no AS BIGINT) AS chrom_no, row_number() OVER (ORDER BY chrom_no, position, CAST(substr(rsid, 3) AS BIGINT)) AS place FROM fx_markers")
def _(c):
    from pyspark.sql.window import Window as W

    m = c.view("fx_markers").withColumn("chromosome", F.concat(F.lit("chr"), F.col("chrom_no").cast("string")))
    # markers are a dimension; the running place is made per chromosome and shifted by the chromosomes before
    w = W.partitionBy("chrom_no").orderBy(al.chrom_order("chromosome"), "position", al.rsid_order("rsid"))
    sizes = m.groupBy("chrom_no").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select(F.col("chrom_no"), F.coalesce(F.sum("k").over(W.orderBy("chrom_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return m.withColumn("r", F.row_number().over(w)).join(F.broadcast(before), "chrom_no").select("rsid", "chrom_no", (F.col("r") + F.col("b")).alias("place"))


@query("sc12_evidence_functions", "SELECT r.rsid, CAST(f.stars AS BIGINT) AS stars, CAST(f.code AS BIGINT) AS code, f.cpic_level AS level, f.silo, CASE WHEN f.interpretation LIKE '%increased risk%' THEN 'risk' WHEN f.interpretation LIKE '%reduced risk%' THEN 'safe' ELSE 'unknown' END AS cond, CASE WHEN f.interpretation LIKE '%taste%' THEN 'neutral' WHEN f.interpretation LIKE '%increased%' THEN 'risk' ELSE 'protective' END AS way, r.interpretation || '.' AS first FROM fx_ref_variants r JOIN (SELECT DISTINCT rsid, stars, code, cpic_level, silo, interpretation FROM ox_findings) f ON f.rsid = r.rsid")
def _(c):
    r = c.view("fx_ref_variants").join(c.pooled().select("rsid").distinct(), "rsid", "left_semi")
    return r.select("rsid", sc.review_stars("review_status").alias("stars"), sc.sig_code("clinical_sig").alias("code"), sc.cpic_level("cpic_level").alias("level"), sc.classify_silo("interpretation").alias("silo"), sc.conditions_risk("interpretation").alias("cond"), sc.direction("interpretation").alias("way"), reference.reference_summary("interpretation").alias("first"))


@query("sc21_frequency_functions", "SELECT rsid, pop, allele, round(freq * freq * 100.0, 2) AS hom, round(2.0 * freq * (1 - freq) * 100.0, 2) AS het, CASE WHEN freq * 100 < 1 THEN 'very_rare' WHEN freq * 100 < 5 THEN 'rare' WHEN freq * 100 < 20 THEN 'uncommon' WHEN freq * 100 <= 50 THEN 'common' ELSE 'majority' END AS band, CASE WHEN freq >= 0.9 THEN 'high' WHEN freq >= 0.8 THEN 'moderate' WHEN freq >= 0.3 THEN 'low' ELSE 'unusable' END AS quality, CASE WHEN freq >= 0.8 THEN 9.5::DOUBLE ELSE 3.0::DOUBLE END AS cap, round(freq * 0.1 / (1 - freq * 0.9), 6) AS residual, '1 in ' || CAST(round(1.0 / freq) AS BIGINT) AS one_in FROM fx_allele_freq WHERE freq < 1")
def _(c):
    f = c.view("fx_allele_freq").where("freq < 1")
    return f.select("rsid", "pop", "allele", po.hardy_weinberg("freq", "freq", F.lit(True)).alias("hom"), po.hardy_weinberg("freq", 1 - F.col("freq"), F.lit(False)).alias("het"), po.rarity_band(F.col("freq") * 100).alias("band"), po.quality_band("freq").alias("quality"), po.max_imputed_magnitude("freq").alias("cap"), F.round(po.residual_risk("freq", F.lit(0.9), F.lit(True)), 6).alias("residual"), po.as_fraction("freq").alias("one_in"))


@query("sc27_wilson_interval", "SELECT model_id, rsid, round(greatest(0.0, (eaf + 3.841458820694124 / 200) / (1 + 3.841458820694124 / 100) - 1.959963984540054 * sqrt(eaf * (1 - eaf) / 100 + 3.841458820694124 / 40000) / (1 + 3.841458820694124 / 100)), 4) AS low, round(least(1.0, (eaf + 3.841458820694124 / 200) / (1 + 3.841458820694124 / 100) + 1.959963984540054 * sqrt(eaf * (1 - eaf) / 100 + 3.841458820694124 / 40000) / (1 + 3.841458820694124 / 100)), 4) AS high, round(ln(1 + abs(weight)), 6) AS lb FROM fx_prs_weights WHERE eaf IS NOT NULL")
def _(c):
    w = c.view("fx_prs_weights").where("eaf is not null").withColumn("i", po.wilson_interval("eaf", F.lit(100)))
    return w.select("model_id", "rsid", F.round("i.low", 4).alias("low"), F.round("i.high", 4).alias("high"), F.round(po.to_log_beta(1 + F.abs("weight"), F.lit("OR")), 6).alias("lb"))


# --- annotation, frequency, score ---------------------------------------------------------------


@query("jn01_annotate", "SELECT sample_id, rsid, gene, category, risk_allele, CAST(copies AS BIGINT) AS variant_copies, zygosity, silo, CAST(publications AS BIGINT) AS publications FROM ox_findings")
def _(c):
    return annotate.annotate(c.pooled(), c.view("fx_ref_variants")).select("sample_id", "rsid", "gene", "category", "risk_allele", "variant_copies", "zygosity", "silo", "publications")


TIER1 = "CAST(substr(rsid, 3) AS BIGINT) % 2 = 0"


@query("jn02_annotate_tiered", f"SELECT sample_id, rsid, CASE WHEN {TIER1} THEN 1::BIGINT ELSE 2::BIGINT END AS tier, CASE WHEN NOT ({TIER1}) AND copies = 0 THEN 'informational' ELSE silo END AS silo, CASE WHEN NOT ({TIER1}) AND copies = 0 THEN 'Variant allele not carried. ' || interpretation ELSE interpretation END AS interpretation FROM ox_findings")
def _(c):
    ref = c.view("fx_ref_variants")
    one = F.substring("rsid", 3, 20).cast("long") % 2 == 0
    return annotate.annotate_tiered(c.pooled(), ref.where(one), ref.where(~one)).select("sample_id", "rsid", "tier", "silo", "interpretation")


@query("wn05_dedupe_findings", "SELECT sample_id, rsid, CASE WHEN silo = 'informational' THEN 2::BIGINT ELSE 1::BIGINT END AS tier FROM ox_findings")
def _(c):
    f = annotate.annotate(c.pooled(), c.view("fx_ref_variants")).withColumn("tier", F.lit(1))
    worse = f.withColumns({"tier": F.lit(2), "silo": F.lit("actionable")})
    both = f.where("silo <> 'informational'").unionByName(worse.where("silo is not null")).unionByName(f.where("silo = 'informational'"))
    return annotate.dedupe_findings(both).select("sample_id", "rsid", "tier")


@query("jn03_attach_calls", "SELECT f.sample_id, f.rsid, f.n_real AS n_calls, f.conflict, count(m.rsid) FILTER (m.gkey <> 'NN') AS relatives, count(m.rsid) FILTER (m.gkey = f.gkey AND m.gkey <> 'NN') AS shared FROM ox_findings f LEFT JOIN ox_pooled m ON CAST(FLOOR(m.sample_id / 4.0) AS BIGINT) = CAST(FLOOR(f.sample_id / 4.0) AS BIGINT) AND m.sample_id <> f.sample_id AND m.rsid = f.rsid GROUP BY ALL")
def _(c):
    p = c.pooled()
    fam = F.floor(F.col("sample_id") / 4)
    other = p.where("genotype <> 'NN'").select(F.col("sample_id").alias("relative"), fam.alias("fam"), "rsid", "genotype", F.lit("relative").alias("role"))
    rel = other.join(p.select("sample_id", fam.alias("fam")).distinct(), "fam").where("sample_id <> relative").select("sample_id", "relative", "role", "rsid", "genotype")
    out = annotate.attach_calls(annotate.annotate(p, c.view("fx_ref_variants")).drop("genotype"), p, rel)
    return out.select("sample_id", "rsid", F.col("count").alias("n_calls"), "conflict", F.size("comparison").alias("relatives"), F.size(F.filter("comparison", lambda r: r["shared"])).alias("shared"))


@query("jn06_resolve_strand", "SELECT sample_id, rsid, fx1 AS a1, fx2 AS a2, flip, ambiguous FROM ox_strand")
def _(c):
    return annotate.resolve_strand(c.pooled(), c.view("fx_allele_freq")).select("sample_id", "rsid", F.col("freq_allele1").alias("a1"), F.col("freq_allele2").alias("a2"), F.col("freq_flipped").alias("flip"), F.col("freq_ambiguous").alias("ambiguous"))


@query("jn07_genotype_frequency", "SELECT sample_id, rsid, pop, freq, band FROM ox_band WHERE pop = 'POP1'")
def _(c):
    return annotate.genotype_frequency(c.pooled(), c.view("fx_allele_freq"), "POP1").select("sample_id", "rsid", "pop", "freq", F.col("freq_band").alias("band"))


@query("jn08_population_series", "SELECT sample_id, rsid, pop, freq, pop = 'POP2' AS yours FROM ox_freq")
def _(c):
    return annotate.population_series(c.pooled(), c.view("fx_allele_freq"), "POP2").select("sample_id", "rsid", "pop", "freq", "yours")


@query("ag23_aggregate_frequency", "SELECT sample_id, rsid, round(max(freq), 2) AS freq_max, round(min(freq), 2) AS freq_min FROM ox_freq GROUP BY ALL")
def _(c):
    return annotate.aggregate_frequency(c.pooled(), c.view("fx_allele_freq")).select("sample_id", "rsid", "freq_max", "freq_min")


# even markers have an overlay for each homozygous genotype, odd ones for A and C alone, which G and T meet on the other strand
OVERLAID = """SELECT sample_id, rsid, CASE WHEN hit THEN 1.0 + m % 4 END AS overlay_magnitude, CASE WHEN hit THEN CASE WHEN m % 2 = 0 THEN 'Good' ELSE 'Bad' END END AS overlay_repute, CASE WHEN hit THEN token || ' of ' || rsid END AS overlay_summary, CASE WHEN hit THEN token END AS token, hit AND m % 2 = 1 AND x IN ('G', 'T') AS flipped
 FROM (SELECT *, '(' || b || ';' || b || ')' AS token FROM (SELECT *, CASE WHEN m % 2 = 0 THEN x WHEN x IN ('A', 'T') THEN 'A' ELSE 'C' END AS b FROM (SELECT sample_id, rsid, CAST(substr(rsid, 3) AS BIGINT) AS m, substr(gkey, 1, 1) AS x, gkey <> 'NN' AND substr(gkey, 1, 1) = substr(gkey, 2, 1) AS hit FROM ox_findings)))"""


@query("jn10_overlay_genotypes", OVERLAID)
def _(c):
    f = annotate.annotate(c.pooled(), c.view("fx_ref_variants"))
    m = F.substring("rsid", 3, 20).cast("long")
    of = lambda bases: F.array(*[F.lit(f"({b};{b})") for b in bases])
    rows = c.view("fx_ref_variants").select("rsid", F.explode(F.when(m % 2 == 0, of("ACGT")).otherwise(of("AC"))).alias("token"))
    overlay = rows.select("rsid", "token", (m % 4 + 1.0).alias("overlay_magnitude"), F.when(m % 2 == 0, "Good").otherwise("Bad").alias("overlay_repute"), F.concat("token", F.lit(" of "), "rsid").alias("overlay_summary"))
    return annotate.overlay_genotypes(f, overlay).select("sample_id", "rsid", "overlay_magnitude", "overlay_repute", "overlay_summary", "token", "flipped")


SCORED = "SELECT sample_id, rsid, gene, zygosity, CAST(copies AS BIGINT) AS variant_copies, freq, band AS freq_band, magnitude, repute, confidence, evidence, CAST(stars AS BIGINT) AS review_stars, CAST(code AS BIGINT) AS clinvar_sig_code, silo FROM ox_scored"
SCORED_COLUMNS = ("sample_id", "rsid", "gene", "zygosity", "variant_copies", "freq", "freq_band", "magnitude", "repute", "confidence", "evidence", "review_stars", "clinvar_sig_code", "silo")


@query("pl1_scan", SCORED)
def _(c):
    return c.scan()["findings"].select(*SCORED_COLUMNS)


KEYS = "CASE WHEN cpic_level = 'A' THEN 'cpic_a' WHEN code IN (4, 5) AND stars >= 3 THEN 'clinvar_path_3star' WHEN cpic_level IN ('A/B', 'B') THEN 'cpic_b' WHEN code = 5 AND stars = 2 THEN 'clinvar_path_2star' WHEN code = 4 AND stars >= 2 THEN 'clinvar_lp_2star' WHEN stars <= 1 AND code IN (1, 4, 5, 255) THEN 'clinvar_single' ELSE 'default' END"
TRAIL = f"""concat_ws(' ', 'evidence:' || {KEYS}, CASE WHEN zygosity = 'no_call' THEN 'no_call' END, CASE WHEN zygosity <> 'no_call' AND copies <> 1 THEN 'copies:' || copies END, CASE WHEN zygosity <> 'no_call' AND band IN ('very_rare', 'rare', 'majority') THEN 'rarity:' || band END,
 CASE WHEN zygosity <> 'no_call' AND publications > 0 THEN 'literature' END, CASE WHEN zygosity <> 'no_call' AND ambiguous THEN CASE WHEN s > 2.0 THEN 'strand_cap' ELSE 'strand_unverified' END END)"""


@query("sc20_score_findings", f"SELECT sample_id, rsid, magnitude, base AS magnitude_base, zygosity = 'no_call' OR ambiguous AS dubious, {TRAIL} AS trail FROM ox_scored")
def _(c):
    return c.scan()["findings"].select("sample_id", "rsid", "magnitude", "magnitude_base", "dubious", F.array_join(F.transform("magnitude_factors", lambda x: x["step"]), " ").alias("trail"))


@query("pl2_rescore", "SELECT sample_id, rsid, freq, band AS freq_band, magnitude, repute, confidence FROM ox_scored_pop3")
def _(c):
    return rescore(c.scan()["findings"], c.view("fx_allele_freq"), "POP3").select("sample_id", "rsid", "freq", "freq_band", "magnitude", "repute", "confidence")


@query("pl5_lookup", "SELECT r.rsid, r.gene, r.clinical_sig, string_agg(f.pop || ':' || f.allele || '=' || printf('%.2f', f.freq), ' ' ORDER BY f.pop || ':' || f.allele || '=' || printf('%.2f', f.freq)) AS frequencies FROM fx_ref_variants r LEFT JOIN fx_allele_freq f ON f.rsid = r.rsid WHERE r.rsid IN ('rs1001', 'rs1002', 'rs1009') GROUP BY ALL")
def _(c):
    return lookup(["rs1001", "RS1002", "rs1009"], c.view("fx_ref_variants"), c.view("fx_allele_freq")).select("rsid", "gene", "clinical_sig", "frequencies")


@query("sc31_finding_defaults", "SELECT sample_id, rsid, copies > 0 AS carrier, '' AS summary FROM ox_findings")
def _(c):
    return annotate.finding_defaults(annotate.annotate(c.pooled(), c.view("fx_ref_variants"))).select("sample_id", "rsid", "carrier", "summary")


# --- findings store -----------------------------------------------------------------------------


@query("fl1_filter_findings", "SELECT sample_id, rsid FROM ox_scored WHERE magnitude >= 1.5 AND repute IN ('Bad', '') AND publications >= 20 AND (freq IS NULL OR freq <= 60) AND stars >= 1 AND zygosity IN ('heterozygous', 'homozygous') AND copies > 0")
def _(c):
    return findings.filter_findings(c.scan()["findings"], min_magnitude=1.5, reputes=("bad", "unset"), min_publications=20, max_freq=60, min_stars=1, zygosities=("heterozygous", "homozygous"), carrier_only=True).select("sample_id", "rsid")


@query("fl1_clinvar_mode", "SELECT sample_id, rsid FROM ox_scored WHERE code IN (4, 5) AND freq IS NOT NULL AND freq >= 5")
def _(c):
    return findings.filter_findings(c.scan()["findings"], clinvar_only=True, require_frequency=True, min_freq=5).select("sample_id", "rsid")


@query("fl3_search_findings", "SELECT sample_id, rsid FROM ox_scored WHERE magnitude > 1.2 AND stars >= 2 AND (freq IS NOT NULL AND freq < 70) AND (lower(gene || ' ' || interpretation) LIKE '%warfarin%')")
def _(c):
    return findings.search_findings(c.scan()["findings"], flags=("typed",), ops=(("mag", ">", 1.2), ("stars", ">=", 2), ("freq", "<", 70)), pattern="WARFARIN").select("sample_id", "rsid")


@query("fl3_region", "SELECT sample_id, rsid FROM ox_scored WHERE chrom_no = 3 AND position BETWEEN 100000 AND 2000000")
def _(c):
    return findings.search_findings(c.scan()["findings"], region=("3", 100000, 2000000)).select("sample_id", "rsid")


@query("fl9_findings_by_silo", "SELECT sample_id, rsid, silo, gene FROM ox_findings WHERE sample_id = 3 AND silo = 'actionable'")
def _(c):
    return findings.findings_by_silo(annotate.annotate(c.pooled(), c.view("fx_ref_variants")), 3, "actionable").select("sample_id", "rsid", "silo", "gene")


@query("tk2_page", "SELECT sample_id, rsid, magnitude FROM ox_scored ORDER BY magnitude DESC, sample_id, rsid LIMIT 50 OFFSET 25")
def _(c):
    return findings.page(c.scan()["findings"], 50, 25).select("sample_id", "rsid", "magnitude")


@query("tk1_sort_by_gene", "SELECT sample_id, rsid, gene FROM ox_scored ORDER BY gene, sample_id, rsid LIMIT 40")
def _(c):
    return findings.page(c.scan()["findings"], 40, 0, "gene", False).select("sample_id", "rsid", "gene")


@query("ag08_qc_summary", "SELECT p.sample_id, p.positions, p.conflicts, s.findings, s.flipped, s.ambiguous, s.no_call, s.dubious, s.non_carrier FROM (SELECT sample_id, count(*) AS positions, count(*) FILTER (conflict) AS conflicts FROM ox_pooled GROUP BY sample_id) p JOIN (SELECT sample_id, count(*) AS findings, count(*) FILTER (flip) AS flipped, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (zygosity = 'no_call') AS no_call, count(*) FILTER (zygosity = 'no_call' OR ambiguous) AS dubious, count(*) FILTER (copies = 0) AS non_carrier FROM ox_scored GROUP BY sample_id) s ON s.sample_id = p.sample_id")
def _(c):
    return c.scan()["qc"]


@query("ag09_ranges", "SELECT max(magnitude) AS max_magnitude, CAST(max(publications) AS BIGINT) AS max_publications, max(freq) AS max_freq FROM ox_scored")
def _(c):
    return c.scan()["ranges"]


@query("ag10_summary", "SELECT 'silo' AS kind, silo AS value, count(*) AS n FROM ox_scored GROUP BY silo UNION ALL SELECT 'entity_type', 'snp', count(*) FROM ox_scored UNION ALL SELECT 'repute', CASE WHEN repute = '' THEN 'unset' ELSE repute END, count(*) FROM ox_scored GROUP BY repute")
def _(c):
    return c.scan()["summary"]


@query(
    "ag11_facets",
    """SELECT facet, value, count(*) AS n FROM (SELECT unnest(['genes', 'silos', 'entity_types', 'zygosity', 'categories', 'clinvar_significance', 'cpic_levels', 'freq_bands', 'confidence', 'reputes', 'review_stars']) AS facet,
    unnest([gene, silo, 'snp', zygosity, category, clinical_sig, cpic_level, band, confidence, CASE WHEN repute = '' THEN 'Not Set' ELSE repute END, CAST(stars AS VARCHAR)]) AS value FROM ox_scored) WHERE value <> '' GROUP BY ALL""",
)
def _(c):
    return findings.facets(c.scan()["findings"])


@query("ag12_drug_groups", "SELECT sample_id, 'med' || CAST(substr(rsid, 3)::BIGINT % 5 AS VARCHAR) AS medicine, count(*) AS n, max(magnitude) AS max_magnitude, coalesce(arg_min(cpic_level, CASE cpic_level WHEN 'A' THEN 0 WHEN 'A/B' THEN 1 WHEN 'B' THEN 2 WHEN 'D' THEN 6 END) FILTER (cpic_level <> ''), '') AS best_level FROM ox_scored GROUP BY ALL")
def _(c):
    f = c.scan()["findings"].withColumn("medicines", F.array(F.concat(F.lit("med"), (F.substring("rsid", 3, 20).cast("long") % 5).cast("string"))))
    return findings.drug_groups(f)


@query("snk1_upsert_findings", "SELECT sample_id, rsid, CASE WHEN CAST(substr(rsid, 3) AS BIGINT) % 3 = 0 THEN 'new' ELSE 'old' END AS gene, CASE WHEN CAST(substr(rsid, 3) AS BIGINT) % 3 = 0 AND sample_id % 2 = 1 THEN 'd2' ELSE 'd1' END AS discovered_at FROM ox_findings WHERE sample_id % 2 = 0 OR CAST(substr(rsid, 3) AS BIGINT) % 3 = 0")
def _(c):
    base = annotate.annotate(c.pooled(), c.view("fx_ref_variants")).select("sample_id", "rsid")
    old = base.where("sample_id % 2 = 0").withColumns({"gene": F.lit("old"), "discovered_at": F.lit("d1")})
    new = base.where(F.substring("rsid", 3, 20).cast("long") % 3 == 0).withColumns({"gene": F.lit("new"), "discovered_at": F.lit("d2")})
    return findings.upsert_findings(old, new)


@query("snk6_erase_samples", "SELECT sample_id, count(*) AS n FROM ox_pooled WHERE sample_id % 4 <> 0 GROUP BY sample_id")
def _(c):
    p = c.pooled()
    ids = p.where("sample_id % 4 = 0").select("sample_id")
    return findings.erase_samples({"pooled": p}, ids)["pooled"].groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
