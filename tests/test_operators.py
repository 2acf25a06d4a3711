"""Small cases of joins, folds, rules and histories."""

import random

import pytest
from pyspark.sql import functions as F

from genocohort.operators import ancestry, carrier, concord, family, findings, history, imputed, pgx, pool, population, provenance, rules, text

CALL = "sample_id long, kit string, label string, kit_ord int, provider string, seq long, rsid string, chromosome string, position long, allele1 string, allele2 string"


@pytest.fixture(scope="module")
def calls(spark):
    rows = [
        (1, "k0", "k0", 0, "a", 1, "RS1", "1", 10, "N", "N"), (1, "k0", "k0", 0, "a", 2, "rs1", "1", 10, "A", "G"), (1, "k0", "k0", 0, "a", 3, "rs1", "1", 10, "A", "A"), (1, "k1", "k1", 1, "", 1, "rs1", "1", 10, "G", "A"),
        (1, "k0", "k0", 0, "a", 4, "rs2", "", 0, "-", "-"), (1, "k1", "k1", 1, "", 2, "rs2", "2", 20, "C", "C"), (1, "k0", "k0", 0, "a", 5, "rs3", "3", 30, "A", "C"), (1, "k1", "k1", 1, "", 3, "rs3", "3", 30, "T", "G"), (1, "k0", "k0", 0, "a", 6, "rs4", "4", 40, "A", "A"), (1, "k1", "k1", 1, "", 4, "rs4", "4", 40, "A", "G"),
    ]
    return pool.dedupe_kit(spark.createDataFrame(rows, CALL))


def test_pool(calls):
    p = {r.rsid: r for r in pool.pool_calls(calls).collect()}
    assert (p["rs1"].genotype, p["rs1"]["count"], p["rs1"].conflict) == ("AG", 2, False)
    assert (p["rs2"].genotype, p["rs2"].labels, p["rs2"].chromosome, p["rs2"].position) == ("CC", ["k1"], "2", 20)
    assert p["rs3"].conflict and [c.genotype for c in p["rs3"].calls] == ["AC", "GT"]


def test_concordance(calls):
    kits = calls.select("sample_id", "label", "provider").distinct()
    r = concord.concordance(calls, kits).first()
    assert (r.shared, r.agree, r.orientation_artifact, r.genuine, r.not_comparable) == (3, 1, 1, 1, 1) and r.agreement_rate == round(1 / 3, 6)
    lone = concord.concordance_totals(concord.concordance(calls, kits).where("false"), kits.where("label = 'k0'")).first()
    assert not lone.attempted and lone.shared is None and lone.agreement_rate is None


def test_label_kits(spark):
    rows = [(1, 0, "a", "me"), (1, 1, "a", "self"), (1, 2, "", "mom"), (1, 3, "a", "skip"), (1, 4, "a (2)", "dad"), (1, 5, "a", "self")]
    got = [r.label for r in pool.label_kits(spark.createDataFrame(rows, "sample_id long, kit_ord int, label string, role string")).orderBy("kit_ord").collect()]
    assert got == ["a", "a (3)", "file3", "a (2)", "a (4)"]


def greedy(ibs, max_oh):
    runs, start, oh = [], 0, []
    for i, v in enumerate(ibs):
        if v:
            continue
        if i == start:
            start = i + 1
        elif len(oh) < max_oh:
            oh.append(i)
        else:
            runs.append((start, i - 1, oh))
            start, oh = i + 1, []
    runs.append((start, len(ibs) - 1, oh))
    out = []
    for s, e, oh in runs:
        while e >= s and e in oh:
            e -= 1
        if e >= s:
            out.append((s, e))
    return out


@pytest.mark.parametrize("max_oh", [0, 1, 2])
def test_segments_equal_a_greedy_walk(spark, max_oh):
    rng = random.Random(max_oh)
    rows, want = [], set()
    for pair in range(30):
        ibs = [0 if rng.random() < 0.25 else rng.choice([1, 2]) for _ in range(rng.randint(1, 25))]
        rows += [(pair, pair + 100, 1, i * 1000, f"rs{i:03d}", v) for i, v in enumerate(ibs)]
        want |= {(pair, s * 1000, e * 1000) for s, e in greedy(ibs, max_oh) if e - s + 1 >= 2}
    df = spark.createDataFrame(rows, "a long, b long, chrom_no int, position long, rsid string, ibs int")
    gmap = spark.createDataFrame([(1, 0, 0.0), (1, 30000, 3.0)], "chrom_no int, bp long, cm double")
    got = family.ibd_segments(df, gmap, min_snps=2, min_cm=0.0, max_oh=max_oh).collect()
    assert {(r.a, r.start_bp, r.end_bp) for r in got} == want
    assert all(abs(r.cm - (r.end_bp - r.start_bp) / 10000) < 1e-3 for r in got)


def test_transmission(spark):
    key = lambda v: F.lit(v)
    row = spark.range(1).select(*[family.transmission(key(c), key(m), key(f)).alias(f"p{i}") for i, (c, m, f) in enumerate([("AG", "AG", "AG"), ("AA", "AG", "GG"), ("AG", "AA", "GG"), ("NN", "AA", "AA")])]).first()
    assert tuple(row) == (0.5, 0.0, 1.0, None)


def test_liftover_takes_the_best_chain_and_no_other(spark):
    blocks = spark.createDataFrame([(1, 1, 0, 100, 1000, "+", 9), (1, 1, 200, 300, 1200, "+", 9), (1, 2, 0, 400, 5000, "-", 5)], "chrom_no int, chain_id int, t_start long, t_end long, q_start long, strand string, score long")
    pts = spark.createDataFrame([(1, 51, "A", "C"), (1, 151, "A", "C"), (1, 351, "A", "C"), (2, 1, "A", "C")], "chrom_no int, position long, allele1 string, allele2 string")
    got = {(r.chrom_no, r.position): (r.status, r.new_position, r.new_allele1) for r in family.liftover(pts, blocks).collect()}
    assert got == {(1, 51): ("mapped", 1051, "A"), (1, 151): ("gap in the chain", None, None), (1, 351): ("mapped", 50, "T"), (2, 1): ("no chain", None, None)}


def test_rules(spark):
    nodes = spark.createDataFrame([("R1", 1, 0, "geno", 0, "rs1", "A", ""), ("R2", 1, 0, "not", 0, "", None, ""), ("R2", 2, 1, "geno", 0, "rs1", "A/G", ""), ("R2", 3, 1, "geno", 0, "rs9", "A", ""), ("R3", 1, 0, "atleast", 2, "", None, ""), ("R3", 2, 1, "rule", 0, "", None, "R1"), ("R3", 3, 1, "rule", 0, "", None, "R2"), ("R3", 4, 1, "rule", 0, "", None, "RX")], "rule_id string, node_id int, parent_id int, op string, n int, rsid string, alleles string, ref_rule string")
    calls = spark.createDataFrame([(1, "rs1", "A", "A"), (2, "rs1", "G", "A"), (3, "rs1", "N", "N")], "sample_id long, rsid string, allele1 string, allele2 string")
    got = {(r.sample_id, r.rule_id): r.matched for r in rules.evaluate_rules(calls, nodes).collect()}
    assert got == {(1, "R1"): True, (1, "R2"): True, (1, "R3"): True, (2, "R1"): True, (2, "R2"): False, (2, "R3"): False, (3, "R1"): False, (3, "R2"): True, (3, "R3"): False}
    with pytest.raises(rules.RuleError):
        rules.rule_levels(spark.createDataFrame([("A", "B"), ("B", "A"), ("C", ""), ("D", "C")], "rule_id string, ref_rule string"))
    with pytest.raises(rules.RuleError):
        rules.evaluate_rules(calls, nodes.where("node_id = 1 or rule_id <> 'R2'"))


def test_long_chains_and_plans(spark):
    chain = spark.createDataFrame([(f"R{i}", f"R{i - 1}" if i else "") for i in range(52)] + [("S", "R9"), ("T", "nowhere")], "rule_id string, ref_rule string")
    assert {r.rule_id: r.level for r in rules.rule_levels(chain).collect()} == {f"R{i}": i for i in range(52)} | {"S": 10, "T": 0}
    kinds = "rule_id string, node_id int, parent_id int, op string, n int, rsid string, alleles string, ref_rule string"
    calls = spark.createDataFrame([(1, "rs1", "A", "A"), (2, "rs1", "G", "G")], "sample_id long, rsid string, allele1 string, allele2 string")
    lengths = []
    for n in (2, 200):
        rows = [(f"R{i}", 1, 0, "geno", 0, "rs1", "A", "") for i in range(n)] + [(f"N{i}", k, k and 1, "not" if k == 1 else "rule", 0, "", None, f"R{i}" if k == 2 else "") for i in range(n) for k in (1, 2)]
        rows = [(r, a, 0 if a == 1 else 1, *x) for r, a, _, *x in rows]
        nodes = spark.createDataFrame(rows, kinds)
        out = rules.evaluate_rules(calls, nodes)
        lengths.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert {(r.sample_id, r.rule_id) for r in out.where("matched").collect()} == {(1, f"R{i}") for i in range(n)} | {(2, f"N{i}") for i in range(n)} == {(r.sample_id, r.rule_id) for r in rules.rule_matches(calls, nodes).collect()}
    assert lengths[1] < 1.1 * lengths[0]  # rules are rows, not columns


def test_snapshot_kinds(spark):
    kinds = "entry_key string, digest string, clinvar_sig_code int, review_stars int, cpic_level string, magnitude double, repute string, carrier int, evaluable boolean"
    old = [("vus_up", 1, 0, "", 1.0, "", 1, True), ("vus_down", 1, 0, "", 1.0, "", 1, True), ("up", 2, 0, "", 1.0, "", 1, True), ("down", 5, 0, "", 1.0, "", 1, True), ("off", 5, 0, "", 1.0, "", 1, True), ("star", 5, 1, "B", 1.0, "", None, True), ("lost", 5, 3, "A", None, "Good", 0, True), ("able", 5, 3, "", 1.0, "", 1, False), ("gone", 5, 3, "", 1.0, "", 1, True), ("same", 5, 3, "", 1.0, "", 1, True)]
    new = [("vus_up", 5, 0, "", 1.0, "", 1, True), ("vus_down", 2, 0, "", 1.0, "", 1, True), ("up", 4, 0, "", 1.0, "", 1, True), ("down", 3, 0, "", 1.0, "", 1, True), ("off", 255, 0, "", 1.0, "", 1, True), ("star", 5, 2, "A", 1.0, "", 2, True), ("lost", 5, 2, "A", 2.0, "Bad", 0, False), ("able", 5, 3, "", 1.0, "", 1, True), ("new", 5, 3, "", 1.0, "", 1, True), ("same", 5, 3, "", 1.0, "", 1, True)]
    frame = lambda rows: spark.createDataFrame([(r[0], str(r[1:]), *r[1:]) for r in rows], kinds)
    got = {(r.entry_key, r.kind, r.direction) for r in history.diff_pairs(frame(old), frame(new), ["entry_key"]).collect()}
    assert got == {
        ("vus_up", "vus_resolved_pathogenic", "up"), ("vus_down", "vus_resolved_benign", "down"), ("up", "sig_upgraded", "up"), ("down", "sig_downgraded", "down"), ("off", "sig_reclassified", "lateral"), ("star", "stars_gained", "up"), ("star", "cpic_level_changed", "up"), ("star", "carrier_status_changed", "up"),
        ("lost", "stars_lost", "down"), ("lost", "magnitude_changed", "up"), ("lost", "repute_changed", "up"), ("lost", "no_longer_evaluable", "down"), ("able", "newly_evaluable", "up"), ("gone", "finding_removed", "down"), ("new", "finding_added", "up"),
    }
    assert {k for _, k, _ in got} == set(history.SEVERITY)


def test_star_alleles(spark):
    defs = spark.createDataFrame([("G", "*2", "rs1", "T"), ("G", "*3", "rs1", "T"), ("G", "*3", "rs2", "T"), ("G", "*9", "rs9", "T")], "gene string, allele string, rsid string, base string")
    calls = spark.createDataFrame([(1, "rs1", "T", "T"), (1, "rs2", "C", "T"), (2, "rs1", "C", "C"), (2, "rs2", "C", "C")], "sample_id long, rsid string, allele1 string, allele2 string")
    got = {r.sample_id: (r.diplotype, r.reference_inferred, r.confidence) for r in pgx.assign_slots(calls, defs).collect()}
    assert got == {1: ("*2/*3", False, "moderate"), 2: ("*1/*1", True, "low")}
    panel = spark.createDataFrame([("G", "rs1", "T", True), ("G", "rs9", "T", True), ("H", "rs2", "T", False)], "gene string, rsid string, allele string, array_testable boolean")
    status = {(r.sample_id, r.gene): r.status for r in carrier.carrier_status(calls, panel).collect()}
    assert status == {(1, "G"): "carrier", (2, "G"): "not_carrier_for_tested_variants", (1, "H"): "untestable", (2, "H"): "untestable"}


def test_fst_extremes(spark):
    df = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 10, 10), ("b", 1, 5, 10), ("b", 2, 5, 10), ("c", 1, 5, 10)], "marker string, pop int, alt long, n long")
    assert {r.marker: round(r.fst, 9) for r in population.fst(df).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert {r.marker: round(r.informativeness, 4) for r in population.informativeness(df).collect()} == {"a": 0.6931, "b": 0.0, "c": 0.0}


def test_filters_keep_other_entities(spark):
    df = spark.createDataFrame([("snp", None, None, 5), ("trait", None, None, 0), ("snp", 0.0, 3.0, 50), ("snp", 30.0, 0.5, 50)], "entity_type string, freq double, magnitude double, publications int")
    n = lambda **k: findings.filter_findings(df, **k).count()
    assert n(min_publications=10) == 3 and n(min_freq=1) == 2 and n(max_freq=10) == 3 and n(require_frequency=True) == 3 and n(min_magnitude=1) == 3 and n(min_freq=0) == 4
    assert findings.search_findings(df, ops=(("dr2", "<", 0.5),)).count() == 0 and findings.search_findings(df, flags=("typed",)).count() == 4


def test_imputed(spark):
    df = spark.createDataFrame([(8.0, True, 0.95), (8.0, True, 0.5), (8.0, False, 0.5), (8.0, None, None), (9.9, True, 0.9)], "magnitude double, imputed boolean, dr2 double")
    assert [r.magnitude for r in imputed.apply_imputation_cap(df).collect()] == [8.0, 3.0, 8.0, 8.0, 9.5]


def test_texts(spark):
    df = spark.createDataFrame([(1, "You MUST stop, rs12 and AG", ["AG", "rs12"]), (2, None, None)], "id long, t string, tokens array<string>")
    assert [r.phrases for r in text.banned_phrase_scan(df, ["t"], ("you must", "never")).collect()] == [["you must"]]
    r = {x.id: x for x in text.redact_tokens(df, "t", "tokens").collect()}
    assert r[1].redacted == "You MUST stop, [removed] and [removed]" and r[1].leaks == 0 and r[2].redacted is None
    src = spark.createDataFrame([("a", "x", True, True), ("b", "y", False, True)], "source_id string, licence string, redistributable boolean, commercial_ok boolean")
    f = spark.createDataFrame([(1, "r", ["a"]), (2, "r", ["a", "b"]), (3, "r", ["a", "zz"])], "sample_id long, rsid string, sources array<string>")
    got = {x.sample_id: (x.redistributable, x.commercial_ok, x.unknown_sources) for x in provenance.attach_sources(f, src).collect()}
    assert got == {1: (True, True, 0), 2: (False, True, 0), 3: (False, False, 1)}


def test_unresolvable_is_null(spark):
    q = spark.createDataFrame([(1, "P", 0.4), (1, "Q", 0.6)], "sample_id long, pop string, proportion double")
    cov = spark.createDataFrame([(1, "P", 100, True), (1, "Q", 3, False)], "sample_id long, pop string, read long, resolvable boolean")
    got = {r["pop"]: (r.proportion, r.raw, r.withheld) for r in ancestry.report_proportions(q, cov).collect()}
    assert got == {"P": (0.4, 0.4, 0.0), "Q": (None, 0.6, 0.6)}
