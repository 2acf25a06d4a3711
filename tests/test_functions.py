"""Hand-computed values of row-level functions."""

import math

import pytest
from pyspark.sql import functions as F

from genocohort.functions import alleles as al
from genocohort.functions import population as po
from genocohort.functions import scoring as sc


@pytest.fixture(scope="module")
def value(spark):
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run


L = F.lit


@pytest.mark.parametrize("a,b,key", [("A", "G", "AG"), ("g", "a", "AG"), ("N", "A", "NN"), ("-", "-", "NN"), (None, "A", "NN"), ("D", "I", "NN")])
def test_genotype_key(value, a, b, key):
    assert value(al.genotype_key(L(a).cast("string"), L(b))) == key


def test_strand(value):
    assert value(F.array(*[al.complement(L(x)) for x in ("A", "c", "N", "D", "Q", "")])) == ["T", "G", "N", "D", "N", "N"]
    assert value(al.is_palindromic(L("T"), L("A"))) and not value(al.is_palindromic(L("A"), L("A"))) and not value(al.is_palindromic(L("A"), L("G")))
    assert value(F.array(al.genotype_token(L("T"), L("C")), al.genotype_token(L("N"), L("-")), al.genotype_token(L("N"), L("A")))) == ["(C;T)", "(-;-)", "(A;N)"]
    o = value(al.orient(L("A"), L("G"), L("minus"), L("plus")))
    assert (o.allele1, o.allele2, o.flipped, o.source_genotype, o.orientation) == ("C", "T", True, "AG", "minus")
    assert value(al.orient(L("A"), L("G"), L(""), L("-1")))["flipped"] and not value(al.orient(L("A"), L("G"), L("odd"), L("-1")))["flipped"]
    assert value(al.candidate_tokens(L("A"), L("G"))) == ["(A;G)", "(C;T)"] and value(al.candidate_tokens(L("A"), L("T"))) == ["(A;T)"] and value(al.candidate_tokens(L("A"), L("N"))) == []


def test_names(value):
    assert value(F.array(*[al.normalize_role(L(x)) for x in ("Mum", "SELF", "brother", "cousin", "skip")])) == ["mother", "self", "sibling", "other", "ignore"]
    assert value(F.array(*[al.normalize_contig(L(x)) for x in ("chr1", "M", "chrX", "23")])) == ["1", "MT", "X", "23"]
    assert value(al.normalize_contig(L("23"), numeric_sex=True)) == "X" and value(al.normalize_contig(L("26"), numeric_sex=True)) == "MT"


def test_orders(spark):
    ids = [r.x for r in spark.createDataFrame([("rs100",), ("rs99",), ("i7",), ("zz",)], "x string").orderBy(al.rsid_order("x")).collect()]
    assert ids == ["i7", "rs99", "rs100", "zz"]
    chroms = [r.x for r in spark.createDataFrame([("MT",), ("chr10",), ("X",), ("2",), ("HLA",), ("Y",)], "x string").orderBy(al.chrom_order("x")).collect()]
    assert chroms == ["2", "chr10", "X", "Y", "MT", "HLA"]


def test_doses(value):
    assert value(F.array(*[al.zygosity(L(a), L(b)) for a, b in (("A", "A"), ("A", "G"), ("A", "N"), ("-", "0"))])) == ["homozygous", "heterozygous", "hemizygous", "no_call"]
    assert value(al.copies(L("A"), L("N"), L("a"))) == 1 and value(al.dosage(L("A"), L("N"), L("A"))) is None and value(al.dosage(L("A"), L("A"), L(""))) is None and value(al.copies(L("A"), L("A"), L(""))) == 0


@pytest.mark.parametrize("text,code", [("Pathogenic", 5), ("conflicting classifications of pathogenicity", 255), ("likely pathogenic, risk factor", 4), ("", None), (None, None), ("new word", 255), ("benign/likely benign", 2), ("drug response", 6)])
def test_sig_code(value, text, code):
    assert value(sc.sig_code(L(text).cast("string"))) == code


def test_vocabularies(value):
    assert value(sc.review_stars(L(" Practice Guideline "))) == 4 and value(sc.review_stars(L("unheard of"))) == 0
    assert value(F.array(*[sc.cpic_level(L(x)) for x in ("a/b", "retired", "E", " C / D ")])) == ["A/B", "Retired", "", "C/D"]
    assert value(F.array(*[sc.direction(L(x)) for x in ("increased risk", "taste and increased risk", "reduced risk", "no increased risk factor", "nothing", "poor metabolizer, protective")])) == ["risk", "neutral", "protective", "protective" if len("no increased") > len("increased risk") else "risk", "", "risk"]
    assert value(sc.classify_silo(L("Avoid warfarin"))) == "pre_prescription" and value(sc.classify_silo(L("elevated"))) == "actionable"


def row(spark, **kw):
    base = dict(zygosity="heterozygous", variant_copies=1, cpic_level="", clinical_sig="", review_status="", publications=0, freq_band="unknown", ambiguous=False, interpretation="", entity_type="snp")
    kinds = "zygosity string, variant_copies int, cpic_level string, clinical_sig string, review_status string, publications int, freq_band string, ambiguous boolean, interpretation string, entity_type string"
    return sc.score_findings(spark.createDataFrame([tuple((base | kw).values())], kinds)).first()


def test_scores(spark):
    assert row(spark, cpic_level="A").magnitude == 6.0
    assert row(spark, cpic_level="A", variant_copies=0).magnitude == 1.5
    assert row(spark, cpic_level="A", variant_copies=2, freq_band="very_rare").magnitude == 8.3
    assert row(spark, clinical_sig="pathogenic", review_status="reviewed by expert panel").evidence_key == "clinvar_path_3star"
    assert row(spark, publications=99).magnitude == 2.0
    capped = row(spark, cpic_level="A", ambiguous=True)
    assert capped.magnitude == 2.0 and capped.dubious and capped.confidence == "none" and [tuple(x) for x in capped.magnitude_factors] == [("evidence:cpic_a", 6.0, 6.0), ("strand_cap", 2.0, 2.0)]
    lost = row(spark, cpic_level="A", zygosity="no_call")
    assert (lost.magnitude, lost.repute, lost.confidence) == (0.0, "", "none")
    assert row(spark, clinical_sig="pathogenic").repute == "Bad" and row(spark, interpretation="reduced risk", clinical_sig="pathogenic").repute == "Good"
    assert row(spark, clinical_sig="pathogenic", entity_type="trait").repute == "" and row(spark, clinical_sig="benign", variant_copies=0).repute == ""


@pytest.mark.parametrize("z", [-3.5, -1.0, 0.0, 0.5, 1.96, 4.0])
def test_normal(value, z):
    p = 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert abs(value(po.normal_cdf(L(z))) - p) < 1e-7 and abs(value(po.inverse_normal_cdf(L(p))) - z) < 1e-3


def test_bands(value):
    assert value(F.array(*[po.rarity_band(L(x).cast("double")) for x in (0.0, 0.99, 1.0, 5.0, 20.0, 50.0, 50.1, None)])) == ["very_rare", "very_rare", "rare", "uncommon", "common", "common", "majority", "unknown"]
    assert value(F.array(*[po.prs_band(L(x).cast("double")) for x in (9.9, 10.0, 30.0, 70.0, 90.0, 90.1, None)])) == ["low", "below_average", "average", "average", "above_average", "high", "unknown"]
    assert value(F.array(*[po.quality_band(L(x).cast("double")) for x in (0.9, 0.8, 0.3, 0.1, None)])) == ["high", "moderate", "low", "unusable", "unknown"]
    w = value(po.wilson_interval(L(0.5), L(0)))
    assert (w.low, w.high) == (0.0, 1.0)
    assert value(F.array(po.as_fraction(L(0.25)), po.as_fraction(L(0.0)), po.as_fraction(L(1e-9)), po.as_fraction(L(None).cast("double")))) == ["1 in 4", "0", "below 1 in 1000000", ""]
    assert abs(value(po.residual_risk(L(0.04), L(0.9), L(True))) - 0.04 * 0.1 / (1 - 0.036)) < 1e-12 and value(po.residual_risk(L(0.04), L(0.9), L(False))) == 0.04 and value(po.residual_risk(L(None).cast("double"), L(0.9), L(True))) is None
    assert value(po.to_log_beta(L(2.0), L("OR"))) == math.log(2) and value(po.to_log_beta(L(2.0), L("log2(OR)"))) == 2 * math.log(2) and value(po.to_log_beta(L(2.0), L("beta"))) == 2.0
