"""Readers and writers on tiny files."""

import pytest
from pyspark.sql import functions as F

from genocohort.sources import arrays, tables, vcf, writers
from genocohort.streaming.ingest import current_calls, ingest_stream


@pytest.fixture()
def put(tmp_path):
    def write(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    return write


def test_array_exports(spark, put, tmp_path):
    put("a.txt", "# made by 23andMe\n# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t10\tAG\nrs2\tX\t20\tA\nrs3\t1\t30\t--\ni9\t1\t5\tAA\nrs4\t1\tx\tAA\n")
    put("b.csv", '#AncestryDNA\nrsid,chromosome,position,allele1,allele2\n"rs1","1","10","A","0"\nrs5,2,50,C,T\n')
    put("c.txt", "nothing here\n")
    calls, refused = arrays.read_array_exports(spark, str(tmp_path))
    assert sorted((r.provider, r.rsid, r.chromosome, r.position, r.allele1, r.allele2) for r in calls.collect()) == [("23andme", "rs1", "1", 10, "A", "G"), ("23andme", "rs2", "X", 20, "A", "A"), ("ancestrydna", "rs5", "2", 50, "C", "T")]
    assert refused.count() == 1 and arrays.array_coverage(spark, str(tmp_path)).count() == 5


VCF = "##fileformat=VCFv4.2\n##contig=<ID=chr1,length=249250621>\n##reference=hg38\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n" + "".join("\t".join(x) + "\n" for x in [
    ("chr1", "10", "rs1", "A", "G,T", ".", "PASS", "DR2=0.9,0.1;AF=0.7;IMP", "DP:GT", "3:1/2", "3:0|1"), ("chr1", "20", "rs2", "A", "G", ".", "q10", "AF=0.2", "GT", "1", "./1"), ("chr1", "30", ".", "A", "G", ".", "PASS", "R2=x", "GT", "0/0", "0/0/1"), ("chr1", "40", "rs4", "A", "<NON_REF>", ".", "PASS", ".", "GT", "0/0", "0/0"), ("chr1", "50", "rs5", "AT", "A", ".", "PASS", ".", "GT", "0/0", "1/1"),
])


def test_vcf(spark, put):
    path = put("x.vcf", VCF)
    got = {(r["sample"], r.rsid): (r.allele1, r.allele2, r.phased) for r in vcf.read_vcf(spark, path).collect()}
    assert got == {("S1", "rs1"): ("G", "T", False), ("S2", "rs1"): ("A", "G", True), ("S1", "rs2"): ("G", "G", False)}
    n = vcf.skip_accounting(vcf.decode(vcf.read_lines(spark, path))).first()
    assert n.records == n.calls + sum(n[s] for s in vcf.SKIPS) == 10 and (n.calls, n.reference_block, n["shape"], n.no_call, n.no_id, n.kept_not_pass) == (3, 2, 3, 1, 1, 1)
    b = vcf.detect_build(vcf.read_lines(spark, path)).first()
    assert (b.build, b.confidence, b.evidence) == ("GRCh37", "medium", "contig_lengths")
    i = {r.position: (r.dr2, r.af, r.imputed) for r in vcf.read_imputed_vcf(spark, path).collect()}
    assert i[10] == (0.9, 0.7, True) and i[20] == (None, 0.2, False) and i[30] == (None, None, False)
    assert not vcf.require_phased(vcf.decode(vcf.read_lines(spark, path))).first().phased


def test_pileup(spark, put):
    path = put("p.txt", "chr1\t5\tA\t9\t..,G+2ACg-1t$^FG*,,\tIIIIIIIII\nchr1\t6\tC\t2\t..\tII\n")
    n = {r.position: (r.A, r.C, r.G, r["T"]) for r in vcf.read_pileup(spark, path).collect()}
    assert n == {5: (5, 0, 3, 0), 6: (0, 2, 0, 0)}
    g = {r.position: r.allele1 + r.allele2 for r in vcf.call_from_counts(vcf.read_pileup(spark, path)).collect()}
    assert g == {5: "AG", 6: "NN"}


def test_chain(spark, put):
    path = put("c.chain", "chain 900 chr1 1000 + 100 400 chr2 2000 - 50 360 7\n100 50 60\n150\n\nchain 10 chrM 10 + 0 10 chrM 10 + 0 10 8\n10\n")
    got = sorted((r.chrom, r.t_start, r.t_end, r.q_start, r.strand, r.score) for r in tables.read_chain_blocks(spark, path).collect())
    assert got == [("1", 100, 200, 50, "-", 900), ("1", 250, 400, 210, "-", 900), ("MT", 0, 10, 0, "+", 10)]


def test_tables(spark, put):
    clin = put("clin.tsv", "RS# (dbSNP)\tGeneSymbol\tClinicalSignificance\tReviewStatus\tAssembly\tPositionVCF\n1\tG\tPathogenic\tx\tGRCh37\t5\n-1\tG\tBenign\tx\tGRCh37\t5\n2\tna\tBenign\tx\tGRCh38\t5\n")
    assert [(r.rsid, r.position) for r in tables.read_clinvar_summary(spark, clin).collect()] == [("rs1", 5)]
    with pytest.raises(ValueError):
        tables.read_clinvar_summary(spark, put("bad.tsv", "a\tb\n1\t2\n"))
    gwas = put("gwas.tsv", "SNPS\tPVALUE_MLOG\tSTUDY ACCESSION\tMAPPED_TRAIT\tSTRONGEST SNP-RISK ALLELE\t95% CI (TEXT)\tPUBMEDID\nrs1 x rs2; chr1:5\t8.5\tS1\theight\trs1-A\t[1-2] unit decrease\t9\n")
    assert sorted((r.rsid, r.risk_allele, r.direction) for r in tables.read_gwas_associations(spark, gwas).collect()) == [("rs1", "A", "decrease"), ("rs2", "A", "decrease")]
    v, n = tables.read_scoring_file(spark, put("s.txt", "#weight_type=OR\nrsID\teffect_allele\teffect_weight\tis_dominant\nrs1\ta\t2.0\tFalse\nrs2\tC\t1.5\tTrue\nrs3\tG\tx\tFalse\n"))
    assert [(r.rsid, r.effect_allele, round(r.weight, 6)) for r in v.collect()] == [("rs1", "A", 0.693147)] and tuple(n.first())[1:] == (1, 1, 1)
    lab = tables.read_panel_labels(spark, put("p.panel", "sample pop super_pop gender\nS1 gbr EUR m\n")).first()
    assert tuple(lab) == ("S1", "GBR", "EUR")
    assert [r.proportion for r in tables.read_q_matrix(spark, put("m.Q", "0.25 0.75\n1 0\n"), ["P", "Q"]).orderBy("row", "pop").collect()] == [0.25, 0.75, 1.0, 0.0]
    with pytest.raises(ValueError):
        tables.read_q_matrix(spark, put("n.Q", "0.25 0.75\n1\n"), ["P", "Q"])
    assert tables.read_segments(spark, put("i.seg", "a b 23 10 20 IBD1 0 1 7.5 300\nbad row\n")).first().chrom == "X"
    assert [tuple(r) for r in tables.read_caller_tables(spark, put("y.txt", "Sample_name\tHg\tQC-score\nS1\t\t1\nS1\tR1\t2\n"), "yleaf").collect()] == [("S1", "R1", "2")]
    assert tables.read_genetic_map(spark, put("g.map", "1 . 0.5 1000\n1 . x 5\n")).collect()[0].bp == 1000


def test_json(spark):
    df = spark.createDataFrame([("a", '{"dbsnp":{"gene":[{"symbol":"G1"},{"symbol":"G2"}]},"clinvar":{"rcv":[{"clinical_significance":"Pathogenic","conditions":[{"name":"x"},{"name":"y"}]},{"clinical_significance":"Benign"}]}}'), ("b", '{"clinvar":{"rcv":{"clinical_significance":"drug response","conditions":{"name":"z"}}}}'), ("c", "{}")], "id string, j string")
    assert sorted(tuple(r) for r in tables.flatten_annotation_json(df, "j", "id").collect()) == [("a", "G1", "pathogenic", "x; y"), ("b", "", "drug response", "z")]
    p = spark.createDataFrame([("rs1", '{"populations":[{"population":"1000GENOMES:phase_3:GBR","allele":"a","frequency":0.25,"allele_count":5},{"population":"1000GENOMES:phase_3:EUR","allele":"A","frequency":0.3},{"population":"1000GENOMES:phase_3:ALL","allele":"A","frequency":0.2}]}')], "id string, j string")
    named, pooled = tables.flatten_population_json(p, "j", "id", ("GBR",))
    assert tuple(named.select("pop", "allele", "freq", "n").first()) == ("GBR", "A", 0.25, 2) and tuple(pooled.first()) == ("rs1", "A", 0.2)


def test_writers(spark):
    markers = spark.createDataFrame([("rs2", 1, 20, "C"), ("rs1", 1, 10, "A")], "rsid string, chrom_no int, position long, ref string")
    calls = spark.createDataFrame([(1, "rs1", 1, 10, "A", "G"), (1, "rs2", 1, 20, "N", "N"), (2, "rs2", 1, 20, "C", "C")], "sample_id long, rsid string, chrom_no int, position long, allele1 string, allele2 string")
    lines = lambda df: [r.value for r in df.collect()]
    assert lines(writers.plink_map(markers)) == ["1\trs1\t0\t10", "1\trs2\t0\t20"]
    assert lines(writers.plink_ped(calls, markers)) == ["1 1 0 0 0 -9 A G 0 0", "2 2 0 0 0 -9 0 0 C C"]
    assert lines(writers.plink_bim(calls, markers)) == ["1\trs1\t0\t10\tA\tG", "1\trs2\t0\t20\tC\t0"]
    assert sorted(lines(writers.positions_bed(markers))) == ["1\t19\t20\trs2", "1\t9\t10\trs1"]
    assert lines(writers.study_vcf(calls.where("sample_id = 1"), markers)) == ["1\t10\trs1\tA\tG\t.\tPASS\t.\tGT\t0/1"]
    assert not writers.study_vcf(calls.where("sample_id = 1")).first().ref_known
    assert lines(writers.hsd(calls.where("sample_id = 2"), spark.createDataFrame([(20, "T")], "position long, ref string"))) == ["2\t1-16569\t?\t20C"]


def test_stream(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "s1__k0.txt").write_text("# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t10\tAG\nrs1\t1\t10\tAA\n")
    (up / "s2__k0.txt").write_text("junk\n")
    run = lambda: ingest_stream(spark, str(up), str(tmp_path / "calls"), str(tmp_path / "refused"), str(tmp_path / "cp")).awaitTermination()
    run()
    (up / "s1__k1.txt").write_text("rsid,chromosome,position,allele1,allele2\nrs1,1,10,G,G\n")
    run()
    got = sorted((r.sample_id, r.kit, r.rsid, r.allele1 + r.allele2) for r in current_calls(spark, str(tmp_path / "calls")).collect())
    assert got == [("s1", "k0", "rs1", "AA"), ("s1", "k1", "rs1", "GG")] or got == [("s1", "k0", "rs1", "AG"), ("s1", "k1", "rs1", "GG")]
    assert spark.read.parquet(str(tmp_path / "refused")).select(F.col("reason")).count() == 1
