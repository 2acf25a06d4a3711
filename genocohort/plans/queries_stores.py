"""Registered queries of the stored tables and of work that several operators share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alleles import zygosity
from ..operators import annotate
from ..operators.staging import new_folder
from ..sources import stores
from .queries import query

# Ids to look up, some of them in no file and some in no reference.
ASKED = ("rs1001", "RS1002 ", "rs1003", "rs1009", "rs1010", "rs1050", "rs1107", "rs1150", "rs999999")
ASKED_SQL = ", ".join(f"('{r.strip().lower()}')" for r in ASKED)


def reference_store(c):
    store = stores.ReferenceStore(c.spark, new_folder(c.spark, "reference"))
    store.write("calls", c.pooled().select("sample_id", "rsid", "allele1", "allele2", "chromosome", "position"))
    store.write("variants", c.view("fx_ref_variants"))
    store.write("frequencies", c.view("fx_allele_freq"))
    return store


@query("pl5_lookup_store", f"""SELECT s.sample_id, q.rsid, p.rsid IS NOT NULL AS in_your_data, p.gkey AS genotype, CASE WHEN p.gkey = 'NN' THEN 'no_call' WHEN substr(p.gkey, 1, 1) = substr(p.gkey, 2, 1) THEN 'homozygous' WHEN p.gkey IS NOT NULL THEN 'heterozygous' END AS zygosity, CAST(p.chrom_no AS VARCHAR) AS chromosome, p.position,
 r.rsid IS NOT NULL AS in_reference, r.gene, r.category, r.clinical_sig, r.interpretation FROM (SELECT DISTINCT sample_id FROM ox_pooled) s CROSS JOIN (VALUES {ASKED_SQL}) q(rsid) LEFT JOIN ox_pooled p ON p.sample_id = s.sample_id AND p.rsid = q.rsid LEFT JOIN fx_ref_variants r ON r.rsid = q.rsid""")
def _(c):
    return stores.look_up(reference_store(c), list(ASKED), c.pooled(), zygosity)


@query("pl5_bucketed_join", "SELECT r.gene, count(DISTINCT p.rsid) AS markers, count(*) AS rows, round(sum(f.freq), 4) AS freq FROM ox_pooled p JOIN fx_ref_variants r ON r.rsid = p.rsid JOIN fx_allele_freq f ON f.rsid = p.rsid GROUP BY r.gene")
def _(c):
    store = reference_store(c)
    each = store.table("calls").join(store.table("variants").select("rsid", "gene"), "rsid").join(store.table("frequencies").select("rsid", "freq"), "rsid")
    each = each.groupBy("rsid", "gene").agg(F.count(F.lit(1)).alias("rows"), F.sum("freq").alias("freq"))
    return each.groupBy("gene").agg(F.count(F.lit(1)).alias("markers"), F.sum("rows").alias("rows"), F.round(F.sum("freq"), 4).alias("freq"))


def stored_findings(c):
    """Half of the samples stored; then each third marker of all of them, some twice, put in two times over."""
    base = annotate.annotate(c.pooled(), c.view("fx_ref_variants")).select("sample_id", "rsid", F.substring("rsid", 3, 20).cast("long").alias("no"))
    old = base.where("sample_id % 2 = 0").select("sample_id", "rsid", F.lit("old").alias("gene"), F.lit("kept").alias("category"), F.lit("d1").alias("discovered_at"))
    new = base.where("no % 3 = 0").select("sample_id", "rsid", F.lit("new").alias("gene"), F.lit("d2").alias("discovered_at"), F.lit(2).alias("turn"))
    twice = base.where("no % 6 = 0").select("sample_id", "rsid", F.lit("stale").alias("gene"), F.lit("d3").alias("discovered_at"), F.lit(1).alias("turn"))
    store = stores.FindingsStore(c.spark, new_folder(c.spark, "findings"), buckets=16)
    store.upsert(old)
    for _ in range(2):
        store.upsert(new.unionByName(twice), order=("turn",))
    return store


STORED = """SELECT sample_id, rsid, CASE WHEN fresh THEN 'new' ELSE 'old' END AS gene, CASE WHEN sample_id % 2 = 0 THEN 'kept' END AS category, CASE WHEN sample_id % 2 = 1 THEN 'd2' ELSE 'd1' END AS discovered_at, CASE WHEN fresh THEN 2 END AS turn
 FROM (SELECT sample_id, rsid, CAST(substr(rsid, 3) AS BIGINT) % 3 = 0 AS fresh FROM ox_findings) WHERE sample_id % 2 = 0 OR fresh"""


@query("snk1_stored_upsert", f"SELECT *, 2 AS version FROM ({STORED})")
def _(c):
    store = stored_findings(c)
    return store.read().select("sample_id", "rsid", "gene", "category", "discovered_at", "turn", F.lit(store.version()).alias("version"))


@query("snk1_read_samples", f"SELECT * FROM ({STORED}) WHERE sample_id IN (3, 4)")
def _(c):
    return stored_findings(c).read(samples=[3, 4]).select("sample_id", "rsid", "gene", "category", "discovered_at", "turn")


@query("snk6_stored_erase", f"SELECT * FROM ({STORED}) WHERE sample_id % 4 <> 0")
def _(c):
    store = stored_findings(c)
    store.erase(c.pooled().where("sample_id % 4 = 0").select("sample_id"))
    return store.read().select("sample_id", "rsid", "gene", "category", "discovered_at", "turn")
