"""Stored findings and bucketed references."""

import os

import pytest

from genocohort.functions.alleles import zygosity
from genocohort.sources import stores

ROW = "sample_id long, rsid string, gene string, discovered_at string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_touches_only_what_changes(spark, tmp_path):
    store = stores.FindingsStore(spark, f"{tmp_path}/f", buckets=8)
    assert store.version() == 0 and store.upsert(spark.createDataFrame([], ROW)) == 0
    with pytest.raises(FileNotFoundError):
        store.read()
    first = [(s, f"rs{k}", "a", "d1") for s in range(40) for k in range(5)]
    assert store.upsert(spark.createDataFrame(first, ROW)) == 1
    before = store.folders()
    assert store.upsert(spark.createDataFrame(first, ROW)) == 1 and store.folders() == before
    # a change of the date alone is none; repeated keys: the last by turn; a row without a key goes
    assert store.upsert(spark.createDataFrame([(1, "rs1", "a", "d9"), (None, "rs1", "a", "d9")], ROW)) == 1
    fresh = spark.createDataFrame([(7, "rs1", "b", "d2", 1), (7, "rs1", "c", "d3", 2), (7, "rs1", "b", "d4", 1), (7, "new", None, "d5", 1)], f"{ROW}, turn int")
    assert store.upsert(fresh, order=("turn",)) == 2
    after = store.folders()
    assert sum(before[b] != after[b] for b in before) == 1
    want = {(s, r): (g, d, None) for s, r, g, d in first} | {(7, "rs1"): ("c", "d1", 2), (7, "new"): (None, "d5", 1)}
    assert {(r.sample_id, r.rsid): (r.gene, r.discovered_at, r.turn) for r in store.read().collect()} == want
    assert {(r.sample_id, r.rsid) for r in store.read(samples=[7]).collect()} == {k for k in want if k[0] == 7}
    assert store.read(samples=[99999]).count() == 0 and store.read(version=1).count() == 200
    assert store.upsert(fresh, order=("turn",)) == 2
    # another writer was first
    store.version = lambda: 1
    with pytest.raises(stores.StaleVersion):
        store.upsert(spark.createDataFrame([(7, "rs1", "z", "d")], ROW))
    del store.version
    held = files(f"{tmp_path}/f/data")
    assert store.erase(spark.createDataFrame([(7,), (7,), (12345,)], "sample_id long")) == 3
    assert {(r.sample_id, r.rsid) for r in store.read().collect()} == {k for k in want if k[0] != 7}
    assert len(files(f"{tmp_path}/f/data")) < len(held) and store.erase(spark.createDataFrame([], "sample_id long")) == 3


def test_lookup_prunes_buckets(spark, tmp_path):
    store = stores.ReferenceStore(spark, f"{tmp_path}/r")
    calls = spark.createDataFrame([(s, f"RS{k}", "A", "G" if k % 2 else "A", "1", k) for s in (1, 2) for k in range(s, 300)], "sample_id long, rsid string, allele1 string, allele2 string, chromosome string, position long")
    store.write("calls", calls, buckets=16)
    store.write("variants", spark.createDataFrame([(f"rs{k}", "g", "c", "benign", "") for k in range(0, 300, 2)], "rsid string, gene string, category string, clinical_sig string, interpretation string"), buckets=16)
    got = stores.look_up(store, ["RS1 ", "rs2", "rs700"], calls, zygosity)
    assert {(r.sample_id, r.rsid, r.in_your_data, r.genotype, r.zygosity, r.in_reference, r.gene) for r in got.collect()} == {
        (1, "rs1", True, "AG", "heterozygous", False, None), (1, "rs2", True, "AA", "homozygous", True, "g"), (1, "rs700", False, None, None, False, None),
        (2, "rs1", False, None, None, False, None), (2, "rs2", True, "AA", "homozygous", True, "g"), (2, "rs700", False, None, None, False, None),
    }
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else a plan without use for the order names no buckets
    got = stores.look_up(store, ["RS1 ", "rs2", "rs700"], calls, zygosity)
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("out of 16") == 2 and "16 out of 16" not in plan
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    with pytest.raises(ValueError):
        stores.look_up(store, ["i5000"], calls, zygosity)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = store.table("calls").join(store.table("variants"), "rsid")
        assert both.count() == 298 and "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # another session opens it by its path, and a table is replaced whole
    again = stores.ReferenceStore(spark, f"{tmp_path}/r")
    spark.sql(f"DROP TABLE {again._name('variants')}")
    assert again.table("variants").count() == 150
    again.write("variants", spark.createDataFrame([("rs1", "x")], "rsid string, gene string"), buckets=4)
    assert [tuple(r) for r in again.table("variants").collect()] == [("rs1", "x")]
